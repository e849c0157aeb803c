"""Cuts of long lineages."""
