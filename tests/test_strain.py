"""Sums over bonds of the strain against a reference, where the atoms' block lies."""

import numpy as np
import pytest

from cellframe.model import Cell
from cellframe.operators.blocks import Block
from cellframe.operators.correspondence import _bond_moments
from cellframe.operators.measurements import nearest_vectors


@pytest.mark.parametrize("spread", [0.03, 0.3])
@pytest.mark.parametrize("move", [0.1, 3.0])
def test_sums_over_bonds_are_those_of_each_bond(spread, move):
    random, n, cutoff = np.random.default_rng(7), 900, 1.0
    reference, cell = Cell.cube(10.0), Cell((10.2, 0, 0, 4.9, 9.9, 0, -4.7, 3.1, 10.1))
    s = 0.5 + random.normal(size=(n, 3)) * spread
    images = random.integers(-1, 2, (n, 3)) @ cell.matrix
    now = s @ cell.matrix + random.normal(size=(n, 3)) * move + images
    block = Block(0, np.arange(n), s, np.zeros((n, 3), dtype=np.int32), np.arange(0, n, 2), np.arange(n), {}, reference)
    bonds, sums = _bond_moments(block, now, cell, cutoff)
    for i in range(0, n, 90):
        r = (s - s[i]) @ reference.matrix
        near = ((r**2).sum(axis=1) <= cutoff**2) & (np.arange(n) != i)
        u = (s - s[i]) @ cell.matrix
        v = (u + nearest_vectors(now - now[i] - u, cell))[near]
        r = r[near]
        a, b = np.triu_indices(3)
        expected = [*(r.T @ r)[a, b], *(v.T @ r).ravel(), (v**2).sum()]
        assert bonds[i] == near.sum()
        assert np.allclose(sums[i], expected, rtol=1e-9, atol=1e-9)
