"""The order of neighbors and the classes of common-neighbor analysis against their plain forms."""

import numpy as np

from cellframe.model import Cell
from cellframe.operators import structure
from cellframe.operators.blocks import Block, ranked


def test_equal_distances_are_ordered_by_row_and_vector():
    s = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)]) / 10.0
    rows = np.random.default_rng(2).permutation(len(s))
    block = Block(0, rows, s, np.zeros(s.shape, dtype=np.int32), np.arange(len(s)), np.arange(len(s)), {}, Cell.cube(10.0))
    i, j, vectors, d2 = (np.concatenate(c) for c in zip(*block.pairs(2.5), strict=True))
    order, rank = ranked(block, i, j, vectors, d2)
    plain = np.lexsort((vectors[:, 2], vectors[:, 1], vectors[:, 0], rows[j], d2, i))
    assert (order == plain).all() and rank.max() == np.bincount(i).max()


def test_signatures_are_asked_only_of_atoms_that_may_be_of_a_kind(monkeypatch):
    """Gas among crystals: what is no kind by its numbers of common neighbors has no signatures made."""
    random = np.random.default_rng(4)
    ring = np.array([(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if abs(x) + abs(y) + abs(z) == 2], dtype=float)
    second = np.array([(2.0, 0, 0), (0, 2.0, 0)])
    crystals = np.concatenate([ring, second])[None] + random.normal(size=(20, 14, 3)) * 0.01
    gas = random.normal(size=(200, 14, 3))
    gas = np.take_along_axis(gas, (gas**2).sum(axis=2).argsort(axis=1)[..., None], axis=1)
    asked, real = [], structure.signatures
    monkeypatch.setattr(structure, "signatures", lambda v, b: asked.append(len(v)) or real(v, b))
    found = structure.classify(np.concatenate([crystals, gas]), np.full(220, 14), True)
    assert (found[:20] == 1).all() and (found[20:] == 0).all()
    assert sum(asked) < 60
