"""Sums whatever the order, and sequences whose ids must agree."""

import math

import numpy as np
import pytest

from cellframe.operators import sums, trajectory


def test_sums_are_the_same_bits_in_any_order(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.normal(size=600) * 10.0 ** rng.integers(-20, 20, 600)] + [1e300, -1e300, 1e-200, 0.0, math.nan, math.inf, 5e-324]
    rows = [(k % 2, v, float(k)) for k, v in enumerate(values)] + [(7, None, 1.0)]
    found = set()
    for parts in (1, 3, 7):
        order = rng.permutation(len(rows))
        table = spark.createDataFrame([rows[i] for i in order], "k int, a double, b double").repartition(parts)
        found.add(tuple(sorted((r.k, r.a.hex(), r.b.hex()) for r in sums.exact_sums(table, ["k"], ["a", "b"]).collect())))
    assert len(found) == 1
    for k, a, _ in found.pop():
        own = [v for g, v, _ in rows if g == k and v is not None and math.isfinite(v)]
        assert float.fromhex(a) == pytest.approx(math.fsum(own), rel=1e-14, abs=1e-300)


def test_sequences_with_other_ids_are_refused(spark):
    frames = {0: "abc", 1: "cab", 2: "abd", 3: "abcc", 4: "abccc", 5: ""}
    atoms = spark.createDataFrame([(f, i) for f, ids in frames.items() for i in ids], "frame_index int, atom_id string")
    assert {r.frame_index: r.continuous for r in trajectory.continuity(atoms).collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}
    assert trajectory.continuous(atoms.where("frame_index < 2")).count() == 6
    with pytest.raises(ValueError, match="Frame 2"):
        trajectory.continuous(atoms)
