"""Full bins: distances as products of matrices give what measuring each pair gives."""

import numpy as np
import pytest

from cellframe.model import Cell
from cellframe.operators import blocks
from cellframe.operators.blocks import Block


def block_of(n: int, seed: int, cell: Cell, images: int = 1) -> Block:
    """A clump of atoms, some in one place, with their images."""
    rng = np.random.default_rng(seed)
    s = rng.normal(0.5, 0.1, (n, 3)) % 1
    s[1] = s[0]
    s[2] = s[0] + [0.05, 0, 0]
    steps = np.array([(a, b, c) for a in range(-images, images + 1) for b in range(-images, images + 1) for c in range(-images, images + 1)])
    shift = np.repeat(steps, n, axis=0)
    rows, all_s = np.tile(np.arange(n), len(steps)), np.tile(s, (len(steps), 1)) + shift
    home = np.flatnonzero((shift == 0).all(axis=1))
    return Block(0, rows, all_s, shift, home, np.arange(len(rows)), {}, cell)


def brute(block: Block, cutoff: float):
    i = np.repeat(block.centres, len(block.rows))
    j = np.tile(np.arange(len(block.rows)), len(block.centres))
    return block._within(cutoff, i, j)


@pytest.mark.parametrize("cell", [Cell.cube(10.0), Cell((10.0, 0, 0, 7.0, 8.0, 0, -3.0, 5.0, 9.0))])
@pytest.mark.parametrize("cutoff", [1.0, 2.5])
def test_tiles(monkeypatch, cell, cutoff):
    block = block_of(300, 1, cell)
    i, j, _, d2 = brute(block, cutoff)
    counts = np.bincount(i, minlength=len(block.rows))
    lengths = np.bincount(np.minimum(np.floor(np.sqrt(d2) / cutoff * 20).astype(int), 20), minlength=21)
    ahead = [tuple(s) > (0, 0, 0) for s in block.shift.tolist()]
    below = (block.rows[i] < block.rows[j]) | (block.rows[i] == block.rows[j]) & np.array(ahead)[j]
    half = np.bincount(np.minimum(np.floor(np.sqrt(d2[below]) / cutoff * 20).astype(int), 20), minlength=21)
    for full in (1, 1 << 60):
        monkeypatch.setattr(blocks, "FULL", full)
        assert (block.tiles(cutoff) is None) == (full > 1)
        found = [np.concatenate(c) for c in zip(*[(a, b) for a, b, *_ in block.pairs(cutoff)], strict=True)]
        assert sorted(zip(*map(list, found), strict=True)) == sorted(zip(i.tolist(), j.tolist(), strict=True))
        assert (block.counts(cutoff) == counts).all()
        assert (block.histogram(cutoff, 20) == lengths).all()
        assert (block.histogram(cutoff, 20, centre_below=True) == half).all()


def test_blocks_of_many_pairs_are_dealt_to_several_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cellframe.operators import neighbors, structure

    atoms = spark.range(400).select(F.lit(0).alias("frame_index"), F.col("id").alias("row_idx"), *[(F.rand(k) / 8 + 0.4).alias(c) for k, c in enumerate(("sa", "sb", "sc"))]).localCheckpoint()
    cell = Cell.cube(10.0)
    plain = sorted(neighbors.pairs(atoms, cell, 1.0).collect()), sorted(structure.coordination(atoms, cell, 1.0).collect())
    monkeypatch.setattr(blocks, "HOT", 1 << 12)
    dealt = blocks.blocks(atoms, cell, 1.0, [2, 2, 2])
    assert dealt.where("role = 1").count() == 400 and dealt.select("deal").distinct().count() > 4
    assert (sorted(neighbors.pairs(atoms, cell, 1.0).collect()), sorted(structure.coordination(atoms, cell, 1.0).collect())) == plain


@pytest.mark.parametrize("full", [1, 1 << 60])
def test_angles_and_bonds_are_counted_where_blocks_lie(spark, monkeypatch, full):
    from pyspark.sql import functions as F

    from cellframe.operators import structure

    monkeypatch.setattr(blocks, "FULL", full)
    atoms = spark.range(300).select(F.lit(0).alias("frame_index"), F.col("id").alias("row_idx"), (F.col("id") % 3).cast("string").alias("type_label"), *[(F.round(F.rand(k), 2) / 4 + 0.9).alias(c) for k, c in enumerate(("sa", "sb", "sc"))])
    atoms = atoms.withColumns({c: F.col(c) - F.floor(c) for c in ("sa", "sb", "sc")}).localCheckpoint()
    cell = Cell.cube(10.0)
    plain = structure.angle_histogram(structure.bond_angles(atoms, cell, 1.0), 30)
    found = structure.angle_counts(atoms, cell, 1.0, 30)
    # Rounded coordinates put angles on the limits of bins, where the last bit decides.
    assert sum(r["count"] for r in found.collect()) == sum(r["count"] for r in plain.collect())
    typed = structure.bonds(atoms, cell, 0.8, {("1", "2"): 1.5, ("0", "0"): 0.0})
    kinds = {r.row_idx: r.type_label for r in atoms.collect()}
    limit = {("1", "2"): 1.5, ("2", "1"): 1.5, ("0", "0"): 0.0}
    wanted = sorted((r.i, r.j) for r in structure.bonds(atoms, cell, 1.5).collect() if 0 < (own := limit.get((kinds[r.i], kinds[r.j]), 0.8)) and r.d2 <= own * own)
    assert sorted((r.i, r.j) for r in typed.collect()) == wanted
    typed.collect()
    assert "Join" not in typed._jdf.queryExecution().executedPlan().toString()


def test_nearest_sites_make_no_table_of_pairs(spark, monkeypatch):
    from cellframe.operators import correspondence

    monkeypatch.setattr(correspondence, "pairs", None)
    atoms = spark.createDataFrame([(0, 0, 0.1, 0.1, 0.1), (0, 1, 0.9, 0.9, 0.9), (0, 2, float("nan"), 0.0, 0.0)], "frame_index int, row_idx long, sa double, sb double, sc double")
    site = spark.createDataFrame([(0, 5, 0.2, 0.1, 0.1)], atoms.schema)
    found = correspondence.nearest_sites(atoms, site, Cell.cube(10.0, (False, False, False)), 1.0)
    assert sorted((r.row_idx, r.site) for r in found.collect()) == [(0, 5), (1, 5)]
