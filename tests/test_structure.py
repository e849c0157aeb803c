import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.model import Cell, crystal, with_positions
from cellframe.operators import clusters, correspondence, neighbors, structure


def frame_of(spark, s, cell):
    rows = [(0, k, str(k), "A", *map(float, v)) for k, v in enumerate(s)]
    return with_positions(spark.createDataFrame(rows, "frame_index int, row_idx long, atom_id string, type_label string, sa double, sb double, sc double"), cell)


def brute(s, cell, cutoff, reach=3):
    found = []
    steps = [range(-reach, reach + 1) if p else (0,) for p in cell.pbc]
    for i, j in itertools.product(range(len(s)), repeat=2):
        for n in itertools.product(*steps):
            if i == j and n == (0, 0, 0):
                continue
            d = (s[j] + np.array(n) - s[i]) @ cell.matrix
            if d @ d <= cutoff**2:
                found.append((i, j, *n))
    return sorted(found)


@pytest.mark.parametrize("pbc", [(True, True, True), (True, False, True), (False, False, False)])
def test_pairs_in_a_small_skewed_cell(spark, pbc):
    cell = Cell((2.0, 0, 0, 0.9, 1.7, 0, -0.4, 0.6, 2.3), pbc)
    s = np.random.default_rng(1).random((12, 3))
    for parts in (1, 7):
        found = neighbors.pairs(frame_of(spark, s, cell).repartition(parts), cell, 2.6).select("i", "j", "na", "nb", "nc").collect()
        assert sorted(map(tuple, found)) == brute(s, cell, 2.6)


def test_nearest_grows_its_radius(spark):
    cell = Cell.cube(10.0, (False, False, False))
    s = np.vstack([np.random.default_rng(2).random((10, 3)) * 0.1, [[0.99, 0.99, 0.99]]])
    found = neighbors.nearest(frame_of(spark, s, cell), cell, 4, radius=0.2).collect()
    for i in range(len(s)):
        order = sorted((float(((s[j] - s[i]) * 10) @ ((s[j] - s[i]) * 10)), j) for j in range(len(s)) if j != i)[:4]
        assert [r.j for r in sorted((r for r in found if r.i == i), key=lambda r: r.rank)] == [j for _, j in order]


@pytest.mark.parametrize("kind, cutoff, count, q4, q6", [("fcc", 3.2, 12, 0.19094, 0.57452), ("bcc", 4.2, 14, 0.03637, 0.51069), ("sc", 4.5, 6, 0.76376, 0.35355)])
def test_ideal_lattices(spark, kind, cutoff, count, q4, q6):
    atoms, cell = crystal(spark, kind, 3, 4.0)
    assert {r.coordination for r in structure.coordination(atoms, cell, cutoff).collect()} == {count}
    order = structure.bond_order(atoms, cell, cutoff).collect()
    assert all(abs(r.bondQ4 - q4) < 1e-4 and abs(r.bondQ6 - q6) < 1e-4 for r in order)


@pytest.mark.parametrize("kind, code", [("fcc", 1), ("bcc", 3), ("sc", 0)])
def test_common_neighbors_and_symmetry(spark, kind, code):
    atoms, cell = crystal(spark, kind, 4, 4.0)
    assert {r.structureType for r in structure.cna(atoms, cell).collect()} == {code}
    if kind == "fcc":
        assert {r.structureType for r in structure.cna(atoms, cell, 3.4).collect()} == {1}
        assert max(r.centralSymmetry for r in structure.centrosymmetry(atoms, cell).collect()) < 1e-12
        assert max(r.localShear for r in structure.local_shear(atoms, cell, 3.2).collect()) < 1e-9


def test_radial_distribution_counts(spark):
    cell = Cell.cube(10.0)
    atoms = frame_of(spark, [(0.1, 0.1, 0.1), (0.2, 0.1, 0.1), (0.35, 0.1, 0.1)], cell)
    found = structure.rdf(atoms, cell, 4.0, 4).orderBy("bin").collect()
    assert [r["count"] for r in found] == [0, 4, 2, 0]
    assert found[1].g == pytest.approx(4 * 1000 / (6 * 4 / 3 * math.pi * (2**3 - 1)))
    with pytest.raises(ValueError):
        structure.rdf(atoms, cell, 6.0, 4)


def test_clusters_and_percolation(spark):
    cell = Cell.cube(10.0)
    s = [(0.05, 0.5, 0.5), (0.97, 0.5, 0.5), (0.4, 0.1, 0.1), (0.1, 0.9, 0.9), (0.35, 0.9, 0.9), (0.6, 0.9, 0.9), (0.85, 0.9, 0.9)]
    atoms = frame_of(spark, s, cell)
    per_atom, table = clusters.clusters(atoms, structure.bonds(atoms, cell, 2.6), cell)
    ids = {r.row_idx: (r.clusterId, r.clusterSize) for r in per_atom.collect()}
    assert ids == {3: (1, 4), 4: (1, 4), 5: (1, 4), 6: (1, 4), 0: (2, 2), 1: (2, 2), 2: (3, 1)}
    rows = {r.clusterId: r for r in table.collect()}
    assert rows[1].percolating and math.isnan(rows[1].centre_x)
    assert not rows[2].percolating and rows[2].centre_x == pytest.approx(0.1) and rows[2].gyration_radius == pytest.approx(0.4)


def test_reference_strain_recovers_a_deformation(spark):
    atoms, cell = crystal(spark, "fcc", 3, 4.0)
    turn = np.array([[1.02, 0.01, 0.0], [0.0, 0.99, 0.03], [0.0, 0.0, 1.01]])
    new = Cell(tuple((cell.matrix @ turn.T).ravel()))
    moved = with_positions(atoms, new)
    found = correspondence.reference_strain(moved, atoms, new, cell, 3.2).collect()
    e = (turn.T @ turn - np.eye(3)) / 2
    for r in found:
        assert r.referenceF12 == pytest.approx(0.01, abs=1e-9) and r.referenceE23 == pytest.approx(e[1, 2], abs=1e-9)
        assert r.referenceVolumeChange == pytest.approx(np.linalg.det(turn) - 1, abs=1e-9) and r.referenceD2min == 0.0


def test_sites_balance(spark):
    sites, cell = crystal(spark, "fcc", 2, 4.0)
    atoms = sites.where("row_idx <> 5").unionByName(sites.where("row_idx = 9").withColumn("row_idx", F.lit(99).cast("long")).withColumn("sa", F.col("sa") + 0.01))
    occupied, per_atom = correspondence.wigner_seitz(atoms, sites, cell, 1.0)
    total = correspondence.defect_summary(occupied).first()
    assert (total.vacancies, total.interstitials, total.regular) == (1, 1, 30)
    assert per_atom.count() == atoms.count() and total.interstitials - total.vacancies == atoms.count() - sites.count()


def test_ids_are_checked(spark):
    a = spark.createDataFrame([("1", 0), ("2", 1)], "atom_id string, row_idx long")
    with pytest.raises(ValueError):
        correspondence.external_join(a, spark.createDataFrame([("1", 1.0), ("3", 2.0)], "atom_id string, v double"))
    with pytest.raises(ValueError):
        correspondence.matched_rows(a.union(a), a)


def test_displacement_in_a_skewed_cell(spark):
    cell = Cell((5.0, 0, 0, 2.4, 5.0, 0, 0, 0, 5.0))
    rng = np.random.default_rng(3)
    before, after = rng.random((30, 3)), rng.random((30, 3))
    found = {r.atom_id: r.displacementMagnitude for r in correspondence.displacement(frame_of(spark, after, cell), frame_of(spark, before, cell), cell).collect()}
    for k in range(30):
        images = [np.linalg.norm((after[k] - before[k] + np.array(n)) @ cell.matrix) for n in itertools.product((-2, -1, 0, 1, 2), repeat=3)]
        assert found[str(k)] == pytest.approx(min(images))


def test_replication_has_no_largest_number_of_copies(spark):
    from cellframe.operators import trajectory

    atoms, cell = crystal(spark, "sc", 1, 2.0)
    large, box = trajectory.replicated(atoms, cell, (1000, 1000, 5))
    found = large.agg(F.count("*").alias("n"), F.countDistinct("row_idx").alias("ids"), F.max("sa").alias("sa")).first()
    assert found.n == found.ids == 5_000_000 and found.sa < 1 and box.volume == pytest.approx(8.0 * 5e6)
