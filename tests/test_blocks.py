"""Neighborhood analyses against plain versions atom by atom."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.model import Cell, crystal, with_positions
from cellframe.operators import blocks, clusters, correspondence, grids, measurements, neighbors, polyhedra, selection, statistics, structure

SKEWED = Cell((6.0, 0, 0, 2.5, 5.0, 0, -1.5, 2.0, 7.0))


def frame_of(spark, s, cell, frames=(0,)):
    rows = [(f, k, str(k), "AB"[k % 2], *map(float, v)) for f in frames for k, v in enumerate(s)]
    return with_positions(spark.createDataFrame(rows, "frame_index int, row_idx long, atom_id string, type_label string, sa double, sb double, sc double"), cell)


def images(s, cell, i, reach=2):
    """(squared length, j, vector) of all images of all atoms around atom i, nearest first."""
    steps = [range(-reach, reach + 1) if p else (0,) for p in cell.pbc]
    found = []
    for n in itertools.product(*steps):
        v = (s + np.array(n) - s[i]) @ cell.matrix
        found += [(float((x * x).sum()), j, tuple(x)) for j, x in enumerate(v) if j != i or n != (0, 0, 0)]
    return sorted(found)


def plain_kind(near):
    """Adaptive common-neighbor analysis of one atom, straight from its definition."""
    v = np.array([x for _, _, x in near[:14]])
    size = np.sqrt((v**2).sum(axis=1))

    def tally(n, bond):
        linked = lambda a, b: np.linalg.norm(v[a] - v[b]) <= bond
        found = []
        for k in range(n):
            common = [a for a in range(n) if a != k and linked(a, k)]
            edges = [(a, b) for a, b in itertools.combinations(common, 2) if linked(a, b)]
            longest, left = 0, set(edges)
            while left:
                group = {left.pop()}
                while more := {e for e in left if any(set(e) & set(g) for g in group)}:
                    group |= more
                    left -= more
                longest = max(longest, len(group))
            found.append((len(common), len(edges), longest))
        return found

    t = tally(12, size[:12].mean() * (1 + math.sqrt(2)) / 2)
    kinds = [t.count((4, 2, 1)), t.count((4, 2, 2)), t.count((5, 5, 5))]
    if kinds[0] == 12 or kinds[:2] == [6, 6] or kinds[2] == 12:
        return 1 if kinds[0] == 12 else 2 if kinds[1] == 6 else 4
    mean = (size[:8].mean() / math.sqrt(0.75) * 8 + size[8:].mean() * 6) / 14
    t = tally(14, mean * (1 + math.sqrt(2)) / 2)
    return 3 if t.count((6, 6, 6)) == 8 and t.count((4, 4, 4)) == 6 else 0


def plain_symmetry(near):
    v = [np.array(x) for _, _, x in near]
    pairs = sorted((float(((v[a] + v[b]) ** 2).sum()), a, b) for a, b in itertools.combinations(range(len(v)), 2))
    free, total = set(range(len(v))), 0.0
    for d, a, b in pairs:
        if a in free and b in free:
            free -= {a, b}
            total += d
    return total / (2 * sum(float(x @ x) for x in v))


def shaken(kind, repeat, noise, seed):
    """A crystal's sites with noise, in several kinds of order."""
    from cellframe.model import BASIS

    rng = np.random.default_rng(seed)
    cells = np.array(list(itertools.product(range(repeat), repeat=3)))
    s = (np.array(BASIS[kind])[None] + cells[:, None]).reshape(-1, 3) / repeat
    return (s + rng.normal(0, noise, s.shape)) % 1.0


@pytest.mark.parametrize("kind, noise", [("fcc", 0.006), ("bcc", 0.008), ("sc", 0.01)])
def test_kinds_and_symmetry_equal_the_plain_versions(spark, kind, noise):
    s = shaken(kind, 4, noise, 3)
    cell = Cell.cube(4 * 4.0)
    atoms = frame_of(spark, s, cell, (0, 1))
    near = [images(s, cell, i, 1) for i in range(len(s))]
    kinds = {(r.frame_index, r.row_idx): r.structureType for r in structure.cna(atoms, cell).collect()}
    assert kinds == {(f, i): plain_kind(n) for f in (0, 1) for i, n in enumerate(near)}
    symmetry = {(r.frame_index, r.row_idx): r.centralSymmetry for r in structure.centrosymmetry(atoms, cell, 8).collect()}
    assert len(symmetry) == 2 * len(s) and all(v == pytest.approx(plain_symmetry(near[i][:8]), rel=1e-9) for (_, i), v in symmetry.items())
    shells = {r.row_idx: r for r in structure.centrosymmetry_auto(atoms.where("frame_index = 0"), cell).collect()}
    own = {i: kinds[0, i] for i in range(len(s))}
    for i, r in shells.items():
        votes = [own[j] for _, j, _ in near[i][:14]]
        packed, centred = sum(v in (1, 2) for v in votes), votes.count(3)
        shell = {1: 12, 2: 12, 3: 8, 4: 0}.get(own[i], 12 if packed > centred else 8 if centred > packed else 0)
        assert (r.structureType, r.shell) == (own[i], shell)
        assert math.isnan(r.centralSymmetry) if not shell else r.centralSymmetry == pytest.approx(plain_symmetry(near[i][:shell]), rel=1e-9)


@pytest.mark.parametrize("pbc", [(True, True, True), (False, True, False)])
def test_counts_and_order_in_a_skewed_cell_of_many_blocks(spark, pbc, monkeypatch):
    cell = Cell(SKEWED.h, pbc)
    s = np.random.default_rng(5).random((150, 3))
    atoms = frame_of(spark, s, cell)
    monkeypatch.setattr(blocks, "AIM", 10)
    monkeypatch.setattr(blocks, "CANDIDATES", 300)
    counts = {r.row_idx: r.coordination for r in structure.coordination(atoms, cell, 1.4).collect()}
    order = {r.row_idx: r for r in structure.bond_order(atoms, cell, 1.4).collect()}
    found = {}
    for r in neighbors.nearest(atoms, cell, 6).collect():
        found.setdefault(r.i, {})[r["rank"]] = r.j
    for i in range(len(s)):
        near = [n for n in images(s, cell, i) if n[0] <= 1.4**2]
        assert counts[i] == len({j for _, j, _ in near if j != i})
        assert [found[i][k] for k in range(1, 7)] == [j for _, j, _ in images(s, cell, i)[:6]]
        u = [np.array(v) / math.sqrt(d) for d, _, v in near]
        if u:
            c = np.array([[a @ b for b in u] for a in u])
            q6 = math.sqrt(max(0.0, ((231 * c**6 - 315 * c**4 + 105 * c**2 - 5) / 16).mean()))
            assert order[i].bondQ6 == pytest.approx(q6, abs=1e-7) and order[i].bondStatisticsCoordination == len(u)
        else:
            assert math.isnan(order[i].bondQ6)


def test_clusters_measures_equal_the_plain_version(spark):
    s = np.random.default_rng(9).random((120, 3))
    cell = Cell.cube(10.0)
    atoms = frame_of(spark, s, cell)
    per_atom, table = clusters.clusters(atoms, structure.bonds(atoms, cell, 1.1), cell)
    where = {}
    for i in range(len(s)):  # unwrapped from each cluster's smallest atom
        if i in where:
            continue
        where[i], todo = (i, s[i]), [i]
        while todo:
            a = todo.pop()
            for d, j, v in images(s, cell, a, 1):
                if d <= 1.1**2 and j not in where:
                    where[j] = (i, where[a][1] + np.array(v) / 10)
                    todo.append(j)
    groups = {}
    for i, (root, place) in where.items():
        groups.setdefault(root, []).append(place * 10)
    ranked = sorted(groups, key=lambda r: (-len(groups[r]), r))
    rows = {r.clusterId: r for r in table.collect()}
    assert {r.row_idx: r.clusterId for r in per_atom.collect()} == {i: ranked.index(root) + 1 for i, (root, _) in where.items()}
    assert not any(r.percolating for r in rows.values())
    for n, root in enumerate(ranked, 1):
        x = np.array(groups[root])
        spread = np.cov(x.T, bias=True).reshape(3, 3) if len(x) > 1 else np.zeros((3, 3))
        r = rows[n]
        assert (r.size, r.centre_x, r.gyration_radius) == (len(x), pytest.approx(x[:, 0].mean()), pytest.approx(math.sqrt(max(0.0, np.trace(spread))), abs=1e-6))
        assert [r.gyration_xx, r.gyration_yz] == [pytest.approx(spread[0, 0], abs=1e-9), pytest.approx(spread[1, 2], abs=1e-9)]
    values = {r.name: r.value for r in clusters.cluster_attributes(table).collect()}
    assert values == {"Clusters.cluster_count": len(ranked), "Clusters.largest_size": len(groups[ranked[0]]), "Clusters.percolating_count": 0}


def test_nearest_image_is_the_shortest(spark):
    for pbc in itertools.product((True, False), repeat=3):
        cell = Cell((1.0, 0, 0, 1.7, 0.8, 0, -2.2, 1.4, 0.7), pbc)
        d = np.random.default_rng(2).uniform(-2, 2, (25, 3))
        table = spark.createDataFrame([tuple(map(float, v)) for v in d], "x double, y double, z double")
        best = measurements.nearest_image([F.col(c) for c in "xyz"], cell)
        found = table.select("x", "y", "z", *[b.alias(f"b{n}") for n, b in enumerate(best)]).collect()
        steps = np.array(list(itertools.product(*[range(-22, 23) if p else (0,) for p in pbc]))) @ cell.matrix
        for r in found:
            shortest = ((np.array(r[:3]) + steps) ** 2).sum(axis=1).min()
            own = np.array(r[3:]) - np.array(r[:3])
            assert (np.array(r[3:]) ** 2).sum() == pytest.approx(shortest, abs=1e-9)
            turns = own @ np.linalg.inv(cell.matrix)
            assert np.abs(turns - np.round(turns)).max() < 1e-6 and all(p or abs(t) < 1e-6 for p, t in zip(pbc, turns, strict=True))


def test_picks_and_planes(spark):
    cell = Cell.cube(10.0)
    atoms = frame_of(spark, [(0.95, 0.5, 0.5), (0.05, 0.5, 0.5), (0.05, 0.6, 0.5), (0.05, 0.6, 0.6)], cell)
    picks = spark.createDataFrame([(1, 0, 0, 1, 2, 3), (2, 0, 0, 1, None, None), (3, 0, 1, 1, 2, None), (4, 0, 0, 9, None, None)], "measure_id int, frame_index int, a long, b long, c long, d long")
    found = {r.measure_id: r for r in measurements.measured(picks, atoms, cell).collect()}
    assert (found[1].distance, found[1].angle, abs(found[1].dihedral)) == (pytest.approx(1), pytest.approx(90), pytest.approx(90))
    assert found[2].distance == pytest.approx(1) and math.isnan(found[2].angle) and math.isnan(found[3].angle) and math.isnan(found[4].distance)
    assert measurements.measured(picks, atoms).where("measure_id = 2").first().distance == pytest.approx(9)
    normal, spacing = measurements.miller_plane((1, 1, 1), Cell.cube(3.0))
    assert spacing == pytest.approx(math.sqrt(3)) and normal == pytest.approx((3**-0.5,) * 3)
    assert measurements.nearest_plane((0, 0, 2), Cell.cube(3.0), (0, 0, 1.6)) == pytest.approx(1.5)
    with pytest.raises(ValueError):
        measurements.miller_plane((0, 0, 0), cell)


def test_voronoi_cells_of_uneven_frames_are_proven(spark):
    rng = np.random.default_rng(4)
    s = np.vstack([rng.random((90, 3)) * 0.05 + 0.4, [[0.9, 0.9, 0.9], [0.1, 0.8, 0.2]]])
    for pbc in ((True, True, True), (False, True, False)):
        cell = Cell.cube(10.0, pbc)
        rows = polyhedra.voronoi(frame_of(spark, s, cell), cell).collect()
        assert len(rows) == len(s) and sum(r.atomicVolume for r in rows) == pytest.approx(1000.0, rel=1e-9)
        # A volume is the share of points that lie nearest to the atom.
        sample = rng.random((40_000, 3))
        d = sample[:, None] - s[None]
        d -= np.where(pbc, np.round(d), 0)
        share = np.bincount((d**2).sum(axis=2).argmin(axis=1), minlength=len(s)) / len(sample)
        assert all(abs(r.atomicVolume / 1000 - share[r.row_idx]) < 0.012 for r in rows)


def test_tables_of_frames(spark):
    atoms, cell = crystal(spark, "fcc", 2, 4.0)
    atoms = atoms.withColumn("e", F.when(F.col("row_idx") == 0, float("nan")).otherwise(F.col("row_idx").cast("double")))
    rows = {(r.metric, r.category): r.value for r in statistics.summary_table(atoms, cell, ["e"]).collect()}
    assert rows[("atom_count", "")] == 32 and rows[("number_density", "")] == pytest.approx(32 / 512) and rows[("atomType.fraction", "A")] == 1 and rows[("e.nan_count", "")] == 1
    assert statistics.atom_table(atoms, ["e"]).columns == ["frame_index", "id", "type", "x", "y", "z", "e"]
    found = clusters.numbered(spark.range(100).selectExpr("0 as g", "id % 7 as size", "id"), ["g"], [F.desc("size"), F.col("id")], "n").collect()
    assert [r.id for r in sorted(found, key=lambda r: r.n)] == sorted(range(100), key=lambda i: (-(i % 7), i)) and sorted(r.n for r in found) == list(range(1, 101))
    site = correspondence.defect_attributes(spark.createDataFrame([(0, 1, 0, 0), (0, 2, 3, 2), (0, 3, 1, 3)], "frame_index int, site long, occupancy long, defect int"))
    assert {r.name: r.value for r in site.collect()} == {"WignerSeitz.vacancy_count": 1, "WignerSeitz.interstitial_count": 2, "WignerSeitz.antisite_count": 1, "WignerSeitz.site_count": 3}


@pytest.mark.parametrize("pbc", [(True, True, True), (False, False, False)])
def test_isosurface_of_a_sphere_is_closed_and_has_its_measures(spark, pbc):
    n = 24
    cell = Cell((10.0, 0, 0, 2.0, 9.0, 0, 0, 1.0, 8.0), pbc, (1.0, 2.0, 3.0))
    at = np.indices((n, n, n)).reshape(3, -1).T
    places = at / (n if pbc[0] else n - 1) @ cell.matrix
    values = 3.0 - np.linalg.norm(places - 0.5 * cell.matrix.sum(axis=0), axis=1)
    rows = [(*map(int, i), float(v)) for i, v in zip(at, values, strict=True)]
    samples = spark.createDataFrame(rows, "i int, j int, k int, value double").repartition(5)
    triangles = grids.isosurface(samples, (n, n, n), cell, 0.0)
    total = grids.surface_measures(triangles).first()
    assert total.area == pytest.approx(4 * math.pi * 9, rel=0.02) and total.volume == pytest.approx(4 / 3 * math.pi * 27, rel=0.02)
    edges = {}
    for r in triangles.collect():
        corners = [tuple(round(r[f"{c}{p}"], 6) for c in "xyz") for p in (1, 2, 3)]
        if len(set(corners)) == 3:
            for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
                edges[a, b] = edges.get((a, b), 0) + 1
    assert all(edges.get((b, a), 0) == count for (a, b), count in edges.items())
    holes = samples.withColumn("value", F.when((F.col("i") == 12) & (F.col("j") == 12), float("nan")).otherwise(F.col("value")))
    assert grids.isosurface(holes, (n, n, n), cell, 0.0).count() < triangles.count() and grids.isosurface(samples.limit(0), (n, n, n), cell, 0.0).count() == 0


def test_frames_are_kept_apart(spark):
    rng = np.random.default_rng(21)
    sites = frame_of(spark, rng.random((3, 3)), SKEWED)
    atoms = frame_of(spark, rng.random((3, 3)), SKEWED, (4, 5))
    occupied, per_atom = correspondence.wigner_seitz(atoms, sites, SKEWED, 1.0)
    assert occupied.count() == per_atom.count() == 6
    assert {(r.frame_index, r["sum(occupancy)"]) for r in occupied.groupBy("frame_index").sum("occupancy").collect()} == {(4, 3), (5, 3)}
    moved = correspondence.displacement(atoms, sites, SKEWED)
    assert moved.count() == 6 and {r.frame_index for r in moved.collect()} == {4, 5}
    assert {(r.frame_index, r["name"]): r["value"] for r in correspondence.defect_attributes(occupied).collect()}[4, "WignerSeitz.site_count"] == 3
    start = spark.createDataFrame([(4, 0)], "frame_index int, row_idx long")
    links = spark.createDataFrame([(4, 0, 1), (5, 1, 2), (5, 0, 2)], "frame_index int, i long, j long")
    assert {tuple(r) for r in selection.expanded(start, links, 3).collect()} == {(4, 0), (4, 1)}
    with pytest.raises(ValueError):
        correspondence.displacement(atoms, atoms, SKEWED)


def test_bonds_keep_their_images_in_small_skewed_cells(spark):
    rng = np.random.default_rng(22)
    s = rng.random((4, 3))
    small = Cell((3.1, 0, 0, 1.4, 2.9, 0, -1.2, 0.9, 3.3))
    f = np.eye(3) + np.array([[0.02, 0.03, 0], [0, -0.01, 0.02], [0.01, 0, 0.03]])
    strained = Cell(tuple((small.matrix @ f.T).ravel()))
    reference = frame_of(spark, s, small)
    current = frame_of(spark, s + rng.integers(-2, 3, s.shape), strained, (1, 2))
    found = correspondence.reference_strain(current, reference, strained, small, 4.0).collect()
    assert len(found) == 8
    for r in found:
        assert np.allclose([[r[f"referenceF{a}{b}"] for b in (1, 2, 3)] for a in (1, 2, 3)], f, atol=1e-9) and r.referenceD2min == 0


def test_voronoi_ends_where_atoms_share_a_place(spark):
    rng = np.random.default_rng(23)
    s = rng.random((12, 3))
    found = {r.row_idx: r for r in polyhedra.voronoi(frame_of(spark, np.vstack([s, s[3], s[3]]), SKEWED), SKEWED).collect()}
    assert len(found) == 14 and found[12].voronoiIndex == found[13].voronoiIndex == "coincident" and math.isnan(found[12].atomicVolume)
    assert sum(r.atomicVolume for k, r in found.items() if k < 12) == pytest.approx(SKEWED.volume)
    pair = frame_of(spark, np.zeros((2, 3)) + 0.5, Cell.cube(10.0))
    assert {r.row_idx: r.voronoiIndex for r in polyhedra.voronoi(pair, Cell.cube(10.0)).collect()}[1] == "coincident"
