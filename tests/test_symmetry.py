"""Groups of Hall symbols by their orders, orbits by plain images, tensors by plain matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.model import Cell
from cellframe.operators import symmetry

# Orders of the groups with centring: point group times lattice points.
ORDERS = {"P 1": 1, "-P 1": 2, "P 2y": 2, "-P 2ybc": 4, "-C 2y": 8, "P 2c -2ac": 4, "-P 2ac 2ab": 8, "-F 2 2": 32, "P 4w": 4, "-I 4bd": 16, "I 4bw 2bw": 16, "-P 4 2": 16, "P 31": 3, '-R 3 2"': 36, "P 31 2 (0 0 4)": 6, "P 61": 6, "-P 6c 2c": 24, "-P 6 2": 24, "P 2ac 2ab 3": 12, "-P 4 2 3": 48, "-F 4 2 3": 192, "F 4d 2 3 -1d": 192, "-I 4bd 2c 3": 96, "P 4 2 3 -1n": 48, "-I 4 2 3": 96}


@pytest.mark.parametrize("hall", ORDERS)
def test_groups_are_closed(hall):
    group = symmetry.operations(hall)
    assert len(group) == ORDERS[hall] == len(set(group))
    members = set(group)
    for r, t in group[:12]:
        for q, s in group:
            a, b = np.array(r).reshape(3, 3), np.array(q).reshape(3, 3)
            assert (tuple((a @ b).ravel().tolist()), tuple(((a @ s + t) % symmetry.PARTS).tolist())) in members


def test_operations_are_those_of_the_tables():
    text = lambda hall: {",".join("".join(("+" if v > 0 else "-") + a for v, a in zip(r[3 * k : 3 * k + 3], "xyz", strict=True) if v) + (f"+{t[k]}/24" if t[k] else "") for k in range(3)) for r, t in symmetry.operations(hall)}
    assert text("P 2ac 2ab") == {"+x,+y,+z", "-x+12/24,-y,+z+12/24", "+x+12/24,-y+12/24,-z", "-x,+y+12/24,-z+12/24"}, text("P 2ac 2ab")
    assert text("-P 2ybc") == {"+x,+y,+z", "-x,-y,-z", "-x,+y+12/24,-z+12/24", "+x,-y+12/24,+z+12/24"}
    assert text("P 31") == {"+x,+y,+z", "-y,+x-y,+z+8/24", "-x+y,-x,+z+16/24"}
    assert text("P 2x") == {"+x,+y,+z", "+x,-y,-z"}


@pytest.mark.parametrize("hall", ["", "X 2", "P", "P 5", "P 2 4 4", "P 3*1", "P 47"])
def test_what_is_no_symbol(hall):
    with pytest.raises(symmetry.SymmetryError):
        symmetry.operations(hall)


def test_orbits_have_each_place_once(spark):
    sites = {"corner": (0.0, 0.0, 0.0), "edge": (0.25, 0.25, 0.25), "near": (1e-7, -1e-7, 1 - 1e-8), "line": (0.2, 0.2, 0.2), "any": (0.11, 0.23, 0.37), "none": (None, 0.0, 0.0), "odd": (math.nan, 0.0, 0.0)}
    table = spark.createDataFrame([(k, *v) for k, v in sites.items()], "name string, sa double, sb double, sc double")
    found = symmetry.orbits(table, "-F 4 2 3").collect()
    want = {"corner": 4, "edge": 8, "near": 4, "line": 32, "any": 192}
    assert {r.name: r.multiplicity for r in found} == want and len(found) == sum(want.values())
    assert all(0 <= v < 1 for r in found for v in (r.sa, r.sb, r.sc))
    own = [(r.sa, r.sb, r.sc) for r in found if r.name == "line"]
    gap = lambda p, q: max(min(abs(a - b), 1 - abs(a - b)) for a, b in zip(p, q, strict=True))
    assert min(gap(p, q) for i, p in enumerate(own) for q in own[:i]) > 1e-3
    assert symmetry.orbits(table.limit(0), "P 1").count() == 0


def test_tensors(spark):
    cell = Cell((5.0, 0.0, 0.0, -2.5, 4.33, 0.0, 0.3, 0.2, 6.0))
    rng = np.random.default_rng(5)
    rows = []
    for k in range(20):
        a = rng.normal(size=(3, 3)) * 0.1
        u = a @ a.T + 0.001 * np.eye(3)
        rows.append((k, *[float(u[i, j]) for i, j in symmetry.TENSOR]))
    names = [f"u{k}" for k in range(6)]
    table = spark.createDataFrame(rows, "n int, " + ", ".join(f"{n} double" for n in names))
    columns = [F.col(n) for n in names]
    there = symmetry.cartesian_tensor(columns, cell)
    back = table.select("n", *[c.alias(n) for c, n in zip(there, names, strict=True)])
    back = back.select("n", *[c.alias(n) for c, n in zip(symmetry.cell_tensor(columns, cell), names, strict=True)])
    assert np.allclose(back.orderBy("n").toPandas()[names], np.array(rows)[:, 1:], atol=1e-12)
    full = lambda r: np.array([[r[0], r[3], r[4]], [r[3], r[1], r[5]], [r[4], r[5], r[2]]])
    reciprocal = np.linalg.inv(cell.matrix)
    basis = np.column_stack([cell.matrix[k] * np.linalg.norm(reciprocal[:, k]) for k in range(3)])
    got = table.select("n", *[c.alias(n) for c, n in zip(there, names, strict=True)]).orderBy("n").toPandas()[names].to_numpy()
    assert all(np.allclose(full(g), basis @ full(r[1:]) @ basis.T) for g, r in zip(got, rows, strict=True))
    # Operations of the cell's own lattice turn, and do not deform; radii stay as they are.
    hexagonal = Cell((3.0, 0.0, 0.0, -1.5, 1.5 * 3**0.5, 0.0, 0.0, 0.0, 4.0))
    at = next(k for k, (r, _) in enumerate(symmetry.operations("P 6")) if r == (1, -1, 0, 1, 0, 0, 0, 0, 1))
    turned = table.select("n", *[c.alias(n) for c, n in zip(symmetry.rotated_tensor(columns, at, "P 6", hexagonal), names, strict=True)])
    first, second = (symmetry.ellipsoids(t, names, 0.5).orderBy("n").toPandas() for t in (table, turned))
    assert np.allclose(np.stack(first["radii"]), np.stack(second["radii"])) and first["valid"].all()
    for r, own in zip(rows, first.itertuples(), strict=True):
        axes, radii = np.array(own.axes).reshape(3, 3), np.array(own.radii) / 1.5381722545
        assert np.allclose(axes.T @ np.diag(radii**2) @ axes, full(r[1:]), atol=1e-8)


def test_flat_and_impossible_tensors(spark):
    names = [f"u{k}" for k in range(6)]
    table = lambda *u: spark.createDataFrame([u], ", ".join(f"{n} double" for n in names))
    flat = symmetry.ellipsoids(table(1.0, 1.0, 0.0, 0.0, 0.0, 0.0), names).first()
    assert (flat.valid, flat.radii, flat.axes) == (False, None, None)
    for u in ((1.0, 1.0, -0.1, 0.0, 0.0, 0.0), (1.0, math.nan, 1.0, 0.0, 0.0, 0.0), (1.0, None, 1.0, 0.0, 0.0, 0.0)):
        with pytest.raises(Exception, match="tensor"):
            symmetry.ellipsoids(table(*u), names).collect()
    assert symmetry.probability_scale(0.5) == pytest.approx(1.5381722545, abs=1e-8) and symmetry.probability_scale(0.9) == pytest.approx(2.5002777, abs=1e-6)
    with pytest.raises(ValueError):
        symmetry.probability_scale(1.0)
