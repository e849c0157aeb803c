"""Surfaces of constant value in grids of samples."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.model import Cell

#: The six tetrahedra around a cube's diagonal: paths from corner 0 to corner 7, one axis (1, 2, 4) after the other.
TETRAHEDRA = np.array([(0, a, a + b, 7) for a, b, _ in itertools.permutations((1, 2, 4))])
CORNERS = np.array([(c & 1, c >> 1 & 1, c >> 2 & 1) for c in range(8)])
TRIANGLE = [f"{c}{n}" for n in (1, 2, 3) for c in "xyz"]


def cells_of(samples: DataFrame, shape: tuple[int, int, int], periodic: tuple[bool, bool, bool]) -> DataFrame:
    """i, j, k and the eight corner values of every cell between samples; periodic axes close around."""

    def beside(axis: str, n: int, wraps: bool):
        at, last = F.col(axis), n if wraps else n - 1
        below = F.pmod(at - 1, F.lit(n)) if wraps else at - 1
        options = F.array(F.struct(at.cast("int").alias("at"), F.lit(0).alias("d")), F.struct(below.cast("int").alias("at"), F.lit(1).alias("d")))
        return F.filter(options, lambda o: (o["at"] >= 0) & (o["at"] < last))

    axes = [beside(axis, n, wraps) for axis, n, wraps in zip("ijk", shape, periodic, strict=True)]
    spread = samples.where("value is not null").select(*[F.explode(a).alias(f"_{n}") if n == "i" else a.alias(f"_{n}") for n, a in zip("ijk", axes, strict=True)], "value")
    spread = spread.select("_i", F.explode("_j").alias("_j"), "_k", "value").select("_i", "_j", F.explode("_k").alias("_k"), "value")
    corner = F.col("_i.d") + 2 * F.col("_j.d") + 4 * F.col("_k.d")
    values = [F.max(F.when(corner == c, F.col("value"))).alias(f"v{c}") for c in range(8)]
    return spread.groupBy(*[F.col(f"_{n}.at").alias(n) for n in "ijk"]).agg(*values)


def isosurface(samples: DataFrame, shape: tuple[int, int, int], cell: Cell, level: float) -> DataFrame:
    """Triangles (i, j, k of their cell, x1 .. z3, area) where samples (i, j, k, value) pass ``level``.

    Samples divide periodic axes of the cell evenly and go from end to end of open ones.  Every cell is cut
    into six tetrahedra that neighboring cells share, so surfaces are closed; triangles turn to the lower
    side.  Cells with a missing or non-finite corner are left out; a value at the level counts as below it.
    """
    steps = cell.matrix / np.array([n if wraps else max(n - 1, 1) for n, wraps in zip(shape, cell.pbc, strict=True)])[:, None]
    passed = F.expr(" and ".join(f"v{c} is not null and not isnan(v{c}) and abs(v{c}) < double('infinity')" for c in range(8)))
    corners = [F.col(f"v{c}") for c in range(8)]
    cells = cells_of(samples, shape, cell.pbc).where(passed & (F.greatest(*corners) > level) & (F.least(*corners) <= level))
    names = ["i", "j", "k", *TRIANGLE, "area"]

    def cut_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            values = np.column_stack([batch.column(3 + c).to_numpy() for c in range(8)])
            owner, triangles = _triangles(values, level)
            places = (triangles + index[owner][:, None]) @ steps + np.array(cell.origin)
            area = np.linalg.norm(np.cross(places[:, 1] - places[:, 0], places[:, 2] - places[:, 0]), axis=1) / 2
            columns = [pa.array(index[owner, c].astype(np.int32)) for c in range(3)] + [pa.array(places[:, p, c]) for p in range(3) for c in range(3)] + [pa.array(area)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{n} int" for n in "ijk") + "".join(f", {n} double" for n in names[3:])
    return cells.select("i", "j", "k", *[F.col(f"v{c}").cast("double") for c in range(8)]).mapInArrow(cut_cells, schema)


def _triangles(values: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Owners and corners (in cell units) of the triangles in cells with eight corner ``values`` each."""
    owners, found = [np.zeros(0, dtype=np.int64)], [np.zeros((0, 3, 3))]
    for tetrahedron in TETRAHEDRA:
        own, place = values[:, tetrahedron], CORNERS[tetrahedron].astype(float)
        above = own > level
        code = above @ (1, 2, 4, 8)
        for mask in range(1, 15):
            rows = np.flatnonzero(code == mask)
            if not len(rows):
                continue
            high, low = [c for c in range(4) if mask >> c & 1], [c for c in range(4) if not mask >> c & 1]

            def crossing(a: int, b: int, rows=rows, own=own, place=place) -> np.ndarray:
                share = (level - own[rows, b]) / (own[rows, a] - own[rows, b])
                return place[b] + share[:, None] * (place[a] - place[b])

            if len(high) == 2:
                ring = [crossing(high[0], low[0]), crossing(high[0], low[1]), crossing(high[1], low[1]), crossing(high[1], low[0])]
                parts = [(ring[0], ring[1], ring[2]), (ring[0], ring[2], ring[3])]
            else:
                one, others = (high[0], low) if len(high) == 1 else (low[0], high)
                parts = [tuple(crossing(one, o) if len(high) == 1 else crossing(o, one) for o in others)]
            down = place[low].mean(axis=0) - place[high].mean(axis=0)
            for a, b, c in parts:
                turned = np.cross(b - a, c - a) @ down < 0
                found.append(np.stack([a, np.where(turned[:, None], c, b), np.where(turned[:, None], b, c)], axis=1))
                owners.append(rows)
    return np.concatenate(owners), np.concatenate(found)


def surface_measures(triangles: DataFrame) -> DataFrame:
    """triangles, area and the enclosed volume of a closed surface in an open cell (that of the higher side)."""
    x = {n: F.col(n) for n in TRIANGLE}
    product = x["x1"] * (x["y2"] * x["z3"] - x["z2"] * x["y3"]) + x["y1"] * (x["z2"] * x["x3"] - x["x2"] * x["z3"]) + x["z1"] * (x["x2"] * x["y3"] - x["y2"] * x["x3"])
    return triangles.agg(F.count("*").alias("triangles"), F.sum("area").alias("area"), (F.sum(product) / 6).alias("volume"))


def replicated_samples(samples: DataFrame, shape: tuple[int, int, int], counts: tuple[int, int, int], periodic: tuple[bool, bool, bool]) -> DataFrame:
    """Samples repeated along the axes of their grid, of which only periodic ones can be."""
    if min(counts) < 1 or any(n > 1 and not wraps for n, wraps in zip(counts, periodic, strict=True)):
        raise ValueError("Only periodic axes can be repeated, and copies count from one")
    for axis, size, n in zip("ijk", shape, counts, strict=True):
        if n > 1:
            samples = samples.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(axis, (F.col(axis) + F.col("_copy") * size).cast("int")).drop("_copy")
    return samples
