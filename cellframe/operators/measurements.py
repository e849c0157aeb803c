"""Distances, angles and dihedrals of chosen atoms, and the exact nearest periodic image."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions import ieee
from cellframe.model import Cell


def reduced_basis(vectors: np.ndarray) -> np.ndarray:
    """Up to three vectors of the same lattice, each the shortest that the shorter ones leave.

    In such a basis the lattice vector nearest to a point is at most one step from the rounded
    coordinates along every vector.
    """
    basis = np.array(sorted(vectors, key=np.linalg.norm), dtype=float).reshape(-1, 3)
    while len(basis) > 1:
        for k in range(1, len(basis)):
            shorter = basis[:k]
            rounded = np.rint(basis[k] @ np.linalg.pinv(shorter))
            options = [basis[k] - (rounded + step) @ shorter for step in itertools.product((0, -1, 1), repeat=k)]
            best = min(options, key=lambda v: float(v @ v))
            if best @ best < basis[k] @ basis[k] * (1 - 1e-12):
                basis[k] = best
                basis = np.array(sorted(basis, key=np.linalg.norm))
                break
        else:
            break
    return basis


def nearest_image(d: list[Column], cell: Cell) -> list[Column]:
    """The shortest of a vector's periodic images, for cells of any shape; NaN stays."""
    periodic = np.array([v for v, p in zip(cell.matrix, cell.pbc, strict=True) if p]).reshape(-1, 3)
    if not len(periodic):
        return d
    basis = reduced_basis(periodic)
    inverse = np.linalg.pinv(basis)
    linear = lambda row: sum((d[k] * float(row[k]) for k in range(3)), F.lit(0.0))
    turns = [-ieee.nearest_image(linear(inverse[:, i])) for i in range(len(basis))]
    base = [d[k] + sum((turns[i] * float(basis[i, k]) for i in range(len(basis))), F.lit(0.0)) for k in range(3)]
    if np.allclose(basis @ basis.T, np.diag((basis**2).sum(axis=1)), atol=1e-9 * float((basis**2).max())):
        return base
    steps = [np.array(step) @ basis for step in itertools.product((0, -1, 1), repeat=len(basis))]

    def shortest(r: Column) -> Column:
        options = []
        for k, step in enumerate(steps):
            moved = [r[n] + float(v) for n, v in zip("xyz", step, strict=True)]
            options.append(F.struct((moved[0] * moved[0] + moved[1] * moved[1] + moved[2] * moved[2]).alias("d2"), F.lit(k).alias("k"), *[m.alias(n) for m, n in zip(moved, "xyz", strict=True)]))
        return F.array_min(F.array(*options))

    # Bound to a name, the vector is computed once, and the generated code stays small.
    best = F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for c, n in zip(base, "xyz", strict=True)])), shortest), 1)
    return [best[n] for n in "xyz"]


def nearest_vectors(d: np.ndarray, cell: Cell) -> np.ndarray:
    """``nearest_image`` of many vectors (n, 3)."""
    periodic = np.array([v for v, p in zip(cell.matrix, cell.pbc, strict=True) if p]).reshape(-1, 3)
    if not len(periodic):
        return d
    basis = reduced_basis(periodic)
    base = d - np.floor(d @ np.linalg.pinv(basis) + 0.5) @ basis
    best, least = base, (base**2).sum(axis=1)
    for step in itertools.product((0, -1, 1), repeat=len(basis)):
        moved = base + np.array(step) @ basis
        d2 = (moved**2).sum(axis=1)
        nearer = d2 < least * (1 - 1e-12)
        best, least = np.where(nearer[:, None], moved, best), np.where(nearer, d2, least)
    return best


def shortest_image(cell: Cell) -> float:
    """The length of the shortest vector between two images of one point."""
    periodic = np.array([v for v, p in zip(cell.matrix, cell.pbc, strict=True) if p]).reshape(-1, 3)
    return float(np.linalg.norm(reduced_basis(periodic), axis=1).min()) if len(periodic) else float("inf")


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def measured(picks: DataFrame, atoms: DataFrame, cell: Cell | None = None, key: str = "row_idx") -> DataFrame:
    """distance, angle and dihedral of picks (measure_id, frame_index, a, b, c, d), in order; c and d may be null.

    With ``cell`` every step goes to the nearest image; without it positions count as they are.  Angles are
    in degrees, NaN where atoms are not picked, coincide or lie in line; ``distance`` is that of the first
    two, ``distance_2`` and ``distance_3`` those of the further steps.  A pick of an atom that is not there
    gives NaN too.
    """
    joined = picks
    for side in "abcd":
        place = atoms.select("frame_index", F.col(key).alias(side), *[F.col(c).alias(f"_{c}{side}") for c in "xyz"])
        joined = joined.join(place, ["frame_index", side], "left")
    names = []
    for n, (p, q) in enumerate((("a", "b"), ("b", "c"), ("c", "d"))):
        step = [F.col(f"_{c}{q}") - F.col(f"_{c}{p}") for c in "xyz"]
        step = step if cell is None else nearest_image(step, cell)
        names.append([f"_{c}_{n}" for c in "xyz"])
        joined = joined.withColumns(dict(zip(names[-1], step, strict=True)))
    first, second, third = ([F.col(c) for c in own] for own in names)
    size = lambda v: F.sqrt(_dot(v, v))
    nan = ieee.nan()
    back = [-c for c in first]
    cosine = _dot(back, second) / F.when(size(back) * size(second) > 0, size(back) * size(second))
    angle = F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    unit = [c / F.when(size(second) > 0, size(second)) for c in second]
    v = [c - _dot(back, unit) * u for c, u in zip(back, unit, strict=True)]
    w = [c - _dot(third, unit) * u for c, u in zip(third, unit, strict=True)]
    clear = (size(v) > 1e-12 * size(back)) & (size(w) > 1e-12 * size(third))
    dihedral = F.when(clear, F.degrees(F.atan2(_dot(_cross(unit, v), w), _dot(v, w))))
    lengths = {("distance" if n == 0 else f"distance_{n + 1}"): F.coalesce(size(v), nan) for n, v in enumerate((first, second, third))}
    found = joined.withColumns({**lengths, "angle": F.coalesce(angle, nan), "dihedral": F.coalesce(dihedral, nan)})
    return found.select("measure_id", *lengths, "angle", "dihedral")


def miller_plane(hkl: tuple[int, int, int], cell: Cell) -> tuple[tuple[float, float, float], float]:
    """Unit normal and spacing of the lattice planes (h k l) of a cell of any shape."""
    if len(hkl) != 3 or any(not isinstance(i, int) for i in hkl) or not any(hkl):
        raise ValueError("Miller indices are three whole numbers, not all zero")
    g = np.linalg.inv(cell.matrix) @ np.array(hkl, dtype=float)
    length = float(np.linalg.norm(g))
    return tuple((g / length).tolist()), 1 / length


def nearest_plane(hkl: tuple[int, int, int], cell: Cell, point: tuple[float, float, float]) -> float:
    """Position along its normal of the lattice plane nearest to a point."""
    normal, spacing = miller_plane(hkl, cell)
    base = float(np.dot(normal, cell.origin))
    return base + round((float(np.dot(normal, point)) - base) / spacing) * spacing
