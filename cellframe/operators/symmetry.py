"""Symmetry of crystals: groups from Hall symbols, orbits of sites, displacement tensors and their ellipsoids.

Groups are closed from their generators in whole numbers (rotations, and translations in parts of ``PARTS``),
at most 192 operations; they enter plans as literals.  Sites are rows of any number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.model import AXES, Cell

#: A translation is a whole number of these parts of a cell's edge.
PARTS = 24
# Fixed values of the notation: centring translations, translations by letter, and rotations about c and the diagonals, in parts of 24.
CENTRING = {"P": [], "A": [(0, 12, 12)], "B": [(12, 0, 12)], "C": [(12, 12, 0)], "I": [(12, 12, 12)], "R": [(16, 8, 8), (8, 16, 16)], "F": [(0, 12, 12), (12, 0, 12), (12, 12, 0)]}
SHIFTS = {"a": (12, 0, 0), "b": (0, 12, 0), "c": (0, 0, 12), "n": (12, 12, 12), "u": (6, 0, 0), "v": (0, 6, 0), "w": (0, 0, 6), "d": (6, 6, 6)}
ABOUT_C = {1: ((1, 0, 0), (0, 1, 0), (0, 0, 1)), 2: ((-1, 0, 0), (0, -1, 0), (0, 0, 1)), 3: ((0, -1, 0), (1, -1, 0), (0, 0, 1)), 4: ((0, -1, 0), (1, 0, 0), (0, 0, 1)), 6: ((1, -1, 0), (1, 0, 0), (0, 0, 1))}
DIAGONAL = {"'": ((0, -1, 0), (-1, 0, 0), (0, 0, -1)), '"': ((0, 1, 0), (1, 0, 0), (0, 0, -1))}
BODY = ((0, 0, 1), (1, 0, 0), (0, 1, 0))
_TOKEN = re.compile(r"(-?)([12346])([1-5]?)([xyz'\"*]?)([1-5]?)([abcnuvwd]*)$")
#: Components of a tensor in order, as (row, column).
TENSOR = ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))


class SymmetryError(ValueError):
    pass


def _about(matrix: tuple, axis: str) -> np.ndarray:
    """A rotation about c turned to another axis: a, b, c take each other's places in a ring."""
    order = np.roll(np.arange(3), {"x": -1, "y": 1, "z": 0}[axis])
    turned = np.zeros((3, 3), dtype=int)
    turned[np.ix_(order, order)] = matrix
    return turned


def generators(hall: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The generators of a Hall symbol, (rotation, translation in parts), its centring and origin shift included."""
    text = hall.strip().replace("−", "-").replace("=", '"').replace("^", "'")
    shift = np.zeros(3, dtype=int)
    if place := re.search(r"\(\s*(-?\d+)\s+(-?\d+)\s+(-?\d+)\s*\)$", text):
        shift = np.array([int(v) for v in place.groups()]) * (PARTS // 12)
        text = text[: place.start()].strip()
    head, *tokens = text.split() or [""]
    centre, letter = head.startswith("-"), head.lstrip("-").upper()
    if letter not in CENTRING or not tokens or head.count("-") > 1:
        raise SymmetryError(f"{hall!r} is no Hall symbol")
    one = np.eye(3, dtype=int)
    found = [(one, np.array(t)) for t in CENTRING[letter]] + ([(-one, np.zeros(3, dtype=int))] if centre else [])
    before, last = 0, "z"
    for number, token in enumerate(tokens):
        parts = _TOKEN.match(token.lower())
        if parts is None:
            raise SymmetryError(f"{token!r} is no part of a Hall symbol")
        improper, fold, axis, screw = parts[1] == "-", int(parts[2]), parts[4], parts[3] or parts[5]
        if not axis:
            axis = "z" if number == 0 or fold == 1 else "*" if fold == 3 else ("x" if before in (2, 4) else "'") if fold == 2 and number == 1 else ""
        if not axis or axis == "*" and fold != 3 or axis in DIAGONAL and fold != 2:
            raise SymmetryError(f"The axis of {token!r} in {hall!r} is not told")
        matrix = np.array(BODY) if axis == "*" else _about(DIAGONAL[axis], last) if axis in DIAGONAL else _about(ABOUT_C[fold], axis)
        move = np.array([SHIFTS[c] for c in parts[6]], dtype=int).reshape(-1, 3).sum(axis=0)
        if screw:
            if axis not in "xyz" or int(screw) >= fold:
                raise SymmetryError(f"{token!r} is no screw axis")
            move["xyz".index(axis)] += PARTS * int(screw) // fold
        found.append((-matrix if improper else matrix, move))
        before, last = fold, axis if axis in "xyz" else last
    return [(r, (t + shift - r @ shift) % PARTS) for r, t in found]


@lru_cache(maxsize=256)
def operations(hall: str) -> tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]:
    """All operations (rotation by rows, translation in parts) of a group, the identity first, without repeats."""
    steps = generators(hall)
    start = (tuple(np.eye(3, dtype=int).ravel().tolist()), (0, 0, 0))
    known, ahead = {start}, [start]
    while ahead:
        rotation, move = ahead.pop()
        r, t = np.array(rotation).reshape(3, 3), np.array(move)
        for own, shift in steps:
            made = (tuple((own @ r).ravel().tolist()), tuple(((own @ t + shift) % PARTS).tolist()))
            if made not in known:
                known.add(made)
                ahead.append(made)
        if len(known) > 192:
            raise SymmetryError(f"The generators of {hall!r} make no space group")
    return (start, *sorted(known - {start}, reverse=True))


def orbits(sites: DataFrame, hall: str, tolerance: float = 1e-5) -> DataFrame:
    """``sites`` with sa, sb, sc of each of their images in the cell, operation (its place in ``operations``) and multiplicity.

    An image within ``tolerance`` of an earlier one, in reduced coordinates and across the faces, is the
    same place.  Sites with null or without finite coordinates have no images and go.
    """
    group = operations(hall)
    turns, moves = np.array([r for r, _ in group], dtype=float).reshape(-1, 3, 3), np.array([t for _, t in group]) / PARTS
    block = max(1, (1 << 21) // len(group) ** 2)

    @F.pandas_udf("array<struct<operation:int,sa:double,sb:double,sc:double>>")
    def images(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            s = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            found: list[list[dict]] = []
            for at in range(0, len(s), block):
                own = np.einsum("gij,nj->ngi", turns, s[at : at + block]) + moves
                own -= np.floor(own)
                own[own >= 1] = 0.0
                first = np.ones(own.shape[:2], dtype=bool)
                for k in range(1, len(group)):
                    gap = np.abs(own[:, :k] - own[:, k : k + 1])
                    first[:, k] = ~(np.minimum(gap, 1 - gap) <= tolerance).all(axis=2).any(axis=1)
                found += [[{"operation": int(k), "sa": p[k, 0], "sb": p[k, 1], "sc": p[k, 2]} for k in np.flatnonzero(f)] for p, f in zip(own, first, strict=True)]
            yield pd.Series(found, dtype=object)

    finite = F.lit(True)
    for a in AXES:
        finite = finite & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))
    found = sites.where(finite).withColumn("_all", images(*[F.col(a).cast("double") for a in AXES]))
    found = found.withColumn("multiplicity", F.size("_all")).withColumn("_image", F.explode("_all"))
    return found.withColumns({**{a: F.col(f"_image.{a}") for a in AXES}, "operation": F.col("_image.operation")}).drop("_all", "_image")


# --- displacement tensors --------------------------------------------------------------------------


def _transformed(u: list[Column], matrix: np.ndarray) -> list[Column]:
    """M U M^T of a symmetric tensor given by its six components xx, yy, zz, xy, xz, yz."""
    at = {p: u[n] for n, p in enumerate(TENSOR)} | {(j, i): u[n] for n, (i, j) in enumerate(TENSOR)}
    term = lambda i, j: sum((at[p, q] * float(matrix[i, p] * matrix[j, q]) for p in range(3) for q in range(3)), F.lit(0.0))
    return [term(i, j) for i, j in TENSOR]


def _basis(cell: Cell) -> np.ndarray:
    return cell.matrix.T * np.linalg.norm(np.linalg.inv(cell.matrix), axis=0)


def cartesian_tensor(u: list[Column], cell: Cell) -> list[Column]:
    """Cartesian components of a tensor given along the cell's vectors in units of the reciprocal lengths."""
    return _transformed(u, _basis(cell))


def cell_tensor(u: list[Column], cell: Cell) -> list[Column]:
    return _transformed(u, np.linalg.inv(_basis(cell)))


def rotated_tensor(u: list[Column], operation: int, hall: str, cell: Cell) -> list[Column]:
    """A Cartesian tensor at the image of its site under an operation of the group."""
    r = np.array(operations(hall)[operation][0], dtype=float).reshape(3, 3)
    h = cell.matrix.T
    return _transformed(u, h @ r @ np.linalg.inv(h))


def probability_scale(probability: float) -> float:
    """How many standard deviations an ellipsoid reaches that holds an atom with this probability."""
    if not 0.01 <= probability <= 0.99:
        raise ValueError("The probability must be between 1 % and 99 %")
    low, high = 0.0, 8.0
    for _ in range(80):
        x = (low + high) / 2
        if math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) * x * math.exp(-x * x / 2) < probability:
            low = x
        else:
            high = x
    return (low + high) / 2


def ellipsoids(rows: DataFrame, names: list[str], probability: float = 0.5) -> DataFrame:
    """``rows`` with radii (ascending) and axes (nine numbers, unit vectors as rows, in their order) and valid.

    ``names`` are the six Cartesian components.  A tensor that is null, not finite or has an eigenvalue
    below zero by more than rounding is an error; a flat one is not valid and has no radii or axes.
    """
    scale = probability_scale(probability)

    @F.pandas_udf("radii array<double>, axes array<double>, valid boolean")
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            u = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            if not np.isfinite(u).all():
                raise ValueError("Displacement tensors need six finite components")
            values, vectors = np.linalg.eigh(u[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3))
            size = np.abs(u).max(axis=1, initial=0.0)
            if (values[:, 0] < -1e-10 * size).any():
                raise ValueError("A displacement tensor has a negative eigenvalue")
            valid = values[:, 0] > 1e-15 * size
            radii, axes = np.sqrt(np.maximum(values, 0)) * scale, vectors.transpose(0, 2, 1).reshape(-1, 9)
            yield pd.DataFrame({"radii": [list(r) if v else None for r, v in zip(radii, valid, strict=True)], "axes": [list(a) if v else None for a, v in zip(axes, valid, strict=True)], "valid": valid})

    return rows.withColumn("_e", solve(*[F.col(n).cast("double") for n in names])).select(*rows.columns, "_e.radii", "_e.axes", "_e.valid")
