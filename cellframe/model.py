"""Frames of particles: one row per atom, one row per frame with its cell.

``atoms`` has frame_index, row_idx, atom_id, type_label, sa, sb, sc (reduced coordinates), x, y, z and
any number of double properties.  ``frames`` has frame_index, origin, h (nine numbers, cell vectors
as rows), pbc (three booleans) and further scalars.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A cell of less volume is no cell.
LEAST_VOLUME = 1e-12
AXES = ("sa", "sb", "sc")


@dataclass(frozen=True)
class Cell:
    """Origin, cell vectors as rows, periodic axes."""

    h: tuple[float, ...]
    pbc: tuple[bool, bool, bool] = (True, True, True)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    matrix: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        matrix = np.array(self.h, dtype=float).reshape(3, 3)
        if not np.isfinite(matrix).all() or abs(np.linalg.det(matrix)) < LEAST_VOLUME:
            raise ValueError("The cell vectors must be finite and span a volume")
        object.__setattr__(self, "matrix", matrix)

    @classmethod
    def cube(cls, length: float, pbc: tuple[bool, bool, bool] = (True, True, True)) -> "Cell":
        return cls((length, 0, 0, 0, length, 0, 0, 0, length), pbc)

    @property
    def volume(self) -> float:
        return abs(float(np.linalg.det(self.matrix)))

    @property
    def heights(self) -> np.ndarray:
        """Distances between the opposite faces."""
        a, b, c = self.matrix
        return self.volume / np.array([np.linalg.norm(np.cross(b, c)), np.linalg.norm(np.cross(c, a)), np.linalg.norm(np.cross(a, b))])

    @property
    def lengths(self) -> np.ndarray:
        return np.linalg.norm(self.matrix, axis=1)

    @property
    def orthogonal(self) -> bool:
        return bool(np.allclose(self.matrix @ self.matrix.T, np.diag(self.lengths**2), atol=1e-9 * float(self.lengths.max()) ** 2))

    def cartesian(self, s: tuple[Column, Column, Column], placed: bool = True) -> tuple[Column, ...]:
        """Columns of origin + s H, or of s H alone for differences."""
        return tuple(sum((s[k] * F.lit(float(self.matrix[k, i])) for k in range(3)), F.lit(float(self.origin[i]) if placed else 0.0)) for i in range(3))

    def reduced(self, r: tuple[Column, Column, Column], placed: bool = True) -> tuple[Column, ...]:
        inverse = np.linalg.inv(self.matrix)
        moved = [r[k] - float(self.origin[k]) if placed else r[k] for k in range(3)]
        return tuple(sum((moved[k] * F.lit(float(inverse[k, i])) for k in range(3)), F.lit(0.0)) for i in range(3))


def wrapped(s: Column) -> Column:
    return s - F.floor(s)


def with_positions(atoms: DataFrame, cell: Cell) -> DataFrame:
    """Wraps the periodic reduced coordinates and adds x, y, z."""
    for axis, periodic in zip(AXES, cell.pbc, strict=True):
        if periodic:
            atoms = atoms.withColumn(axis, wrapped(F.col(axis)))
    x, y, z = cell.cartesian(tuple(F.col(a) for a in AXES))
    return atoms.withColumn("x", x).withColumn("y", y).withColumn("z", z)


def frame_row(cell: Cell, frame_index: int = 0, **scalars: object) -> dict:
    return {"frame_index": frame_index, "origin": [float(v) for v in cell.origin], "h": [float(v) for v in cell.h], "pbc": list(cell.pbc), **scalars}


#: Sites of the ideal lattices in the cubic cell.
BASIS = {
    "sc": [(0, 0, 0)],
    "bcc": [(0, 0, 0), (0.5, 0.5, 0.5)],
    "fcc": [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0)],
    "diamond": [(0, 0, 0), (0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0), (0.25, 0.25, 0.25), (0.25, 0.75, 0.75), (0.75, 0.25, 0.75), (0.75, 0.75, 0.25)],
}


def crystal(spark: SparkSession, kind: str = "fcc", repeat: int = 3, lattice: float = 4.0, frame_index: int = 0) -> tuple[DataFrame, Cell]:
    """An ideal crystal of ``repeat`` cubed cells, made by Spark."""
    n = repeat**3
    sites = spark.range(n * len(BASIS[kind]))
    cell_no, site = F.floor(F.col("id") / len(BASIS[kind])), F.pmod("id", F.lit(len(BASIS[kind]))).cast("int")
    basis = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in BASIS[kind]])
    own = [F.element_at(F.element_at(basis, site + 1), i + 1) for i in range(3)]
    index = [cell_no % repeat, F.floor(cell_no / repeat) % repeat, F.floor(cell_no / repeat**2)]
    s = [((own[i] + index[i]) / repeat).alias(AXES[i]) for i in range(3)]
    atoms = sites.select(F.lit(frame_index).alias("frame_index"), F.col("id").alias("row_idx"), (F.col("id") + 1).cast("string").alias("atom_id"), F.lit("A").alias("type_label"), *s)
    cell = Cell.cube(repeat * lattice)
    return with_positions(atoms, cell), cell


def lattice_cell(kind: str) -> tuple[tuple[float, float, float], list[tuple[float, float, float]]]:
    """Edges in units of the nearest distance and sites in reduced coordinates of an orthogonal cell; ``icosahedra`` are clusters of thirteen, apart from each other."""
    third, root3, golden = 1 / 3, 3**0.5, (1 + 5**0.5) / 2
    packed = [(0.0, 0.0, 0.0), (0.5, 0.5, 0.0), (0.5, 0.5 + third, 0.5), (0.0, third, 0.5)]
    if kind in BASIS:
        edge = {"sc": 1.0, "bcc": 2 / root3, "fcc": 2**0.5, "diamond": 4 / root3}[kind]
        return (edge, edge, edge), BASIS[kind]
    if kind == "hcp":
        return (1.0, root3, (8 / 3) ** 0.5), packed
    if kind == "hex_diamond":
        edge = (8 / 3) ** 0.5
        return (edge, edge * root3, 8 / 3), packed + [(x, y, z + 0.375) for x, y, z in packed]
    if kind == "graphene":
        return (root3, 3.0, 2.4), [(0.0, 0.0, 0.0), (0.5, 0.5, 0.0), (0.0, third, 0.0), (0.5, 0.5 + third, 0.0)]
    if kind == "icosahedra":
        size = 4 * (1 + golden**2) ** 0.5  # corners at a distance of 1 from the centre, in a cell of four
        corners = [p[k:] + p[:k] for p in [(0.0, a, b * golden) for a in (1, -1) for b in (1, -1)] for k in range(3)]
        return (4.0, 4.0, 4.0), [(0.5, 0.5, 0.5)] + [tuple(0.5 + x / size for x in p) for p in corners]
    raise ValueError(f"No lattice {kind}")


#: The lattices of ``lattice_cell`` in the order of their kinds in template matching.
LATTICES = ("fcc", "hcp", "bcc", "icosahedra", "sc", "diamond", "hex_diamond", "graphene")
