"""What every structure reader yields: a frame's cell and scalars, and its atoms as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from cellframe.model import Cell


class FormatError(ValueError):
    """A file that breaks its format's rules."""


@dataclass
class Frame:
    """One parsed frame; ``raw`` are reduced coordinates as written, not yet wrapped."""

    cell: Cell
    raw: np.ndarray
    labels: list[str]
    ids: list[str] | None = None
    timestep: int | None = None
    time: float | None = None
    properties: dict[str, np.ndarray] = field(default_factory=dict)
    images: np.ndarray | None = None

    def atoms(self) -> dict[str, np.ndarray | list]:
        """Columns of the atoms: wrapped coordinates, images and properties."""
        periodic = np.array(self.cell.pbc)
        image = np.where(periodic, np.floor(self.raw), 0.0)
        s = self.raw - image
        image = image.astype(np.int32) + (self.images if self.images is not None else 0)
        r = s @ self.cell.matrix + np.array(self.cell.origin)
        n = len(s)
        out: dict[str, np.ndarray | list] = {"row_idx": np.arange(n), "atom_id": self.ids or [str(k + 1) for k in range(n)], "type_label": self.labels}
        out |= {c: s[:, k] for k, c in enumerate(("sa", "sb", "sc"))} | {c: r[:, k] for k, c in enumerate("xyz")} | {c: image[:, k] for k, c in enumerate(("ix", "iy", "iz"))}
        return out | self.properties


def number(word: str) -> float:
    """A number as the formats write it: Fortran's d exponents included."""
    try:
        return float(word)
    except ValueError:
        try:
            return float(word.lower().replace("d", "e"))
        except ValueError:
            raise FormatError(f"{word!r} is no number") from None


def finite(values: np.ndarray, what: str) -> np.ndarray:
    if not np.isfinite(values).all():
        raise FormatError(f"{what} must be finite")
    return values


def reduced(positions: np.ndarray, cell: Cell) -> np.ndarray:
    return (positions - np.array(cell.origin)) @ np.linalg.inv(cell.matrix)


def padded_cell(positions: np.ndarray) -> Cell:
    """An open box around positions without a cell: at least half a unit or a fortieth of the extent to each side."""
    low, high = positions.min(axis=0), positions.max(axis=0)
    pad = np.maximum(0.5, 0.025 * (high - low))
    size = high - low + 2 * pad
    return Cell(tuple(np.diag(size).ravel()), (False, False, False), tuple(low - pad))


def cell_of_lengths(a: float, b: float, c: float, alpha: float, beta: float, gamma: float, pbc: tuple[bool, bool, bool] = (True, True, True)) -> Cell:
    """The lower-triangular cell of lengths and angles in degrees."""
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    cy = (ca - cb * cg) / sg
    return Cell((a, 0, 0, b * cg, b * sg, 0, c * cb, c * cy, c * math.sqrt(max(0.0, 1 - cb * cb - cy * cy))), pbc)


def uniform(rows: list[list[str]], width: int, what: str) -> list[list[str]]:
    for k, row in enumerate(rows):
        if len(row) != width:
            raise FormatError(f"{what}, row {k + 1}: {len(row)} columns instead of {width}")
    return rows
