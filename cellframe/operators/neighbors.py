"""Neighbors under periodic boundaries: all pairs within a cutoff, and the k nearest.

Pairs are found block by block (see ``blocks``): one shuffle brings every atom's surroundings together,
periodic images included, so any shape of cell and any number of images is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.model import Cell
from cellframe.operators.blocks import Block, blocks, in_blocks, largest_frame, parts_of, ranked
from cellframe.plans.lineage import cut

PAIR = "frame_index int, i long, j long, dx double, dy double, dz double, d2 double, na int, nb int, nc int"


def pairs(atoms: DataFrame, cell: Cell, cutoff: float, centres: DataFrame | None = None) -> DataFrame:
    """Directed pairs within ``cutoff``: frame_index, i, j, dx, dy, dz, d2 and the image na, nb, nc of j.

    All periodic images count, an atom's own included; an atom does not meet itself.  ``atoms`` has
    frame_index, row_idx and wrapped sa, sb, sc; ``centres`` are the rows that i runs over.
    """

    def each(block: Block) -> Iterator[dict[str, np.ndarray]]:
        for i, j, vectors, d2 in block.pairs(cutoff):
            yield pair_columns(block, i, j, vectors, d2)

    return in_surroundings(atoms, cell, cutoff, each, PAIR, centres)


def pair_columns(block: Block, i: np.ndarray, j: np.ndarray, vectors: np.ndarray, d2: np.ndarray) -> dict[str, np.ndarray]:
    found = {"i": block.rows[i], "j": block.rows[j], "dx": vectors[:, 0], "dy": vectors[:, 1], "dz": vectors[:, 2], "d2": d2}
    return found | {n: block.shift[j, k].astype(np.int32) for k, n in enumerate(("na", "nb", "nc"))}


def in_surroundings(atoms: DataFrame, cell: Cell, cutoff: float, each: Callable, schema: str, centres: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """What ``each`` makes of the blocks whose halo is ``cutoff`` wide; blocks carry the columns ``also``."""
    if not cutoff > 0 or not math.isfinite(cutoff):
        raise ValueError("The cutoff must be positive")
    return in_blocks(blocks(atoms, cell, cutoff, parts_of(cell, cutoff, largest_frame(atoms)), centres, also), cell, each, schema)


#: The total order of neighbors: distance, then row, then vector.
ORDER = ("d2", "j", "dx", "dy", "dz")


def distinct_pairs(found: DataFrame) -> DataFrame:
    """Of directed pairs the nearest image of each other atom."""
    other = found.where("i <> j")
    return other.groupBy("frame_index", "i", "j").agg(F.min(F.struct("d2", "dx", "dy", "dz")).alias("p")).select("frame_index", "i", "j", "p.*")


#: How much further the next look goes, within a block and with a wider halo.
GROWTH, WIDER = 1.5, 2.0
#: How many radii a block of nearest neighbors is wide at most, at first, where looks are short and halos cost more, and for the few that are left.
BROAD, NARROW = 8.0, 2.0


def of_nearest(atoms: DataFrame, cell: Cell, k: int, each: Callable, schema: str, radius: float | None = None, centres: DataFrame | None = None, also: tuple[str, ...] = (), strange: bool = False) -> DataFrame:
    """What ``each`` makes of the ``k`` nearest images of each atom (or of each of the ``centres``; ``strange`` ones are not among the atoms).

    ``each`` gets a block, places of centres, of their neighbors (centres, k), vectors (centres, k, 3),
    squared lengths and the number of neighbors, which is less than k only without periodic axes in
    frames of k or fewer atoms; places beyond it are -1, lengths infinite.  Atoms that find fewer than k
    within a block's halo are asked again with a wider one.
    """
    most = largest_frame(atoms)
    if not most:
        return atoms.sparkSession.createDataFrame([], schema)
    if radius is None:
        radius = 2.5 * (cell.volume * max(k, 1) / most) ** (1 / 3)
    open_cell = not any(cell.pbc)
    names = [part.split()[0] for part in schema.split(", ")]
    parts: list[DataFrame] = []
    while True:

        def run(block: Block, radius=radius) -> Iterator[dict[str, np.ndarray]]:
            todo, reach = block.centres, radius / GROWTH**4
            while len(todo):
                left = []
                for i, j, vectors, d2 in block.pairs(reach, todo):
                    order, rank = ranked(block, i, j, vectors, d2)
                    order = order[rank <= k]
                    own, have = np.unique(i[order], return_counts=True)
                    full = np.ones(len(own), dtype=bool) if reach >= radius else have >= k
                    left.append(own[full])
                    if full.any():
                        row = np.repeat(np.arange(len(own)), have)
                        at = np.arange(len(order)) - np.repeat(np.cumsum(have) - have, have)
                        places, far, steps = np.full((len(own), k), -1), np.full((len(own), k), np.inf), np.zeros((len(own), k, 3))
                        places[row, at], far[row, at], steps[row, at] = j[order], d2[order], vectors[order]
                        found = each(block, own[full], places[full], steps[full], far[full], have[full])
                        n = len(next(iter(found.values())))
                        yield found | {"_short": np.full(n, -1, dtype=np.int64), "_have": np.zeros(n, dtype=np.int64)}
                        few = own[full][have[full] < k]
                        yield _short(block, few, have[full][have[full] < k], found)
                done = np.concatenate([*left, np.zeros(0, dtype=todo.dtype)])
                todo = np.setdiff1d(todo, done)
                if reach >= radius:
                    if len(todo):  # without any neighbor
                        none = np.zeros(len(todo), dtype=np.int64)
                        found = each(block, todo, np.full((len(todo), k), -1), np.zeros((len(todo), k, 3)), np.full((len(todo), k), np.inf), none)
                        n = len(next(iter(found.values())))
                        yield found | {"_short": np.full(n, -1, dtype=np.int64), "_have": np.zeros(n, dtype=np.int64)}
                        yield _short(block, todo, none, found)
                    break
                reach = min(radius, reach * GROWTH)

        halo = blocks(atoms, cell, radius, parts_of(cell, radius, most, NARROW if parts else BROAD), centres, also)
        found = cut(in_blocks(halo, cell, run, f"{schema}, _short long, _have long"))
        short = found.where("_short >= 0").select("frame_index", F.col("_short").alias("row_idx"), "_have")
        if open_cell:
            sizes = atoms.groupBy("frame_index").agg(F.count("*").alias("_n"))
            short = short.join(sizes, "frame_index").where(F.col("_have") < F.least(F.lit(k), F.col("_n") - (0 if strange else 1)))
        key = F.col(names[1]).alias("row_idx")
        if not short.limit(1).count():
            parts.append(found.where("_short < 0").select(*names))
            break
        again = cut(short.select("frame_index", "row_idx"))
        parts.append(found.where("_short < 0").select(*names).join(again.select("frame_index", F.col("row_idx").alias(names[1])), ["frame_index", names[1]], "left_anti").select(*names))
        centres, radius = cut((atoms if centres is None else centres).join(again, ["frame_index", "row_idx"], "left_semi")), radius * WIDER
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _short(block: Block, few: np.ndarray, have: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows that name the centres with fewer neighbors than asked for."""
    empty = {name: pa.nulls(len(few), values.type) if isinstance(values, pa.Array) else np.zeros(len(few), dtype=values.dtype) for name, values in like.items()}
    return empty | {"_short": block.rows[few], "_have": have.astype(np.int64)}


def nearest(atoms: DataFrame, cell: Cell, k: int, radius: float | None = None, centres: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest images of each atom (or of each of the ``centres``), ranked: pairs with rank from 1."""

    def each(block: Block, own: np.ndarray, places: np.ndarray, vectors: np.ndarray, d2: np.ndarray, have: np.ndarray) -> dict[str, np.ndarray]:
        c, at = np.nonzero(places >= 0)
        return pair_columns(block, own[c], places[c, at], vectors[c, at], d2[c, at]) | {"rank": (at + 1).astype(np.int32)}

    return of_nearest(atoms, cell, k, each, PAIR + ", rank int", radius, centres)
