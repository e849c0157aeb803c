"""Blocks of space with a halo: each atom's neighborhood lies within one task after one shuffle.

The cell is cut into blocks a few cutoffs wide.  An atom goes to its own block and, as a copy, to every
block that has it or one of its periodic images within the cutoff; only atoms near a block's faces have
copies.  Whatever is asked of an atom's neighbors is then answered where its block lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.model import AXES, Cell

#: Room for rounding in reduced coordinates.
SLACK = 1e-9
#: Atoms that a block should hold, and how many cutoffs it is wide at most.
AIM, WIDEST = 4096, 4.0
#: Blocks that hold centres up to which their numbers are sent to all tasks, so that other blocks get no atoms.
FEW = 100_000
#: Candidate pairs that are held at once.
CANDIDATES = 1 << 20
#: Bins to a cutoff where they are full, candidates of a bin's centres from which on they are, and those held at once.
FINER, FULL, TILE = 2, 1 << 14, 1 << 19
#: Candidate pairs of a block from which on its centres are dealt to several tasks.
HOT = 1 << 29
#: Atoms of a box that are tried first for a link to another box.
TRIED = 16
#: Parts of a histogram's bin; pairs in the first and last one of a bin are measured exactly.
FINE = 4096
SHIFTS = ("na", "nb", "nc")
KEYS = ("frame_index", "block", "deal")
#: Roles of a row in a block: a neighbor only, a centre that is a neighbor too, a centre only.
NEIGHBOR, BOTH, CENTRE = 0, 1, 2


def largest_frame(atoms: DataFrame) -> int:
    """Atoms of the frame that has most."""
    return int(atoms.groupBy("frame_index").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)


def parts_of(cell: Cell, cutoff: float, most: int, widest: float = WIDEST) -> list[int]:
    """Blocks along each axis for frames of ``most`` atoms."""
    reach = cutoff / cell.heights
    wide = min(widest, max(1.0, (AIM / max(most * float(np.prod(reach)), 1e-300)) ** (1 / 3)))
    return [max(1, min(1024, int(1 / min(1.0, wide * float(r))))) for r in reach]


def _spread(atoms: DataFrame, cell: Cell, parts: list[int], reach: np.ndarray | None) -> DataFrame:
    """Rows with their block and image: in all blocks whose halo holds them, or in their own alone."""
    number = F.lit(0).cast("long")
    for axis, shift, periodic, n, k in zip(AXES, SHIFTS, cell.pbc, parts, range(3), strict=True):
        s = F.col(axis)
        inside = lambda b, n=n: F.least(F.greatest(b, F.lit(0)), F.lit(n - 1)).cast("int")
        own = inside(F.floor(s * n))
        if reach is None:
            atoms = atoms.withColumn(f"_{k}", own).withColumn(shift, F.lit(0))
        else:
            far = float(reach[k]) + SLACK
            low, high = F.ceil((s - far) * n - 1).cast("int"), F.floor((s + far) * n).cast("int")
            if not periodic:
                low, high = inside(low), inside(high)
            atoms = atoms.withColumn(f"_own{k}", own).withColumn(f"_{k}", F.explode(F.sequence(low, high)))
            image = -F.floor(F.col(f"_{k}") / n).cast("int") if periodic else F.lit(0)
            atoms = atoms.withColumn(shift, image).withColumn(f"_home{k}", F.col(f"_{k}") == F.col(f"_own{k}"))
            atoms = atoms.withColumn(f"_{k}", F.pmod(f"_{k}", F.lit(n))).withColumn(axis, s + F.col(shift))
        number = number * n + F.col(f"_{k}")
    return atoms.withColumn("block", number)


def blocks(atoms: DataFrame, cell: Cell, cutoff: float, parts: list[int], centres: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """frame_index, block, deal, role, row_idx, sa, sb, sc, na, nb, nc and the columns ``also``, dealt and sorted by block."""
    columns = ["frame_index", "row_idx", *AXES, *also]
    copies = _spread(atoms.select(*columns), cell, parts, cutoff / cell.heights)
    if centres is None:
        home = F.col("_home0") & F.col("_home1") & F.col("_home2")
        copies = copies.withColumn("role", F.when(home, BOTH).otherwise(NEIGHBOR))
    else:
        own = _spread(centres.select(*columns), cell, parts, None).withColumn("role", F.lit(CENTRE))
        copies = copies.withColumn("role", F.lit(NEIGHBOR))
        asked = own.select("frame_index", "block").distinct()
        if asked.limit(FEW + 1).count() <= FEW:
            copies = copies.join(F.broadcast(asked), ["frame_index", "block"], "left_semi")
    names = ["frame_index", "block", "role", "row_idx", *AXES, *SHIFTS, *also]
    rows = copies.select(*names) if centres is None else copies.select(*names).unionByName(own.select(*names))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, hot = _dealt(rows)
    return dealt.repartition(max(tasks, hot), *KEYS).sortWithinPartitions(*KEYS)


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with their deal, and how many deals hot blocks have: the centres of a block of very many pairs go to several tasks, its neighbors to each of them."""
    sizes = rows.groupBy("frame_index", "block").agg(F.count("*").alias("n"), F.count_if(F.col("role") != NEIGHBOR).alias("c"))
    hot = sizes.select("frame_index", "block", F.least(F.col("c"), F.ceil(F.col("c").cast("double") * F.col("n") / HOT)).cast("int").alias("_deals")).where("_deals > 1")
    found = hot.collect()  # blocks of 23,000 atoms or more
    if not found:
        return rows.select("frame_index", "block", F.lit(0).alias("deal"), *rows.columns[2:]), 0
    hot = rows.sparkSession.createDataFrame([tuple(r) for r in found], "frame_index int, block long, _deals int")
    dealt = rows.join(F.broadcast(hot), ["frame_index", "block"], "left").withColumn("_deals", F.coalesce("_deals", F.lit(1)))
    dealt = dealt.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)))
    own = F.col("deal") == F.pmod(F.xxhash64("row_idx"), F.col("_deals"))
    dealt = dealt.where((F.col("role") != CENTRE) | own).withColumn("role", F.when((F.col("role") == BOTH) & ~own, NEIGHBOR).otherwise(F.col("role")))
    return dealt.select(*KEYS, *rows.columns[2:]), sum(r["_deals"] for r in found)


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows that agree in the first ``keys`` columns, each as one batch."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        named = [batch.column(k).to_numpy() for k in range(keys)]
        changes = np.flatnonzero(np.any([np.diff(c) != 0 for c in named], axis=0)) + 1
        for a, b in zip([0, *changes], [*changes, len(batch)], strict=True):
            own = tuple(c[a] for c in named)
            if held and own != at:
                yield pa.concat_batches(held)
                held = []
            at = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


@dataclass
class Block:
    """One block's rows: numbers, reduced coordinates and images of atoms, and the places of the centres."""

    frame: int
    rows: np.ndarray
    s: np.ndarray
    shift: np.ndarray
    centres: np.ndarray
    neighbor: np.ndarray
    also: dict[str, pa.Array]
    cell: Cell

    @classmethod
    def of(cls, batch: pa.RecordBatch, cell: Cell) -> "Block":
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        role = columns["role"].to_numpy()
        s = np.column_stack([columns[a].to_numpy() for a in AXES])
        shift = np.column_stack([columns[a].to_numpy() for a in SHIFTS])
        also = {n: c for n, c in columns.items() if n not in ("frame_index", "block", "deal", "role", "row_idx", *AXES, *SHIFTS)}
        return cls(columns["frame_index"][0].as_py(), columns["row_idx"].to_numpy(), s, shift, np.flatnonzero(role != NEIGHBOR), np.flatnonzero(role != CENTRE), also, cell)

    def pairs(self, cutoff: float, centres: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Places i (in runs) and j, vectors and squared lengths of the pairs within the cutoff, some centres at a time."""
        centres = self.centres if centres is None else centres
        if not len(centres) or not len(self.neighbor):
            return
        tiles = self.tiles(cutoff, centres)
        if tiles is not None:
            for i, j, rough, band in tiles:
                a, b = np.nonzero(rough <= cutoff**2 + band)
                yield self._within(cutoff, i[a], j[b])
            return
        width = cutoff / self.cell.heights * (1 + SLACK)
        bins = np.floor(self.s / width).astype(np.int64)
        bins -= bins.min(axis=0) - 1
        size = bins.max(axis=0) + 2
        keys = (bins[:, 0] * size[1] + bins[:, 1]) * size[2] + bins[:, 2]
        order = self.neighbor[np.argsort(keys[self.neighbor], kind="stable")]
        sorted_keys = keys[order]
        beside = np.array([a * size[1] + b for a in (-1, 0, 1) for b in (-1, 0, 1)]) * size[2]
        rows = keys[centres][:, None] + beside
        first, end = np.searchsorted(sorted_keys, rows - 1), np.searchsorted(sorted_keys, rows + 1, side="right")
        counts = end - first
        upto = np.cumsum(counts.sum(axis=1))
        at = 0
        while at < len(centres):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
            own = counts[at:stop].ravel()
            ends = np.cumsum(own)
            place = np.repeat(first[at:stop].ravel() - ends + own, own) + np.arange(int(ends[-1]))
            yield self._within(cutoff, np.repeat(centres[at:stop], counts[at:stop].sum(axis=1)), order[place])
            at = stop

    def _within(self, cutoff: float, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of candidates those within the cutoff, without an atom and itself."""
        vectors = (self.s[j] - self.s[i]) @ self.cell.matrix
        d2 = (vectors**2).sum(axis=1)
        near = np.flatnonzero(d2 <= cutoff**2)
        near = near[~((self.rows[i[near]] == self.rows[j[near]]) & (self.shift[j[near]] == 0).all(axis=1))]
        return i[near], j[near], vectors[near], d2[near]

    def tiles(self, cutoff: float, centres: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]] | None:
        """Centres i, all that may be within the cutoff of them j, squared distances (i, j) and how far these may be off; None where bins are not full.

        The centres of a bin have the same candidates, so their distances are one product of matrices.
        """
        centres = self.centres if centres is None else centres
        if not len(centres) or not len(self.neighbor):
            return None
        bins = np.floor(self.s / (cutoff / self.cell.heights * (1 + SLACK) / FINER)).astype(np.int64)
        bins -= bins.min(axis=0) - FINER
        size = bins.max(axis=0) + FINER + 1
        keys = (bins[:, 0] * size[1] + bins[:, 1]) * size[2] + bins[:, 2]
        order = self.neighbor[np.argsort(keys[self.neighbor], kind="stable")]
        centres = centres[np.argsort(keys[centres], kind="stable")]
        own, starts = np.unique(keys[centres], return_index=True)
        steps = range(-FINER, FINER + 1)
        rows = own[:, None] + np.array([a * size[1] + b for a in steps for b in steps]) * size[2]
        first, end = np.searchsorted(keys[order], rows - FINER), np.searchsorted(keys[order], rows + FINER, side="right")
        candidates, starts = (end - first).sum(axis=1), np.append(starts, len(centres))
        if (np.diff(starts) * candidates).sum() < FULL * len(own):
            return None
        place = (self.s - self.s.mean(axis=0)) @ self.cell.matrix
        square = (place**2).sum(axis=1)
        left = np.column_stack([place, np.ones(len(place)), square])
        right = np.column_stack([-2 * place, square, np.ones(len(place))])[order]

        def each() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
            band = 1e-9 * cutoff**2 + 1e-13 * float(square.max())
            for k in range(len(own)):
                runs = [slice(a, b) for a, b in zip(first[k], end[k], strict=True) if a < b]
                if not runs:
                    continue
                j, beside = np.concatenate([order[r] for r in runs]), np.concatenate([right[r] for r in runs]).T
                step = max(1, TILE // len(j))
                for at in range(starts[k], starts[k + 1], step):
                    i = centres[at : min(at + step, starts[k + 1])]
                    yield i, j, left[i] @ beside, band

        return each()

    def single(self, cutoff: float) -> bool:
        """Whether no atom has two images within the cutoff of one, nor one of itself, and no number repeats."""
        heights = self.cell.heights[list(self.cell.pbc)]
        if len(heights) and 2 * cutoff * (1 + SLACK) >= heights.min():
            return len(np.unique(self.rows[self.neighbor])) == len(self.neighbor)
        rows, shift = self.rows[self.neighbor], self.shift[self.neighbor]
        order = np.lexsort((*shift.T, rows))
        return not ((np.diff(rows[order]) == 0) & (np.diff(shift[order], axis=0) == 0).all(axis=1)).any()

    def boxes(self, cutoff: float, places: np.ndarray) -> tuple[np.ndarray, float]:
        """Of places their boxes, in whole numbers, and how many boxes the cutoff reaches; atoms of one box lie within the cutoff."""
        edge = cutoff / self.cell.heights
        corners = np.array([[1, b, c] for b in (-1, 1) for c in (-1, 1)]) * edge
        scale = cutoff * (1 - SLACK) / np.sqrt(((corners @ self.cell.matrix) ** 2).sum(axis=1).max())
        at = np.floor(self.s[places] / (edge * scale)).astype(np.int64)
        return at - at.min(axis=0), 1 / scale

    def joined(self, cutoff: float) -> np.ndarray:
        """Of each place a label that it shares with what chains of pairs within the cutoff, whose one end is a centre, connect it with.

        Atoms of one box hang together, so chains are looked for between boxes alone, the nearest first, and only
        between boxes that nothing has connected yet: no table of pairs is made.
        """
        sound = np.flatnonzero(np.isfinite(self.s).all(axis=1))
        label = np.arange(len(self.rows)) + len(self.rows)  # what lies nowhere is alone
        if not len(sound) or not len(self.centres):
            return label
        at, steps = self.boxes(cutoff, sound)
        reach = int(np.ceil(steps))
        at = at + reach
        size = at.max(axis=0) + reach + 1
        keys = (at[:, 0] * size[1] + at[:, 1]) * size[2] + at[:, 2]
        order = np.argsort(keys, kind="stable")
        boxes, first, box = np.unique(keys[order], return_index=True, return_inverse=True)
        end = np.append(first[1:], len(order))
        of = np.empty(len(keys), dtype=np.int64)
        of[order] = box
        role = np.zeros(len(self.rows), dtype=bool)
        role[self.centres] = True
        asks = np.zeros(len(boxes), dtype=bool)
        asks[of[role[sound]]] = True
        place = (self.s[sound] @ self.cell.matrix)[order]
        own = np.arange(len(boxes))
        spans = range(-reach, reach + 1)
        ahead = [(a, b, c) for a in spans for b in spans for c in spans if (a, b, c) > (0, 0, 0)]
        for step in sorted(ahead, key=lambda n: sum(x * x for x in n)):
            move = (step[0] * size[1] + step[1]) * size[2] + step[2]
            there = np.minimum(np.searchsorted(boxes, boxes + move), len(boxes) - 1)
            a = np.flatnonzero(boxes[there] == boxes + move)
            b = there[a]
            for most in (TRIED, None):
                open_ = (own[a] != own[b]) & (asks[a] | asks[b])
                a, b = a[open_], b[open_]
                if not len(a):
                    break
                met = _meet(place, cutoff, first[a], end[a], first[b], end[b], most)
                own = _merged(own, a[met], b[met])
        label[sound] = own[of]
        return label

    def met(self, cutoff: float) -> np.ndarray:
        """Whether each of the centres has a neighbor within the cutoff; a box that holds a neighbor answers for all of its centres."""
        found, asks = np.zeros((2, len(self.rows)), dtype=bool)
        asks[self.centres] = True
        sound = np.flatnonzero(np.isfinite(self.s).all(axis=1))
        if not len(self.centres) or not len(self.neighbor) or not len(sound):
            return found[self.centres]
        _, box = np.unique(self.boxes(cutoff, sound)[0], axis=0, return_inverse=True)
        box, near = box.ravel(), np.isin(sound, self.neighbor)
        held = np.zeros(len(sound), dtype=bool)
        held[box[near]] = True
        found[sound] = held[box] & asks[sound]
        for i, *_ in self.pairs(cutoff, self.centres[~found[self.centres]]):
            found[i] = True
        return found[self.centres]

    def counts(self, cutoff: float) -> np.ndarray:
        """How many pairs within the cutoff each place has."""
        counts = np.zeros(len(self.rows), dtype=np.int64)
        tiles = self.tiles(cutoff)
        if tiles is None:
            for i, *_ in self.pairs(cutoff):
                counts += np.bincount(i, minlength=len(counts))
            return counts
        for i, j, rough, band in tiles:
            sure = np.count_nonzero(rough <= cutoff**2 - band, axis=1)
            may = np.count_nonzero(rough <= cutoff**2 + band, axis=1)
            counts[i] += sure
            open_ = np.flatnonzero(may > sure)
            if len(open_):
                a, b = np.nonzero(np.abs(rough[open_] - cutoff**2) <= band)
                near, *_ = self._within(cutoff, i[open_[a]], j[b])
                counts += np.bincount(near, minlength=len(counts))
        counts[np.intersect1d(self.centres, self.neighbor)] -= 1  # itself
        return counts

    def histogram(self, cutoff: float, bins: int, centre_below: bool = False, also: Callable | None = None, target: np.ndarray | None = None) -> np.ndarray:
        """Pairs by length in ``bins`` of [0, cutoff) and those at the cutoff itself.

        ``target`` says which places count as j; with ``centre_below`` only pairs whose i is less than j, or an image ahead of itself, count;
        ``also`` picks from exactly measured pairs by d2, which must not concern lengths of a bin's ``FINE``-th part or more.
        """
        counts = np.zeros(bins + 1, dtype=np.int64)
        na, nb, nc = self.shift.T
        ahead = (na > 0) | (na == 0) & ((nb > 0) | (nb == 0) & (nc > 0))

        def exactly(i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> None:
            keep = np.ones(len(i), dtype=bool) if also is None else also(d2)
            if centre_below:
                keep &= (self.rows[i] < self.rows[j]) | (self.rows[i] == self.rows[j]) & ahead[j]
            if target is not None:
                keep &= target[j]
            at = np.floor(np.sqrt(d2[keep]) / cutoff * bins).astype(np.int64)
            np.add(counts, np.bincount(np.minimum(at, bins), minlength=bins + 1), out=counts)

        tiles = self.tiles(cutoff)
        if tiles is None:
            for i, j, _, d2 in self.pairs(cutoff):
                exactly(i, j, d2)
            return counts
        top = bins * FINE + 1
        edge = np.zeros(top + 1, dtype=bool)
        edge[0:top:FINE] = edge[FINE - 1 : top : FINE] = True
        fine = np.zeros(top + 1, dtype=np.int64)
        for i, j, rough, _ in tiles:
            if target is not None:
                rough, j = rough[:, target[j]], j[target[j]]
            parts = np.minimum(np.sqrt(np.maximum(rough, 0.0, out=rough), out=rough) * (bins * FINE / cutoff), top).astype(np.int64)
            a, b = np.nonzero(edge[parts])
            ii, jj, _, d2 = self._within(cutoff, i[a], j[b])
            exactly(ii, jj, d2)
            if centre_below:
                parts[~((self.rows[i][:, None] < self.rows[j]) | (self.rows[i][:, None] == self.rows[j]) & ahead[j])] = top
            fine += np.bincount(parts.ravel(), minlength=top + 1)
        fine[edge] = 0
        counts[:bins] += fine[: bins * FINE].reshape(bins, FINE).sum(axis=1)
        return counts


def _meet(place: np.ndarray, cutoff: float, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, most: int | None) -> np.ndarray:
    """Whether places a0 to a1 and b0 to b1 of each row hold a pair within the cutoff, or the ``most`` first of them do."""
    if most is not None:
        a1, b1 = np.minimum(a1, a0 + most), np.minimum(b1, b0 + most)
    n, m = a1 - a0, b1 - b0
    found = np.zeros(len(a0), dtype=bool)
    few = np.flatnonzero(n * m <= CANDIDATES)
    upto = np.cumsum(n[few] * m[few])
    at = 0
    while at < len(few):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
        own = few[at:stop]
        sizes = n[own] * m[own]
        starts = np.cumsum(sizes) - sizes
        k = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        wide = np.repeat(m[own], sizes)
        d = place[np.repeat(a0[own], sizes) + k // wide] - place[np.repeat(b0[own], sizes) + k % wide]
        found[own] = np.logical_or.reduceat((d**2).sum(axis=1) <= cutoff**2, starts)
        at = stop
    for k in np.flatnonzero(n * m > CANDIDATES):
        one, two = place[a0[k] : a1[k]], place[b0[k] : b1[k]]
        beside = lambda p, q: p[(np.maximum(np.maximum(q.min(axis=0) - p, p - q.max(axis=0)), 0.0) ** 2).sum(axis=1) <= cutoff**2 * (1 + SLACK)]
        one = beside(one, two)
        two = beside(two, one) if len(one) else two[:0]
        step = max(1, CANDIDATES // max(1, len(two)))
        found[k] = any(((one[x : x + step, None] - two) ** 2).sum(axis=2).min() <= cutoff**2 for x in range(0, len(one), step)) if len(two) else False
    return found


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least of its set, after the sets of a and b were joined."""
    label = label.copy()
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def in_blocks(rows: DataFrame, cell: Cell, of: Callable[[Block], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """Runs ``of`` on every block of ``rows``; it gives columns by name in the order of ``schema``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_group(batches, len(KEYS)):
            block = Block.of(batch, cell)
            for found in of(block):
                n = len(next(iter(found.values())))
                if n:
                    found = {"frame_index": np.full(n, block.frame, dtype=np.int32), **found}
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in (found[name] for name in names)], names)

    return rows.mapInArrow(run, schema)


def ranked(block: Block, i: np.ndarray, j: np.ndarray, vectors: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The total order of pairs by centre, distance, row and vector, and each one's rank from 1."""
    order = np.lexsort((d2, i))
    sorted_i, sorted_d2 = i[order], d2[order]
    tied = np.zeros(len(order), dtype=bool)
    same = (np.diff(sorted_i) == 0) & (np.diff(sorted_d2) == 0)
    tied[1:] |= same
    tied[:-1] |= same
    at = order[tied]  # few, so the other keys are looked at for them alone
    order[tied] = at[np.lexsort((vectors[at, 2], vectors[at, 1], vectors[at, 0], block.rows[j[at]], d2[at], i[at]))]
    return order, np.arange(len(order)) - np.searchsorted(sorted_i, sorted_i) + 1
