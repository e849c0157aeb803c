"""Ranked lexical search over document shards by the Best Position Algorithm.

The index is sharded by documents: a shard holds a bounded stretch of documents with a list of
(document, count) for each of its terms, built where the texts are read, so building needs no shuffle.
The numbers of the whole table (documents, terms, documents of a term) are summed over the shards and
give every list entry its impact; a document's score for an item is the sum of its impacts.

Within a shard the lists of an item are read from their highest impact down, a stretch of each at a
time.  A document that comes up for the first time is scored whole by direct access to all its entries,
and each of these entries counts as seen at its position.  The best position of a list is the last one
up to which all are seen; no document that has not come up can exceed the sum of the impacts behind
the best positions.  Reading stops when that sum is strictly below the k-th score, so that ties at the
k-th place are all found.  A sixteenth of the shards is searched first; the k-th scores found there
are lower bounds for all other shards, which stop at them too.

Items are sent to the tasks in parts of a bounded number of terms, each part a pass over the index.

Defined cases: a null or empty text has no term and counts in no number; long texts are read whole, in
stretches; rows that share an id are documents each, and null ids rank behind others of the same
score; an item without terms has no result; items that share an id, or have none, are answered
each; without terms in the whole table there is no result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import gather, let_go, materialise, text_slices
from cellframe.llm.terms import term_stretches

#: Bytes of text and documents after which a shard is closed; a longer document has a shard of its own.
SHARD_BYTES, SHARD_ROWS = 2 << 20, 1 << 15
#: Terms of the items of a part.
PART_TERMS = 1 << 16
#: One shard in so many is searched first.
FIRST = 16
#: Positions of each list that the first round reads; every further round reads twice as many.
DEPTH = 8
#: Where ids are null; they rank behind others.
NO_ID = np.iinfo(np.int64).max
SHARD = "shard long, terms array<string>, ends array<int>, rows array<int>, counts array<int>, ids array<long>, sizes array<long>"
#: Shards of a file, so that no reader holds more of them at once.
IN_FILE = 8


@dataclass
class Index:
    """The stored shards with the number of documents that have terms and of all their terms."""

    shards: DataFrame
    documents: int
    terms: int


class _Shard:
    """Documents as they come; ``batch`` gives them as lists by term."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        size, own = 0, []
        for terms in term_stretches(text):
            own.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms)))
            size += len(terms)
        if size:
            distinct, counts = np.unique(np.concatenate(own) if len(own) > 1 else own[0], return_counts=True)
            self.keys.append(distinct * SHARD_ROWS + len(self.ids))
            self.counts.append(counts)
            self.ids.append(doc_id)
            self.sizes.append(size)

    def batch(self, shard: int) -> pa.RecordBatch:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        ends = np.cumsum(np.bincount(keys // SHARD_ROWS, minlength=len(self.numbers)))
        terms = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        columns = [terms, pa.array(ends, pa.int32()), pa.array(keys % SHARD_ROWS, pa.int32()), pa.array(counts, pa.int32()), pa.array(self.ids, pa.int64()), pa.array(self.sizes, pa.int64())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([shard]), *lists], ["shard", "terms", "ends", "rows", "counts", "ids", "sizes"])


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows of ``docs``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, _Shard(), 0
        for batch in batches:
            for a, b in text_slices(batch, 1, SHARD_BYTES):
                part = batch.slice(a, b - a)
                for doc_id, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.add(doc_id, t)
                    size += len(t or "")
                    if held.ids and (size >= SHARD_BYTES or len(held.ids) == SHARD_ROWS):
                        yield held.batch(number)
                        number, held, size = number + 1, _Shard(), 0
        if held.ids:
            yield held.batch(number)
        let_go()

    stored = materialise(docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(shards, SHARD), records=IN_FILE)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    n, terms = stored.agg(F.sum(F.size("sizes").cast("long")), F.sum(total("sizes"))).first()
    return Index(stored, n or 0, terms or 0)


def items_of(table: DataFrame, key: str, text: str) -> DataFrame:
    """item, item_id and the distinct terms of each row, stored."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(2).to_pylist():
                distinct: set[bytes] = set()
                for terms in term_stretches(t):
                    distinct.update(terms)
                found.append([w.decode() for w in distinct])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["item", "item_id", "terms"])

    rows = materialise(table.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    return materialise(rows.select("item", "item_id", "text").mapInArrow(split, "item long, item_id long, terms array<string>"))


def _parts(rows: DataFrame, terms: int, key: str) -> tuple[DataFrame, int]:
    """``rows`` with the column part, and how many parts there are so that each holds about PART_TERMS of the ``terms``."""
    parts = max(1, -(-terms // PART_TERMS))
    return rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), parts


def _sent(rows: DataFrame) -> Broadcast:
    """``rows``, a part of PART_TERMS terms or so, in one batch for every task."""
    table = rows.toArrow()
    return rows.sparkSession.sparkContext.broadcast(table.combine_chunks().to_batches()[0] if len(table) else pa.RecordBatch.from_pylist([], schema=table.schema))


def _columns(batch: pa.RecordBatch, k: int) -> dict[str, pa.Array]:
    """The lists of row ``k``."""
    return {name: batch.column(i)[k].values for i, name in enumerate(batch.schema.names) if pa.types.is_list(batch.schema.field(i).type)}


def weights(index: Index, items: DataFrame) -> DataFrame:
    """term, weight of the items' terms that the index has."""
    vocabulary = materialise(items.select(F.explode("terms").alias("term")).distinct())
    dealt, parts = _parts(vocabulary, vocabulary.count(), "term")

    def counted(part: int) -> DataFrame:
        wanted = _sent(dealt.where(F.col("part") == part).select("term"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = wanted.value.column("term")
            for batch in batches:
                for k in range(len(batch)):
                    row = _columns(batch, k)
                    at = pc.index_in(row["terms"], value_set=terms)
                    sizes = np.diff(row["ends"].to_numpy(), prepend=0)[pc.is_valid(at).to_numpy(zero_copy_only=False)]
                    yield pa.RecordBatch.from_arrays([terms.take(at.drop_null()), pa.array(sizes, pa.int64())], ["term", "n"])

        return index.shards.select("terms", "ends").mapInArrow(count, "term string, n long")

    ratio = F.lit(2.0 * index.documents + 2) / (2.0 * F.sum("n") + 1)
    found = reduce(DataFrame.unionAll, map(counted, range(parts)))
    return found.groupBy("term").agg(F.floor(1000 * F.log(ratio)).cast("long").alias("weight"))


class _Lists:
    """An item's lists in a shard, one behind the other, each by descending impact."""

    def __init__(self, rows: np.ndarray, impacts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, documents: int):
        at = gather(starts, lengths)
        self.rows, self.impacts, self.lengths = rows[at], impacts[at], lengths
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        #: places of each document's entries: what direct access reads
        self.by_row = np.argsort(self.rows, kind="stable")
        self.sizes = np.bincount(self.rows, minlength=documents)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def best(self, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores among which are all of the ``k`` best that score ``least`` or more, with all ties."""
        seen, come = np.zeros(len(self.rows), bool), np.zeros(len(self.sizes), bool)
        rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        depth, step, longest = 0, DEPTH, int(self.lengths.max(initial=0))
        while depth < longest:
            deep = self.lengths > depth
            read = self.rows[gather(self.starts[deep] + depth, np.minimum(self.lengths[deep] - depth, step))]
            fresh = np.unique(read[~come[read]]).astype(np.int64)
            if len(fresh):
                come[fresh] = True
                entries = self.by_row[gather(self.firsts[fresh], self.sizes[fresh])]
                seen[entries] = True
                rows.append(fresh)
                scores.append(np.add.reduceat(self.impacts[entries], np.cumsum(self.sizes[fresh]) - self.sizes[fresh]))
            found = np.concatenate(scores)
            kth = int(np.partition(found, len(found) - k)[len(found) - k]) if len(found) >= k else 0
            unseen = np.append(np.flatnonzero(~seen), len(seen))
            behind = unseen[np.searchsorted(unseen, self.starts)]
            if int(self.impacts[behind[behind < self.ends]].sum()) < max(kth, least, 1):
                break
            depth, step = depth + step, 2 * step
        return np.concatenate(rows), np.concatenate(scores)


def _searched(row: dict[str, pa.Array], q: pa.RecordBatch, k: int, documents: int, terms: int) -> Iterator[tuple[np.ndarray, ...]]:
    """item number, ids and scores of each item's best in one shard; ``documents`` and ``terms`` are those of the whole table."""
    at = pc.index_in(q.column("terms").flatten(), value_set=row["terms"])
    there = pc.is_valid(at).to_numpy(zero_copy_only=False)
    item = np.repeat(np.arange(len(q)), pc.list_value_length(q.column("terms")).to_numpy())[there]
    number, weight = at.drop_null().to_numpy().astype(np.int64), q.column("weights").flatten().to_numpy()[there]
    used, first = np.unique(number, return_index=True)
    ends = row["ends"].to_numpy().astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])[used]
    lengths = ends[used] - starts
    entries = gather(starts, lengths)
    rows, counts = row["rows"].to_numpy()[entries], row["counts"].to_numpy()[entries].astype(np.int64)
    length_part = np.array([10 + 90 * n * documents // terms for n in row["sizes"].to_pylist()], dtype=np.int64)
    impacts = 1_000_000_000 * counts // (1000 * counts + 8 * length_part[rows])
    order = np.lexsort((-impacts, np.repeat(np.arange(len(used)), lengths)))
    rows, impacts = rows[order].astype(np.uint16), (impacts * np.repeat(weight[first], lengths))[order]
    starts = np.cumsum(lengths) - lengths
    ids = pc.fill_null(row["ids"], NO_ID).to_numpy()
    least, numbers = pc.fill_null(q.column("least"), 1).to_numpy(), q.column("item").to_numpy()
    bounds = np.searchsorted(item, np.arange(len(q) + 1))
    place = np.searchsorted(used, number)
    for i in range(len(q)):
        lists = place[bounds[i] : bounds[i + 1]]
        if len(lists):
            own, scores = _Lists(rows, impacts, starts[lists], lengths[lists], len(ids)).best(k, int(least[i]))
            good = scores >= max(int(least[i]), 1)
            own, scores = own[good], scores[good]
            best = np.lexsort((ids[own], -scores))[:k]
            yield np.full(len(best), numbers[i]), ids[own[best]], scores[best]


def _search(index: Index, shards: DataFrame, asked: DataFrame, parts: int, k: int) -> DataFrame:
    """item, doc_id, score: each shard's k best of each item, those that can be among the k best of all."""
    documents, terms = index.documents, index.terms

    def found(part: int) -> DataFrame:
        sent = _sent(asked.where(F.col("part") == part).select("item", "least", "terms", "weights"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    best = list(_searched(_columns(batch, i), sent.value, k, documents, terms))
                    if best:
                        items, ids, scores = (np.concatenate(c) for c in zip(*best, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["item", "doc_id", "score"])
            let_go()

        return shards.mapInArrow(run, "item long, doc_id long, score long")

    return reduce(DataFrame.unionAll, map(found, range(parts)))


def search(index: Index, table: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents with a score above 0, ties by ascending id."""
    items = items_of(table, key, text)
    known = items.select("item", F.explode("terms").alias("term")).join(weights(index, items), "term").where("weight > 0")
    weighed = materialise(known.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")))  # an item's own terms
    terms = weighed.agg(F.sum(F.size("terms"))).first()[0] or 0
    asked, parts = _parts(weighed, terms, "item")
    asked = materialise(asked)
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = lambda found: found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    early = materialise(ranked(_search(index, index.shards.where(first), asked.withColumn("least", F.lit(None).cast("long")), parts, k)))
    bound = early.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
    late = _search(index, index.shards.where(~first), asked.join(bound, "item", "left"), parts, k)
    found = ranked(early.drop("rank").unionByName(late))
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
