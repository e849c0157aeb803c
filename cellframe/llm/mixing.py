"""Mixing sources to target weights: blocks of words, multinomial draws per output shard, pseudorandom order.

A source's documents, one after another, are a stream of words, cut into blocks of a fixed length.
The mix is a row of slots of a block each, in output shards of a fixed number of slots.  How many slots
of a shard each source gets is drawn from a multinomial distribution of the target weights.  A source's
slots are counted through all shards; its epochs are passes over its blocks, each in the order of a
pseudorandom permutation of the block numbers, so no list of blocks is ever shuffled or gathered.  Slots
meet blocks in a join by source and block number, and blocks meet the documents' spans of words.

Independent draws add up to a source's target only by and large.  The sums are made exact: where a source
was drawn more often than its target has blocks, slots chosen by a pseudorandom permutation, and so
evenly over all shards, pass on to the sources that were drawn too seldom.

Positions in a stream are running sums over parts of bounded size, dealt by a hash of id and text;
rows alike in source, id and text are one row with a number of copies until their positions are known.
All draws and permutations are functions of the seed and the rows, so reruns agree, however the rows lie.

Defined cases: null and empty texts have size 0 and give no words; null is a source of its own, behind
all others; long texts lie in many blocks; rows that share an id take their own parts; an empty table
gives an empty result; further columns are ignored.  The sources are few: more than ``MOST_SOURCES``
raise, since each draw and the targets hold one number of every source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import materialise

#: Words of a block, slots of an output shard, and shards that are drawn together.
BLOCK, SLOTS, GROUP = 64, 4096, 64
#: Rows of a part whose positions are summed up together, and copies of a row that are made at once.
PART, COPIES = 16_384, 4096
#: How often a source may be repeated.
REPEATS = 3
MOST_SOURCES = 1 << 16
#: What tells the four rounds of a permutation apart: multiples of the golden ratio's 64 bits.
TURNS = np.arange(4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Words: anything but spaces and the five controls like them.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Source:
    """A source with its words, the words it should give, and its blocks and slots."""

    name: str | None
    size: int
    target: float = 0.0
    block: int = BLOCK

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    @property
    def slots(self) -> int:
        """Whole epochs and the blocks that come nearest to the rest."""
        epochs = int(self.target // self.size) if self.size else 0
        rest = round((self.target - epochs * self.size) / self.block)
        return min(epochs * self.blocks + min(rest, self.blocks), REPEATS * self.blocks)


def set_targets(sources: list[Source], weights: tuple[int, ...] = (1, 2, 3)) -> None:
    """Shares all words by ``weights``, repeating in the order of ``sources``; no target passes REPEATS times its source's size, what is over is shared again."""
    weight = {id(s): weights[i % len(weights)] for i, s in enumerate(sources)}
    rest, open_ = sum(s.size for s in sources), list(sources)
    while open_:
        total = sum(weight[id(s)] for s in open_)
        over = [s for s in open_ if rest * weight[id(s)] / total > REPEATS * s.size]
        for s in over or open_:
            s.target = float(REPEATS * s.size) if over else rest * weight[id(s)] / total
        rest -= sum(REPEATS * s.size for s in over)
        open_ = [s for s in open_ if s not in over] if over else []


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """source, doc_id, size, digest and the number of copies of every distinct row, stored."""
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(source).cast("string").alias("source"), F.col(key).cast("long").alias("doc_id"), words.alias("size"), F.xxhash64(text).alias("digest"))
    return materialise(rows.groupBy("source", "doc_id", "size", "digest").agg(F.count("*").alias("copies")))


def sources_of(rows: DataFrame, block: int) -> list[Source]:
    """The sources in the order of their names by code point, null last, with their targets."""
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources = [Source(r.source, r["size"], block=block) for r in sorted(found, key=lambda r: (r.source is None, r.source))]
    set_targets(sources)
    return sources


def positioned(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """source number, source_size, target, doc_id, size and start of every document, copies each: its first word's position in the stream."""
    spark = rows.sparkSession
    named = spark.createDataFrame([(i, s.name, s.size, s.target) for i, s in enumerate(sources)], "number int, source string, source_size long, target double")
    parts = max(1, -(-rows.count() // PART))
    dealt = rows.join(F.broadcast(named), rows.source.eqNullSafe(named.source)).drop(named.source).withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).cast("int"))
    words = F.col("size") * F.col("copies")
    before = lambda own, c: F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("number", "part").agg(F.sum(words).alias("words"))
    firsts = sums.select("number", "part", before(Window.partitionBy("number").orderBy("part"), "words").alias("first"))
    own = Window.partitionBy("number", "part").orderBy("doc_id", "digest", "size")
    placed = dealt.withColumn("within", before(own, words)).join(firsts, ["number", "part"])
    many = placed.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    last = F.least(F.col("copies") - 1, F.col("lot") * COPIES + COPIES - 1)
    each = many.withColumn("copy", F.explode(F.sequence(F.col("lot") * COPIES, last)))
    return each.select("number", "source_size", "target", "doc_id", "size", (F.col("first") + F.col("within") + F.col("copy") * F.col("size")).alias("start"))


def permuted(values: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each value's place in the pseudorandom permutation of range(size) that its key names: four Feistel rounds, again until below the size."""
    values, sizes, keys = (np.asarray(a, dtype=np.uint64).copy() for a in (values, sizes, keys))
    half = np.array([max(1, -(-max(int(n) - 1, 1).bit_length() // 2)) for n in np.unique(sizes)], dtype=np.uint64)[np.unique(sizes, return_inverse=True)[1]]
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(values))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = values[todo] >> h, values[todo] & m
        for turn in TURNS:
            left, right = right, left ^ (_mixed(right + keys[todo] + turn) & m)
        values[todo] = left << h | right
        todo = todo[values[todo] >= sizes[todo]]
    return values.astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of the SplitMix generator."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _key(seed: int, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(np.uint64(seed) + source.astype(np.uint64)) + epoch.astype(np.uint64))


def slots(spark, sources: list[Source], seed: int) -> DataFrame:
    """shard, slot, number, block: the block that each slot of each output shard takes, stored, so that joins know their size."""
    quota = np.array([s.slots for s in sources], dtype=np.int64)
    blocks = np.array([max(1, s.blocks) for s in sources], dtype=np.int64)
    total = int(quota.sum())
    shards = -(-total // SLOTS)
    groups = -(-shards // GROUP)
    share = quota / max(1, total)

    def draws(group: int) -> np.ndarray:
        """Slots of every source in the shards of a group."""
        own = range(group * GROUP, min(shards, (group + 1) * GROUP))
        return np.array([np.random.default_rng([seed, k]).multinomial(min(SLOTS, total - k * SLOTS), share) for k in own], dtype=np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                n = draws(group).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), group)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["id", "number", "n"])

    drawn = materialise(spark.range(0, groups, 1, max(1, min(groups, 4096))).mapInArrow(sums, "id long, number int, n long"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("number").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = drawn.select("id", "number", first.alias("first")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", "first"))).alias("firsts"))  # a row a source
    reached = np.zeros(len(sources), dtype=np.int64)
    for r in drawn.groupBy("number").agg(F.sum("n").alias("n")).collect():  # a row a source
        reached[r.number] = r.n
    over, under = np.maximum(reached - quota, 0), np.maximum(quota - reached, 0)
    over_from, under_to = np.cumsum(over) - over, np.cumsum(under)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, firsts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = firsts.values.field("first").to_numpy().astype(np.int64).copy()
                for k, n in enumerate(draws(group), group * GROUP):
                    number = np.repeat(np.arange(len(sources)), n)
                    within = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n)
                    order = permuted(at[number] + within, np.maximum(reached[number], 1), _key(seed, number, np.full(len(number), -1)))
                    passed = order >= quota[number]
                    extra = over_from[number[passed]] + order[passed] - quota[number[passed]]
                    number[passed] = np.searchsorted(under_to, extra, side="right")
                    order[passed] = reached[number[passed]] + extra - (under_to - under)[number[passed]]
                    epoch, place = order // blocks[number], order % blocks[number]
                    block = permuted(place, blocks[number], _key(seed, number, epoch))
                    slot = permuted(np.arange(len(number)), np.full(len(number), len(number)), np.full(len(number), _key(seed, np.array([k]), np.array([-2]))[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), k)), pa.array(slot), pa.array(number.astype(np.int32)), pa.array(block)], ["shard", "slot", "number", "block"])
                    at += n

    dealt = starts.repartition(max(1, min(groups, 4096)), "id")  # a group is as much work as a million words, however few bytes its row has
    return materialise(dealt.mapInArrow(filled, "shard long, slot long, number int, block long"))


def _spans(placed: DataFrame, block: int) -> DataFrame:
    """The documents' words by block: number, block, first (in the block), skipped (in the document), words."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    at = F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block)))
    cut = placed.where("size > 0").withColumn("block", at)
    a, b = F.greatest(start, F.col("block") * block), F.least(end, F.col("block") * block + block)
    return cut.withColumns({"first": a - F.col("block") * block, "skipped": a - start, "words": b - a})


def mix(docs: DataFrame, seed: int = 2024, block: int = BLOCK, **names: str) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents.

    The mix has a row for every document's span of words in a slot: shard, slot, first (place in the slot),
    number (of the source), start (of the document), doc_id, skipped (words of the document before the
    span), words.  Documents: number, source_size, target, doc_id, size, start.
    """
    rows = measured(docs, **names)
    sources = sources_of(rows, block)
    placed = materialise(positioned(rows, sources))
    spans = _spans(placed.select("number", "doc_id", "size", "start"), block)
    taken = slots(docs.sparkSession, sources, seed).join(spans, ["number", "block"])
    return taken.select("shard", "slot", "first", "number", "start", "doc_id", "skipped", "words"), placed


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``: the words of it that the mix takes, repeats counted."""
    mixed, placed = mix(docs, **options)
    sums = mixed.groupBy("number", "start").agg(F.sum("words").alias("taken"))
    with_words = placed.where("size > 0").join(sums, ["number", "start"], "left")
    without = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    result = with_words.select(*placed.columns, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(without)
    return result.select("doc_id", "size", "source_size", "target", "taken")
