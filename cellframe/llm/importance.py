"""Importance resampling towards a target: hashed n-gram features, a head of frequent words and pairs.

Features are the runs of one to ``longest`` consecutive words of a text, each hashed by CRC-32 into a
bucket.  CRC-32 can be carried on: the state after a word is all that the runs beginning with it need.
The words that make up at least a ``share`` of all words are the head, at most 1 / share of them and
each of bounded length; their states are broadcast, and so are the buckets of the frequent pairs among
them.  What is not in the head, the tail, is computed directly.  Both give the same buckets, so totals
over all documents are exact.  Documents are read for the head and once more for their buckets, which
are stored; the log ratios of the totals of target and documents then weigh each document.

A share of the documents with enough words is drawn by the highest weight plus Gumbel noise, which is
a function of seed and id.  Ranks are numbered by ranges of the scores, never in one task.

Defined cases: null and empty texts have no feature, weight 0, and are not drawn for want of words; long
texts are read whole, in stretches; rows that share an id share their noise and are drawn each; null
ids have the noise of an empty id and rank behind others of the same score; without target texts all
gains follow from counts of 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import let_go, materialise, text_slices
from cellframe.llm.terms import term_stretches

#: Share of all words (pairs) from which one belongs to the head, which has 1 / SHARE entries at most.
SHARE = 1 / 50_000
#: Bytes of the longest word or pair of the head.
LONGEST_HEAD = 64
#: Distinct words or pairs that a task counts before it passes its counts on.
HELD = 500_000
#: Rows of a range that is ranked in one task.
RANGE = 200_000


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for a, b in text_slices(batch, column):
            part = batch.slice(a, b - a)
            yield part, part.column(column).to_pylist()


def counts(texts: DataFrame, pairs: bool = False) -> DataFrame:
    """word, n of every word of the column of texts that can belong to the head, or of every pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(n: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for _, part in _texts(batches, 0):
            for text in part:
                last: list[bytes] = []
                for words in term_stretches(text):
                    if pairs:
                        words = last + words
                        held.update(p for p in map(b" ".join, zip(words, words[1:], strict=False)) if len(p) <= LONGEST_HEAD)
                        last = words[-1:]
                    else:
                        held.update(words)
                    if len(held) > HELD:
                        yield passed(held)
                        held = Counter()
        if held:
            yield passed(held)
        let_go()

    found = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.octet_length("word") <= LONGEST_HEAD)


def frequent(texts: DataFrame, share: float, pairs: bool = False) -> list[bytes]:
    """The words or pairs that make up at least ``share`` of all of them that are short enough: 1 / share at most."""
    counted = materialise(counts(texts, pairs))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [bytes(r.word) for r in counted.where(F.col("n") >= F.lit(share * total)).select("word").collect()]


class Features:
    """Buckets of the features of texts, through the head where it has them."""

    def __init__(self, states: dict[bytes, int], pair_buckets: dict[bytes, int], longest: int, buckets: int):
        self.states, self.pair_buckets, self.longest, self.buckets = states, pair_buckets, longest, buckets
        self.word_buckets = {w: s % buckets for w, s in states.items()}

    def of(self, text: str | None) -> list[int]:
        """The bucket of every feature of ``text``, repeats included."""
        found: list[int] = []
        get, crc, buckets = self.word_buckets.get, zlib.crc32, self.buckets
        last: list[bytes] = []
        for words in term_stretches(text):
            found += [crc(w) % buckets if (b := get(w)) is None else b for w in words]
            if self.longest > 1:
                self._runs(last + words, len(last), found)
                last = (last + words)[1 - self.longest :]
        return found

    def _runs(self, words: list[bytes], old: int, found: list[int]) -> None:
        """Adds the buckets of the runs of two words and more that end behind the ``old`` first words."""
        for last in range(old, len(words)):
            for n in range(2, min(self.longest, last + 1) + 1):
                run = words[last + 1 - n : last + 1]
                known = self.pair_buckets.get(b" ".join(run)) if n == 2 else None
                found.append(self._state(run) % self.buckets if known is None else known)

    def _state(self, run: list[bytes]) -> int:
        """The state after ``run``, carried on from that of its first word."""
        state = self.states.get(run[0])
        state = zlib.crc32(run[0]) if state is None else state
        for word in run[1:]:
            state = zlib.crc32(b" " + word, state)
        return state


def featurised(docs: DataFrame, key: str, text: str, features: Callable[[], Features]) -> DataFrame:
    """doc_id, n_words, n_features and the features' distinct buckets with their counts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = features()
        for part, texts in _texts(batches, 1):
            found = [np.array(own.of(t), dtype=np.int32) for t in texts]
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            keys, times = np.unique(np.repeat(np.arange(len(found)), sizes) * own.buckets + np.concatenate(found), return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(keys // own.buckets, minlength=len(found)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (keys % own.buckets, times)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_words(sizes, own.longest)), pa.array(sizes), *lists], ["doc_id", "n_words", "n_features", "buckets", "times"])
        let_go()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>, times array<int>"))


def _words(sizes: np.ndarray, longest: int) -> np.ndarray:
    """Words of texts with so many features: w words have the sum of w - j + 1 over the lengths j up to ``longest``."""
    few = np.cumsum(np.arange(longest + 1))  # features of up to ``longest`` words
    many = (sizes + longest * (longest - 1) // 2) // longest
    return np.where(sizes <= few[-1], np.searchsorted(few, sizes), many)


def totals(featured: DataFrame, name: str) -> DataFrame:
    """bucket, ``name``: features of all rows by bucket."""
    one = featured.select(F.explode(F.arrays_zip("buckets", "times")).alias("f")).select(F.col("f.buckets").alias("bucket"), F.col("f.times").alias("n"))
    return one.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(sources: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain for all ``buckets``: floor(1000 ln) of the smoothed ratio of target and sources."""
    s, t = totals(sources, "s"), totals(target, "t")
    every = sources.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s"), F.sum("t")).first()
    a, b = F.col("t") + 1.0, F.col("s") + 1.0
    ratio = a * F.lit(float(sums[0] + buckets)) / (b * F.lit(float(sums[1] + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, share: float = SHARE, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``: the sum of the gains of its features."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(text).cast("string"))
    head = context.broadcast({w: zlib.crc32(w) for w in frequent(texts, share)})
    paired = context.broadcast({p: zlib.crc32(p) % buckets for p in frequent(texts, share, True)} if longest > 1 else {})
    features = partial(_features, head, paired, longest, buckets)
    featured = featurised(docs, key, text, features)
    targets = featurised(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text, features)
    by_bucket = np.zeros(buckets, dtype=np.int64)
    for r in gains(featured, targets, buckets).collect():  # a row a bucket
        by_bucket[r.bucket] = r.gain
    gain = context.broadcast(by_bucket)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = batch.column(3), batch.column(4)
            products = gain.value[found.flatten().to_numpy()] * times.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(products)])
            at = np.asarray(found.offsets) - found.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends[at[1:]] - ends[at[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return featured.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def _features(head, paired, longest: int, buckets: int) -> Features:
    return Features(head.value, paired.value, longest, buckets)


def noise(seed: int, key: str = "doc_id"):
    """The Gumbel noise of an id in thousandths, from the first eight hexadecimal digits of its SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(weights: DataFrame, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``weights`` with score and rank: the ``percent`` of the rows of at least ``least_words`` words with the highest scores, ties to smaller ids."""
    scored = materialise(weights.withColumn("score", F.col("weight") + noise(seed)))
    good = F.col("n_words") >= least_words
    n = scored.where(good).count()
    ranges = max(1, -(-n // RANGE))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_row")]  # rows alike in all else are told apart, or they would share a range
    dealt = materialise(scored.where(good).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    firsts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = dealt.withColumn("_own", own).join(firsts, "_range").withColumn("rank", F.col("_first") + F.col("_own"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n * percent // 100, F.col("rank")))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(~good).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``; undrawn ones have no rank."""
    return drawn(weighed(docs, target, **options))
