"""Toxicity by compression distance with two zstandard dictionaries.

One dictionary is trained on toxic text: the words and parts of words that are frequent there and rare
elsewhere.  One is trained on ordinary text: the frequent ordinary words that begin or end as those
do, so that what both classes have in common is shortened by either dictionary alike.  A text is cut
into windows at its words, each window is compressed with either dictionary, and the lengths are
compared: a window counts if the toxic dictionary covers it and saves enough bytes against the other.
How much is enough is calibrated on the training rows, and so is the logistic curve that turns the
number and share of such windows into a score.

Labels are learnt from a bounded sample: ``sample`` documents of either class, chosen by a hash of the
id, of near copies one (passages would otherwise be frequent because their document is copied).
Passages are counted over that sample in Spark; what comes to the driver is the dictionaries' content,
which takes every passage and word that was learnt, and a row of counts per sampled document.

zstandard's own trainer is not used: it fills dictionaries with what is frequent, and what is frequent
in toxic text is mostly ordinary (the README has its figures).

Defined cases: null and empty texts have no window and score as a clean text; rows without label or
id train nothing, and rows that share an id train by one of their texts; without labels of both classes every text scores 0; repeated rows repeat; a long
text is scored whole, and so is a long word, in windows; an empty table gives an empty result; further
columns of either table are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import filled, materialise, text_slices

#: Characters of the passages that are counted.
GRAM = 6
#: Characters of the longest window; longer words are cut.
WINDOW = 128
#: Share of a class's documents that hold a passage, and its rate against the other class.
LEAST_SHARE, LEAST_RATIO = 0.008, 50.0
#: Ordinary words with the same beginning or end that the ordinary dictionary takes.
ALIKE = 16
#: Calibrated choices: bytes saved against the ordinary dictionary, bytes over the length of a covered window.
SAVINGS, SLACKS = (2, 3, 4, 5, 6), (0, 1, 2)
#: Windows whose lengths a worker remembers; beyond it forgets all, which changes no result.
REMEMBERED = 500_000
EDGE = "    "
_words = re.compile(r"[^\W\d_]+")


@dataclass
class Toxicity:
    """Contents of both dictionaries, the length of a covered window, the thresholds and the curve's weights."""

    toxic: bytes = b""
    ordinary: bytes = b""
    covered: int = 0
    saving: int = SAVINGS[0]
    slack: int = SLACKS[0]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def spaced(word: str) -> str:
    """A word with the marks of its start and end."""
    return f"  {word}  "


def edged(passage: str) -> str:
    """A passage as it stands in a window: the marks of a word's start and end widened."""
    return (EDGE if passage.startswith("  ") else "") + passage.strip(" ") + (EDGE if passage.endswith("  ") else "")


def windows(text: str) -> list[str]:
    """The words of a text, long ones cut."""
    return [w[i : i + WINDOW] for w in _words.findall(text.lower()) for i in range(0, len(w), WINDOW)]


class Lengths:
    """Bytes that the toxic dictionary saves in a window and bytes that it leaves, each window compressed once."""

    def __init__(self, model: Toxicity):
        self.ordinary, self.toxic = self._compressor(model.ordinary), self._compressor(model.toxic)
        self.known: dict[str, tuple[int, int]] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content or b"~" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        reach = max(15, len(content).bit_length() + 1)
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, min_match=6, window_log=reach, hash_log=reach - 1, chain_log=reach - 1, search_log=4, target_length=0,
            write_content_size=False, write_dict_id=False, write_checksum=False,
        )
        dictionary.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how)

    def left(self, passage: str) -> int:
        return len(self.toxic.compress(edged(passage).encode()))

    def of(self, text: str) -> list[tuple[int, int]]:
        """(saved, left) of each window."""
        known, found = self.known, windows(text)
        if len(known) > REMEMBERED:
            known.clear()
        for w in found:
            if w not in known:
                data = edged(spaced(w)).encode()
                left = len(self.toxic.compress(data))
                known[w] = (len(self.ordinary.compress(data)) - left, left)
        return [known[w] for w in found]


def features(count: int, total: int) -> list[float]:
    """What the curve sees of a text: constant, whether a window counts, how many, what share."""
    return [1.0, float(count > 0), float(np.log1p(count)), min(1.0, 20 * count / max(total, 1))]


def _signature(text: str, seed: int) -> int:
    """Smallest hash of the text's triples of words; near copies mostly share it."""
    words = _words.findall(text.lower())
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed) >> 1 for i in range(max(1, len(words) - 2))), default=0)


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    usable = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = usable.groupBy("toxic").agg(F.count("*").alias("_n"))  # two rows at most
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("_n") < F.lit(sample).cast("long") * (1 << 20)
    ids = usable.join(F.broadcast(sizes), "toxic").where(part).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * sample)
    # The sample's bound makes the ids small enough to be sent to where the texts are.
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    # Rows that share an id give one text, so that copies do not pass the bound.
    chosen = met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([_signature(t, k) for t in texts], pa.int64()) for k in (1, 2))], ["doc_id", "text", "toxic", "a", "b"])

    rows = materialise(chosen.mapInArrow(signed, "doc_id long, text string, toxic int, a long, b long"))
    for key in ("a", "b"):
        rows = rows.join(rows.groupBy("toxic", key).agg(F.min("doc_id").alias("doc_id")), ["toxic", key, "doc_id"], "left_semi")
    return rows.select("text", "toxic")


def _counted(rows: DataFrame, of_text, name: str) -> DataFrame:
    """Documents of either class (toxic_n, ordinary_n) that hold each of the strings ``of_text`` gives."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tallies = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tallies[toxic].update(of_text(text or "", toxic))
            keys = list(tallies[0].keys() | tallies[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([tallies[1][k] for k in keys], pa.int64()), pa.array([tallies[0][k] for k in keys], pa.int64())], [name, "toxic_n", "ordinary_n"])

    found = rows.select("text", "toxic").mapInArrow(count, f"{name} string, toxic_n long, ordinary_n long")
    return found.groupBy(name).agg(F.sum("toxic_n").alias("toxic_n"), F.sum("ordinary_n").alias("ordinary_n"))


def _grams(text: str, _: int) -> set[str]:
    """The words of a text and the grams in them."""
    words = {spaced(w) for w in set(_words.findall(text.lower()))}
    return words | {w[i : i + GRAM] for w in words for i in range(len(w) - GRAM + 1)}


def _passages(text: str, telling: frozenset[str]) -> Iterator[str]:
    """Telling words, and of the other words the longest stretches all of whose grams are telling."""
    for word in map(spaced, _words.findall(text.lower())):
        if word in telling:
            yield word
            continue
        at = 0
        while at <= len(word) - GRAM:
            end = at
            while end <= len(word) - GRAM and word[end : end + GRAM] in telling:
                end += 1
            if end > at + 1:
                yield word[at : end - 1 + GRAM]
            at = end + 1


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Toxicity:
    """From texts (doc_id, text) and ``labels`` (doc_id, toxic) learns the dictionaries and the calibration."""
    rows = materialise(_sample(docs, labels, sample))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Toxicity()
    n, m = sizes[1], sizes[0]
    least = max(5.0, LEAST_SHARE * n)
    rate = (F.col("toxic_n") / n) / ((F.col("ordinary_n") + 0.5) / m)
    frequent = _counted(rows, _grams, "gram").where((F.col("toxic_n") >= least) & (rate >= LEAST_RATIO))
    telling = frozenset(r["gram"] for r in frequent.orderBy(F.desc("toxic_n"), "gram").collect())

    passages = _counted(rows.where("toxic = 1"), lambda t, _: set(_passages(t, telling)), "passage").where("toxic_n >= 3")
    toxic = [r["passage"] for r in passages.orderBy(F.desc("toxic_n"), "passage").collect()]
    starts, ends = frozenset(p.strip()[:4] for p in toxic), frozenset(p.strip()[-4:] for p in toxic)

    def alike(text: str, _: int) -> set[str]:
        return {w for w in set(_words.findall(text.lower())) if w[:4] in starts or w[-4:] in ends}

    common = _counted(rows.where("toxic = 0"), alike, "word").where("ordinary_n >= 3")
    ranked = common
    for name, key in (("_start", F.substring("word", 1, 4)), ("_end", F.expr("right(word, 4)"))):
        ranked = ranked.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ordinary_n"), "word")))
    ordinary = [spaced(r["word"]) for r in ranked.where((F.col("_start") <= ALIKE) | (F.col("_end") <= ALIKE)).orderBy(F.desc("ordinary_n"), "word").collect()]
    model = Toxicity(_content(toxic), _content(ordinary))
    if toxic:
        lengths = Lengths(model)
        model.covered = int(np.median([lengths.left(p) for p in toxic]))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model)
        for batch in batches:
            counts = []
            for text in filled(batch.column(0)).to_pylist():
                own = np.array(lengths.of(text) or [(0, 1 << 20)])
                counts.append([len(own)] + [int(((own[:, 0] >= s) & (own[:, 1] <= model.covered + c)).sum()) for s in SAVINGS for c in SLACKS])
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.list_(pa.int64())), batch.column(1)], ["counts", "toxic"])

    points = rows.select("text", "toxic").mapInArrow(seen, "counts array<long>, toxic int").orderBy("toxic", "counts").collect()  # within the sample's bound
    counts, y = np.array([p["counts"] for p in points]), np.array([p["toxic"] for p in points])
    right = ((counts[:, 1:] > 0) == (y[:, None] == 1)).mean(axis=0)
    best = int(np.flatnonzero(right == right.max())[0])
    model.saving, model.slack = SAVINGS[best // len(SLACKS)], SLACKS[best % len(SLACKS)]
    model.weights = calibrate(np.array([features(int(c), int(t)) for c, t in zip(counts[:, 1 + best], counts[:, 0], strict=True)]), y)
    return model


def _content(passages: list[str]) -> bytes:
    """The passages, the most frequent nearest to the text."""
    return "".join(edged(p) for p in reversed(passages)).encode()


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the logistic curve by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score (0 to 1) and windows, the number of windows that count as toxic."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model)
        limit = model.covered + model.slack
        for batch in batches:
            for a, b in text_slices(batch, 1):
                scores, found = [], []
                for text in filled(batch.column(1).slice(a, b - a)).to_pylist():
                    own = lengths.of(text)
                    found.append(sum(saved >= model.saving and left <= limit for saved, left in own))
                    scores.append(float(1 / (1 + np.exp(-np.dot(features(found[-1], len(own)), model.weights)))) if len(model.weights) else 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64()), pa.array(found, pa.int64())], ["doc_id", "score", "windows"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double, windows long")
