"""Best-fit packing of documents into sequences of a fixed number of tokens.

A packing depends on the lengths alone, and no length exceeds the sequence, so the plan is made over
the histogram of lengths: at most ``capacity`` numbers however large the corpus is.  The plan is a
list of patterns (lengths that share a sequence) with multiplicities; each uses up at least one
length or fills what is left, so it is bounded by the capacity too.  The pieces themselves are
numbered within their length in Spark and find their place by that number.

Defined cases: null and empty texts have the single end token; equal lengths are interchangeable and
may be dealt in any order; repeated rows are packed once each; a long text is encoded whole and cut into
pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import filled, let_go, materialise, text_slices
from cellframe.llm.wordtokens import encode_texts, word_encoder

#: Rows of pieces that one task numbers.
NUMBERED = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity``; with the ids themselves if asked for."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for a, b in text_slices(batch, 1):
                ids, ends = encode_texts(encoder, filled(batch.column(1).slice(a, b - a)))
                names = batch.column(0).slice(a, b - a).to_pylist()
                rows, texts = [], []
                for name, i, j in zip(names, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = np.append(ids[i:j], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((name, k, at, len(part), zlib.crc32(part.tobytes())))
                        if keep_ids:
                            texts.append(part.astype(np.int32))
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                named = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, named = [*columns, pa.array(texts, type=pa.list_(pa.int32()))], [*named, "ids"]
                yield pa.RecordBatch.from_arrays(columns, named)
        encoder.forget()
        let_go()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES + ", ids array<int>" * keep_ids)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (multiplicity, [(length, times), ...]) that use up exactly ``counts``.

    From the longest length down, the gap beside it is filled exactly by one length, a pair or a
    triple that is still available; where none does, the longest length that fits goes in, and the
    search for an exact complement goes on with the gap that is left.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            used: dict[int, int] = {}
            free = left.copy()

            def take(length: int, times: int = 1, used=used, free=free) -> None:
                used[length] = used.get(length, 0) + times
                free[length] -= times

            take(longest)
            gap = capacity - longest
            while gap:
                exact = complement(free, gap)
                if exact:
                    for length in exact:
                        take(length)
                    break
                fitting = np.flatnonzero(free[1 : gap + 1])
                if not len(fitting):
                    break
                best = int(fitting[-1]) + 1
                times = int(min(gap // best, free[best]))
                take(best, times)
                gap -= best * times
            times = min(int(left[length]) // n for length, n in used.items())
            for length, n in used.items():
                left[length] -= n * times
            patterns.append((times, sorted(used.items(), reverse=True)))
    return patterns


def complement(free: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to ``gap``, those with the longest member first."""
    if free[gap]:
        return [gap]
    if pair := pair_sum(free, gap):
        return pair
    for a in np.flatnonzero(free[1 : gap - 1])[::-1] + 1:
        if a * 3 < gap:
            break
        free[a] -= 1
        pair = pair_sum(free, gap - int(a), int(a))
        free[a] += 1
        if pair:
            return [int(a), *pair]
    return None


def pair_sum(free: np.ndarray, total: int, most: int | None = None) -> list[int] | None:
    """Two available lengths, none over ``most``, that sum to ``total``."""
    low = (total + 1) // 2
    high = min(total - 1, most or total)
    if high < low:
        return None
    ok = (free[low : high + 1] > 0) & (free[total - high : total - low + 1][::-1] > 0)
    if total % 2 == 0 and free[low] < 2:
        ok[0] = False
    found = np.flatnonzero(ok)
    return [low + int(found[-1]), total - low - int(found[-1])] if len(found) else None


def slots_by_length(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length rows (first number, times in a sequence, first sequence, first offset)."""
    slots: dict[int, list] = {}
    numbered: dict[int, int] = {}
    sequence = 0
    for multiplicity, members in patterns:
        offset = 0
        for length, times in members:
            slots.setdefault(length, []).append((numbered.get(length, 0), times, sequence, offset))
            numbered[length] = numbered.get(length, 0) + multiplicity * times
            offset += length * times
        sequence += multiplicity
    return {length: np.array(rows, dtype=np.int64) for length, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset; reads them twice, so pass stored ones."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots = slots_by_length(plan_packing(counts, capacity))
    salts = max(8, sum(counts.values()) // NUMBERED)
    dealt = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", *(c for c in ("ids_crc32",) if c in pieces.columns)), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("_salt", "length").orderBy("doc_id", "piece")
    numbered = dealt.withColumn("_own", F.row_number().over(own) - 1).join(firsts, ["_salt", "length"]).withColumn("_number", F.col("_first") + F.col("_own"))
    names = [c for c in pieces.columns]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence = np.zeros(len(frame), dtype=np.int64)
            offset = np.zeros(len(frame), dtype=np.int64)
            lengths, numbers = frame["length"].to_numpy(), frame["_number"].to_numpy()
            for length in np.unique(lengths):
                rows, at = slots[int(length)], lengths == length
                slot = rows[np.searchsorted(rows[:, 0], numbers[at], side="right") - 1]
                past = numbers[at] - slot[:, 0]
                sequence[at] = slot[:, 2] + past // slot[:, 1]
                offset[at] = slot[:, 3] + past % slot[:, 1] * length
            yield frame[names].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.select(*names, "_number").mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Packs every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialise(token_pieces(docs, tokenizer, capacity)), capacity)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents in the order of their places."""
    placed = pack(materialise(token_pieces(docs, tokenizer, capacity, keep_ids=True)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # at most capacity tokens
    grouped = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
