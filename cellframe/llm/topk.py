"""Exact top-k search by distributed histogram selection.

Everything is scored, blocks of queries against blocks of rows, but no scores are kept: each pass
returns histograms.  For every query the score interval that holds its k-th best is known; a pass
counts the scores in the interval's bins over the whole table, and the bin in which the count reaches
k is the next interval, until it is a single score.  Queries with more ties at that score than places
left go on in the same way over the ids.  A last pass returns what lies above the thresholds.

A block reports only the bins down to that of its own k-th best: the table's k-th is no lower.

Scores are exact whole numbers: products of doubles where no score can pass 2^53, of 64-bit integers
beyond that; where the vectors' lengths allow a score that no long holds, the query raises.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; rows
only meet queries of their own width; a query with fewer than k candidates gets all; ties go to the
smaller id; rows with the same id are candidates each, but never of a query with that id; query rows
that share an id are asked each, and each one's result is returned; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import materialise, renewed
from cellframe.llm.vectors import blocks, dealt, listed, matrix, paired, unpacked, usable

#: Bins of a histogram.
BINS = 4096


def _scores(row: tuple, structs: pa.StructArray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, row ids, their scores, and which of them count: those of a query with other rows' ids."""
    ids, vectors = unpacked(*row)
    wanted = matrix(structs, "v", row[2])
    scores = wanted.astype(np.int64) @ vectors.T.astype(np.int64) if wide else (wanted @ vectors.T).astype(np.int64)
    return structs.field("query").to_numpy(), ids, scores, structs.field("id").to_numpy()[:, None] != ids[None, :]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.StructArray]]:
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for k in range(len(batch)):
            yield (columns["ids"][k].as_py(), columns["vectors"][k].as_py(), columns["width"][k].as_py()), listed(columns["q"], k)


def _histogram(values: np.ndarray, inside: np.ndarray, low: np.ndarray, step: np.ndarray, need: np.ndarray, own: np.ndarray, downward: bool) -> pa.RecordBatch:
    """Counts of each query's values by bin, from the best bin to the one in which ``need`` is reached here."""
    at = np.where(inside, (values - low[:, None]) // step[:, None], 0).astype(np.int64)
    if downward:
        at = BINS - 1 - at
    at += np.arange(len(own))[:, None] * BINS
    counts = np.bincount(at[inside], minlength=len(own) * BINS).reshape(-1, BINS)
    before = np.cumsum(counts, axis=1) - counts
    q, b = np.nonzero((counts > 0) & (before < need[:, None]))
    return pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(b), pa.array(counts[q, b])], ["query", "bin", "n"])


def _narrowed(state: DataFrame, counts: DataFrame, low: str, step: int, downward: bool) -> DataFrame:
    """The state with the bin that holds the k-th best as its interval; queries without one keep theirs and are marked ``short``."""
    own = Window.partitionBy("query").orderBy("bin")  # at most BINS rows
    summed = counts.groupBy("query", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(own))
    place = F.lit(BINS - 1) - F.col("bin") if downward else F.col("bin")
    hit = summed.join(state.select("query", "need"), "query").where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    hit = hit.select("query", place.alias("_bin"), F.col("n").alias("_n"), (F.col("need") - F.col("upto") + F.col("n")).alias("_need"))
    return state.join(hit, "query", "left").select(
        "query", "id", "v", "part", "width",
        *[(F.coalesce(F.col(low) + F.col("_bin") * F.lit(step).cast("long"), F.col(low)) if c == low else F.col(c)).alias(c) for c in ("low", "id_low")],
        F.coalesce("_need", "need").alias("need"), F.coalesce("_n", "ties").alias("ties"), (F.col("short") | F.col("_n").isNull() if downward else F.col("short")).alias("short"),
    )


def _flags(structs: pa.StructArray) -> np.ndarray:
    return structs.field("short").to_numpy(zero_copy_only=False)[:, None]


def top_k(table: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best inner products of the vectors floor(scale * x)."""
    rows = usable(table, key, vector)
    row_blocks = materialise(blocks(rows, scale=scale))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    norm = F.aggregate(F.transform("v", lambda x: F.rint(x * scale)), F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1))
    most, first, last = rows.agg(F.max(norm), F.min("id"), F.max("id")).first()
    bound = int((most or 0.0) * 1.001) + 1  # no score lies outside, by Cauchy and Schwarz
    if 2 * bound + BINS >= 1 << 63:
        raise ValueError("these vectors are so long that a score can pass what a long holds")
    wide = bound >= 1 << 52
    first, last = first or 0, last or 0
    asked = materialise(rows.where(is_query(F.col("id"))).select(F.monotonically_increasing_id().alias("query"), "id", whole.alias("v")))
    queries, parts = dealt(asked, "query")
    state = materialise(queries.select("query", "id", "v", "part", "width", F.lit(-bound).cast("long").alias("low"), F.lit(first).cast("long").alias("id_low"), F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("ties"), F.lit(False).alias("short")))

    size = 2 * bound + 1
    while size > 1:
        step = -(-size // BINS)

        def by_score(batches: Iterator[pa.RecordBatch], size=size, step=step) -> Iterator[pa.RecordBatch]:
            for row, structs in _each(batches):
                own, _, scores, others = _scores(row, structs, wide)
                low = structs.field("low").to_numpy()
                inside = others & (scores >= low[:, None]) & (scores - low[:, None] < size) & ~_flags(structs)
                yield _histogram(scores, inside, low, np.full(len(own), step), structs.field("need").to_numpy(), own, True)

        counts = paired(row_blocks, state, parts).mapInArrow(by_score, "query long, bin long, n long")
        state = renewed(state, _narrowed(state, counts, "low", step, True))
        size = step

    size = last - first + 1
    while size > 1 and state.where("not short and ties > need").limit(1).count():
        step = -(-size // BINS)

        def by_id(batches: Iterator[pa.RecordBatch], size=size, step=step) -> Iterator[pa.RecordBatch]:
            for row, structs in _each(batches):
                own, ids, scores, others = _scores(row, structs, wide)
                low, need = structs.field("id_low").to_numpy(), structs.field("need").to_numpy()
                tied = others & (scores == structs.field("low").to_numpy()[:, None]) & ~_flags(structs)
                inside = tied & (ids >= low[:, None]) & (ids - low[:, None] < size)
                yield _histogram(np.broadcast_to(ids, scores.shape), inside, low, np.full(len(own), step), need, own, False)

        counts = paired(row_blocks, state, parts).mapInArrow(by_id, "query long, bin long, n long")
        state = renewed(state, _narrowed(state, counts, "id_low", step, False))
        size = step
    reach = size - 1 if size > 1 else 0

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, structs in _each(batches):
            own, ids, scores, others = _scores(row, structs, wide)
            low, id_low = structs.field("low").to_numpy()[:, None], structs.field("id_low").to_numpy()[:, None]
            keep = others & ((scores > low) | (scores == low) & (ids - id_low <= reach) | _flags(structs))
            q, r = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(structs.field("id").to_numpy()[q]), pa.array(ids[r]), pa.array(scores[q, r])], ["query", "query_id", "vec_id", "score"])

    kept = paired(row_blocks, state, parts).mapInArrow(found, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
