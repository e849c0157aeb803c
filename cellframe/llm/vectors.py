"""Blocks of vectors, as the search operators pass them to their kernels.

A vector takes part if it is not null, not empty and every component is a finite number.  Rows are
packed where they are read, block by block, so packing needs no shuffle.  Queries are dealt into
blocks of bounded size; each pair of a query block and a row block is one kernel call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of candidates and of a block of queries.
ROWS, QUERIES = 4096, 1024
BLOCK = "ids binary, vectors binary, width int"


def usable(table: DataFrame, key: str, vector: str, nonzero: bool = False) -> DataFrame:
    """id and v (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad)
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def blocks(rows: DataFrame, size: int = ROWS, scale: float | None = None) -> DataFrame:
    """``rows`` (id, v) in blocks of ``size`` rows of one width; with ``scale``, components become floor(scale * x)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(width: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(width), strict=True)
            ids, vectors = np.concatenate(ids), np.concatenate(vectors)
            return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([vectors.tobytes()]), pa.array([width], pa.int32())], ["ids", "vectors", "width"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            offsets, flat = np.asarray(lists.offsets), lists.values.to_numpy()
            sizes = np.diff(offsets)
            for width in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == width)
                vectors = flat[offsets[at][:, None] + np.arange(width)]
                if scale is not None:
                    vectors = np.floor(scale * vectors)
                for k in range(0, len(at), size):
                    held.setdefault(width, []).append((ids[at[k : k + size]], vectors[k : k + size]))
                    if sum(len(i) for i, _ in held[width]) >= size:
                        yield block(width)
        for width in list(held):
            yield block(width)

    return rows.mapInArrow(pack, BLOCK)


def unpacked(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(vectors, dtype=np.float64).reshape(-1, width)


def dealt(queries: DataFrame, key: str = "id") -> tuple[DataFrame, int]:
    """``queries`` (``key``, v) with their part, and the number of parts, which leaves about QUERIES rows in each."""
    parts = max(1, -(-queries.count() // QUERIES))
    return queries.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("width", F.size("v")), parts


def paired(row_blocks: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """Every block of rows beside every part of the ``queries`` of its width, as the list q."""
    named = [c for c in queries.columns if c not in ("part", "width")]
    lists = queries.groupBy("part", "width").agg(F.collect_list(F.struct(*named)).alias("q"))  # about QUERIES rows
    spread = row_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread.join(lists, ["part", "width"]).drop("part")


def listed(queries: pa.Array, k: int) -> pa.StructArray:
    """The queries beside block ``k`` of a batch."""
    offsets = queries.offsets
    start, end = offsets[k].as_py(), offsets[k + 1].as_py()
    return queries.values.slice(start, end - start)


def matrix(structs: pa.StructArray, name: str, width: int) -> np.ndarray:
    return structs.field(name).flatten().to_numpy().reshape(-1, width)
