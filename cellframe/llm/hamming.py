"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors become 64-bit codes: the signs of a learned rotation (principal directions, then the rotation
that brings them closest to the corners of the cube).  Codes are cut into four substrings, and each
substring has an index: its buckets hold the rows by the substring's value.  Codes within ``radius``
bits of a query's agree with it up to a few bits in some substring (the pigeonhole principle), so
probing each index at the substrings within that many bits retrieves every code in the radius; the
vectors of these, and of no others, are then ranked by the inner product.

Neighboring buckets are kept in groups of about ROWS rows, by the leading bits of the substring's value.
Queries meet the groups that their probes reach in a join on (substring, group); groups that no probe
reaches are not touched, and long groups are dealt into blocks.  A pair is taken in the first substring
that retrieves it.  Index entries carry the vector in 16-bit steps, which finds each query's best
pairs within a proven error; the scores that are returned come from the vectors themselves.

The rotation and the radius are learnt from a sample of at most ``sample`` vectors, the radius such
that it holds ``target`` of the sample's pairs that are as near as a k-th neighbour among all rows.
Every row is indexed, but of more than k + 1 equal vectors the k + 1 of smallest id alone, as no query can
get another one.  Queries for which the radius holds fewer than k rows probe again with a radius that
holds all.

Vectors of unequal length get one more component, the root of what their squared length lacks to the
largest, so that codes follow the inner product.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
rows only meet queries of their own width; ties go to the smaller id; a query with fewer than k
candidates gets all; rows with the same id are candidates each, but never of a query with that id; query
rows that share an id are asked each, and each one's result is returned; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import materialise
from cellframe.llm.vectors import listed, usable

BITS, PARTS = 64, 4
#: Bits of a substring.
OWN = BITS // PARTS
#: Rows of a block of index entries, queries of a list, and queries whose pairs a task holds at once.
ROWS, QUERIES, TOGETHER = 16384, 1024, 64


def lengthened(vectors: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that brings them to the squared length ``most``."""
    return np.column_stack([vectors, np.sqrt(np.maximum(0.0, most - (vectors**2).sum(axis=1)))])


def learn_rotation(x: np.ndarray, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Columns whose signs are the code."""
    rng, width = np.random.default_rng(seed), x.shape[1]
    if width < BITS or len(x) < BITS:
        return np.column_stack([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-BITS // width))])[:, :BITS]
    directions = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BITS]
    turned = x @ directions
    rotation = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(turned @ rotation).T @ turned)
        rotation = w.T @ u.T
    return directions @ rotation


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(x @ rotation > 0, axis=1).view(np.uint64).ravel()


def learn_radius(x: np.ndarray, queries: np.ndarray, rotation: np.ndarray, share: float, target: float) -> int:
    """Smallest radius that holds ``target`` of the pairs among the best ``share`` of all."""
    probes = queries[:1024]
    scores = probes @ x.T
    scores[np.arange(len(probes)), np.arange(len(probes))] = -np.inf
    pairs = np.isfinite(scores)
    near = pairs & (scores >= np.quantile(scores[pairs], max(0.0, 1 - share)))
    apart = np.bitwise_count(codes(probes, rotation)[:, None] ^ codes(x, rotation)[None, :])[near]
    return int(np.quantile(apart, target, method="higher"))


def reaches(radius: int) -> list[int]:
    """Bits that each substring is probed with: of radius = PARTS * r + a, r in the first a + 1 and r - 1 in the others."""
    r, a = divmod(radius, PARTS)
    return [min(OWN, r if part <= a else r - 1) for part in range(PARTS)]


def _stepped(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in 16-bit steps and the size of each one's step."""
    size = np.maximum(np.abs(vectors).max(axis=1) / 32767, 1e-300)
    return np.rint(vectors / size[:, None]).astype(np.int16), size


def coded(rows: DataFrame, rotation: np.ndarray, most: float | None) -> DataFrame:
    """``rows`` (number, id, v of one width) with code, v in 16-bit steps and the step's size; ``most`` is None for queries."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                vectors = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
                longer = np.column_stack([vectors, np.zeros(len(vectors))]) if most is None else lengthened(vectors, most)
                steps, size = _stepped(vectors)
                columns = [*batch.columns, pa.array(codes(longer, rotation).view(np.int64)), pa.array([s.tobytes() for s in steps], pa.binary()), pa.array(size)]
                yield pa.RecordBatch.from_arrays(columns, ["number", "id", "v", "code", "steps", "size"])

    return rows.mapInArrow(code, "number long, id long, v array<double>, code long, steps binary, size double")


def _value(part: int, bits: int):
    """The leading ``bits`` of a substring of the code."""
    return F.shiftrightunsigned(F.col("code"), OWN * part + OWN - bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _dealt(entries: DataFrame, size: int, name: str) -> DataFrame:
    """Entries (part, group, entry) in lists of about ``size``."""
    counts = entries.groupBy("part", "group").agg(F.count("*").alias("_n"))  # a row a group
    share = F.pmod(F.xxhash64("entry.number"), F.ceil(F.col("_n") / size))
    return entries.join(counts, ["part", "group"]).groupBy("part", "group", share.alias("share")).agg(F.collect_list("entry").alias(name)).drop("share")


def index(rows: DataFrame, bits: int) -> DataFrame:
    """Blocks of the entries of each substring's groups of buckets."""
    places = F.array(*(F.struct(F.lit(p).alias("part"), _value(p, bits).alias("group")) for p in range(PARTS)))
    entries = rows.select(F.explode(places).alias("_at"), F.struct("number", "id", "code", "steps", "size").alias("entry"))
    return _dealt(entries.select("_at.part", "_at.group", "entry"), ROWS, "block")


def probes(queries: DataFrame, bits: int, radius: int) -> DataFrame:
    """Lists of the queries whose probes reach each group."""
    groups = F.sequence(F.lit(0), F.lit((1 << bits) - 1))

    def reached(part: int, reach: int):
        own = _value(part, bits)
        near = F.filter(groups, lambda g: F.bit_count(g.bitwiseXOR(own)) <= reach)
        return F.transform(near, lambda g: F.struct(F.lit(part).alias("part"), g.alias("group")))

    places = F.concat(*(reached(p, r) for p, r in enumerate(reaches(radius)) if r >= 0))
    entries = queries.select(F.explode(places).alias("_at"), F.struct("number", "id", "code", "steps", "size").alias("entry"))
    return _dealt(entries.select("_at.part", "_at.group", "entry"), QUERIES, "asked")


def within(part: int, query: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of codes within the radius that this substring's index is the first to retrieve."""
    apart = query[:, None] ^ own[None, :]
    q, r = np.nonzero(np.bitwise_count(apart) <= radius)
    substrings = np.bitwise_count(apart[q, r].view(np.uint16).reshape(-1, PARTS))
    first = (substrings <= np.array(reaches(radius))).argmax(axis=1) == part
    return q[first], r[first]


def _columns(structs: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    steps = np.frombuffer(b"".join(structs.field("steps").to_pylist()), dtype=np.int16).reshape(len(structs), -1)
    return structs.field("number").to_numpy(), structs.field("id").to_numpy(), structs.field("code").to_numpy().view(np.uint64), steps.astype(np.float64), structs.field("size").to_numpy()


def _near(q: np.ndarray, scores: np.ndarray, error: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs that can be among their query's k best, as each score is right up to its query's error."""
    order = np.lexsort((-scores, q))
    q, scores = q[order], scores[order]
    starts = np.searchsorted(q, q)
    last = np.minimum(starts + k, np.searchsorted(q, q, side="right")) - 1
    return order[scores >= scores[last] - 2 * error[q]]


def retrieve(blocks: DataFrame, asked: DataFrame, radius: int, k: int) -> DataFrame:
    """query, row, rough and error of the pairs within the radius that can be among a query's k best of a block."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(len(batch)):
                part = batch.column(0)[b].as_py()
                rows, ids, own, steps, size = _columns(listed(batch.column(1), b))
                queries, names, wanted, aims, scale = _columns(listed(batch.column(2), b))
                # Rounding to steps moves a vector by half a step in every component at most.
                half = math.sqrt(steps.shape[1]) / 2
                lengths, reach = np.sqrt((steps**2).sum(axis=1)) * size, np.sqrt((aims**2).sum(axis=1)) * scale
                error = (reach + scale * half) * (size.max() * half) + scale * half * lengths.max() + 1e-12 * reach * lengths.max()
                for at in range(0, len(queries), TOGETHER):
                    some = slice(at, at + TOGETHER)
                    q, r = within(part, wanted[some], own, radius)
                    other = names[some][q] != ids[r]
                    q, r = q[other], r[other]
                    rough = np.concatenate([np.einsum("ij,ij->i", aims[some][q[i : i + 8192]], steps[r[i : i + 8192]]) for i in range(0, len(q), 8192)] or [np.zeros(0)])
                    rough *= scale[some][q] * size[r]
                    kept = _near(q, rough, error[some], k)
                    yield pa.RecordBatch.from_arrays([pa.array(queries[some][q[kept]]), pa.array(rows[r[kept]]), pa.array(rough[kept]), pa.array(error[some][q[kept]])], ["query", "row", "rough", "error"])

    met = blocks.join(asked, ["part", "group"]).select("part", "block", "asked")
    return met.mapInArrow(probe, "query long, row long, rough double, error double")


def rank(pairs: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, query_id, rank, vec_id, score: the retrieved pairs' k best by the vectors themselves."""
    own = Window.partitionBy("query")
    placed = pairs.withColumn("_place", F.row_number().over(own.orderBy(F.desc("rough"))))
    least = F.max(F.when(F.col("_place") == k, F.col("rough"))).over(own) - 2 * F.max("error").over(own)
    kept = placed.withColumn("_least", least).where("_least is null or rough >= _least").select("query", "row")
    met = kept.join(rows.select(F.col("number").alias("row"), F.col("id").alias("vec_id"), "v"), "row")
    met = met.join(queries.select(F.col("number").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("aim")), "query")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v, aim = (batch.column(i).flatten().to_numpy().reshape(len(batch), -1) for i in (3, 4))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((aim * v).sum(axis=1))], ["query", "query_id", "vec_id", "score"])

    scored = met.select("query", "query_id", "vec_id", "v", "aim").mapInArrow(score, "query long, query_id long, vec_id long, score double")
    return scored.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def _without_repeats(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (id, v), of equal vectors those of the ``most`` smallest ids, and no more than ``most`` rows of an id."""
    marked = rows.withColumn("_mark", F.xxhash64("v"))
    many = materialise(marked.groupBy("_mark").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_mark"))
    if not many.limit(1).count():
        return rows
    # Both ranks are cut off before rows are dealt by vector, so that no task sees more than a part's few.
    copy = F.row_number().over(Window.partitionBy("v", "id").orderBy("_mark"))
    few = marked.join(many, "_mark", "left_semi").withColumn("_copy", copy).where(F.col("_copy") <= most)
    few = few.withColumn("_place", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_place") <= most)
    return marked.join(many, "_mark", "left_anti").select("id", "v").unionByName(few.select("id", "v"))


def nearest(table: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = 4096, target: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best inner products among the rows that the radius holds."""
    rows = usable(table, key, vector, nonzero=True)
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    results = None
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(squared).alias("most")).orderBy("width")
    for width, n, most in sizes.toLocalIterator():
        own = rows.where(F.size("v") == width)
        thin = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < F.lit(max(1, (sample << 20) // n))
        chosen = own.where(thin).orderBy(F.xxhash64("id", "v"), "id").limit(2 * sample)
        raw = np.array([r["v"] for r in chosen.select("v").collect()]).reshape(-1, width)  # at most 2 * sample rows
        x = lengthened(raw, most)
        rotation = learn_rotation(x)
        asked = np.column_stack([raw, np.zeros(len(raw))])
        radius = learn_radius(x, asked, rotation, k / max(n - 1, 1), target) if len(raw) > k else BITS
        numbered = F.monotonically_increasing_id().alias("number")
        indexed = materialise(coded(_without_repeats(own, k + 1).select(numbered, "id", "v"), rotation, most))
        queries = materialise(coded(own.where(is_query(F.col("id"))).select(numbered, "id", "v"), rotation, None))
        bits = min(OWN, max(0, math.ceil(math.log2(n / ROWS))))
        blocks = index(indexed, bits)
        pairs = materialise(retrieve(blocks, probes(queries, bits, radius), radius, k))
        found = materialise(rank(pairs, indexed, queries, k))
        enough = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query").alias("number"))
        short = materialise(queries.join(enough, "number", "left_anti"))
        if radius < BITS and short.limit(1).count():
            again = rank(materialise(retrieve(blocks, probes(short, bits, BITS), BITS, k)), indexed, short, k)
            found = found.join(short.select(F.col("number").alias("query")), "query", "left_anti").unionByName(again)
        results = found if results is None else results.unionByName(found)
    if results is None:
        results = table.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return results.select("query_id", "rank", "vec_id", "score")
