"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, of order four.  Its counts cover all trusted documents and are sharded
by n-gram; lower orders are continuation counts of the order above, discounts come from the counts of
counts.  A probability is found for every distinct n-gram of the corpus by joins of the count tables.

Documents stay where they are: they are stored once in chunks of bounded size, bucketed by chunk, and
what moves is each chunk's list of distinct n-grams, to the shards and back.  A document's
log-perplexity is shrunk towards its language's mean by ``SHRINK`` characters, so that chance does not
decide over short texts, and rejected if it exceeds the threshold of its language: a quantile of the
language's trusted documents plus a margin.  A model finds the documents that trained it less
perplexing than others like them, so for means and thresholds each trusted document is read by the
model of the fold that it is not in; two folds, equal texts in one, are counted side by side in the
same tables.  A language with fewer than ``FEWEST`` trusted documents has no such quantile of its own:
it takes its mean plus the quantile of how far the documents of all languages lie from their means.

Defined cases: null and empty texts have no n-gram, perplexity null, and are rejected; null is a
language of its own; languages without trusted documents take the threshold of all; without trusted
documents all with text are kept; repeated rows are judged each; an empty table gives an empty result;
further columns pass through ``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.llm.common import bucketed, filled, let_go, materialise, text_slices

ORDER = 4
#: Bytes of text of a chunk.
CHUNK_BYTES = 16 << 20
#: What stands before the first character and behind the last.
START, END = "\x02", "\x03"
#: Characters of the language's mean that each document is mixed with.
SHRINK = 64
#: Share of a language's trusted documents under the threshold, and nats above it that are still kept.
QUANTILE, MARGIN = 0.99, 0.05
#: Trusted documents from which a language has a quantile of its own.
FEWEST = 100
#: The folds of the trusted documents, and the models: the one of all, and each fold's own.
FOLDS = ("n0", "n1")
MODELS = ("n", *FOLDS)


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns chunk and row in front, stored in buckets of whole chunks; names are made unique by number."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = docs.columns.index("text")
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("row", T.LongType()), *plain.schema.fields])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, row, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for a, b in text_slices(batch, text):
                part = batch.slice(a, b - a)
                rows = [pa.array(np.full(len(part), chunk)), pa.array(np.arange(row, row + len(part)))]
                yield pa.RecordBatch.from_arrays(rows + part.columns, ["chunk", "row", *names])
                row, size = row + len(part), size + part.column(text).nbytes
                if size > CHUNK_BYTES:
                    chunk, row, size = chunk + 1, 0, 0

    return bucketed(plain.mapInArrow(number, schema), "chunk")


class Grams:
    """The n-grams of many texts as numbers: pairs of numbers of pairs of characters."""

    def __init__(self, texts: list[str]):
        joined = "".join(START * (ORDER - 1) + t.replace(START, " ").replace(END, " ") + END if t else "" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        #: n-grams of each text: one for each character and one for its end
        self.sizes = np.where(sizes > 0, sizes + 1, 0)
        self.alphabet, own = _numbered(points)
        pairs = own[:-1].astype(np.int64) * len(self.alphabet) + own[1:]
        self.pairs, numbers = _numbered(pairs)
        codes = numbers[:-2].astype(np.int64) * len(self.pairs) + numbers[2:] if len(numbers) > 2 else np.zeros(0, np.int64)
        starts = np.where(self.sizes > 0, np.cumsum(self.sizes + np.where(self.sizes > 0, ORDER - 1, 0)) - self.sizes - (ORDER - 1), 0)
        kept = np.zeros(len(codes) + ORDER, dtype=bool)
        for s, n in zip(starts[self.sizes > 0].tolist(), self.sizes[self.sizes > 0].tolist(), strict=True):
            kept[s : s + n] = True
        self.codes = codes[kept[: len(codes)]]

    def spelled(self, codes: np.ndarray) -> np.ndarray:
        """The n-grams of ``codes`` as strings."""
        pairs = np.stack([self.pairs[codes // len(self.pairs)], self.pairs[codes % len(self.pairs)]], axis=1)
        points = np.stack([self.alphabet[pairs // len(self.alphabet)], self.alphabet[pairs % len(self.alphabet)]], axis=2)
        return np.ascontiguousarray(points.reshape(-1, ORDER).astype("<u4")).view(f"<U{ORDER}").ravel()


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and each value's number among them; values are small numbers."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    there = np.zeros(int(values.max()) + 1, dtype=bool)
    there[values] = True
    distinct = np.flatnonzero(there)
    numbers = np.zeros(len(there), dtype=np.int32)
    numbers[distinct] = np.arange(len(distinct))
    return distinct, numbers[values]


def _text_parts(table: pa.Table, text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Rows a to b of ``table`` and their texts, about a megabyte at a time."""
    batch = pa.RecordBatch.from_arrays([filled(table.column(text).combine_chunks())], ["text"])
    for a, b in text_slices(batch, 0, 1 << 20):
        yield a, b, batch.column(0).slice(a, b - a).to_pylist()


def fold(text: str) -> int:
    """The fold of a trusted text."""
    return xxhash.xxh64_intdigest(text) & 1


def gram_counts(chunks: DataFrame, text: str, trusted: DataFrame) -> DataFrame:
    """chunk, gram, n0, n1: every n-gram of a chunk with its counts in either fold of the chunk's ``trusted`` rows (chunk, row)."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.column("row").to_numpy()
        good = np.isin(rows, right.column("row").to_numpy())
        tables = []
        for a, b, texts in _text_parts(left, text):
            grams = Grams(texts)
            distinct, numbers = np.unique(grams.codes, return_inverse=True)
            folds = np.array([fold(t) if g else -1 for t, g in zip(texts, good[a:b].tolist(), strict=True)])
            counts = [np.bincount(numbers[np.repeat(folds == k, grams.sizes)], minlength=len(distinct)).astype(np.int64) for k in (0, 1)]
            tables.append(pa.table({"gram": pa.array(grams.spelled(distinct).astype(object), pa.string()), "n0": counts[0], "n1": counts[1]}))
        summed = pa.concat_tables(tables).group_by("gram").aggregate([("n0", "sum"), ("n1", "sum")])
        let_go()
        chunk = pa.array(np.full(len(summed), left.column("chunk")[0].as_py() if len(left) else 0))
        return pa.table([chunk, summed.column("gram"), summed.column("n0_sum"), summed.column("n1_sum")], names=["chunk", "gram", *FOLDS])

    schema = "chunk long, gram string, n0 long, n1 long"
    return chunks.select("chunk", "row", text).groupBy("chunk").cogroup(trusted.groupBy("chunk")).applyInArrow(count, schema)


def discounts(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """For each model the three modified Kneser-Ney discounts from the counts of counts."""
    of = {(m, i): F.count_if(F.col(m) == i).alias(f"{m}_{i}") for m in MODELS for i in (1, 2, 3, 4)}
    row = counts.agg(*of.values()).first()
    result = {}
    for m in MODELS:
        n1, n2, n3, n4 = (row[f"{m}_{i}"] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        result[m] = tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))
    return result


def model_tables(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from four down, with a column for each model: (gram, own), the discounted share of an n-gram, and (context, rest), what is left for lower orders."""
    tables = []
    for order in range(ORDER, 0, -1):
        counts = materialise(counts)
        off = {m: F.when(F.col(m) == 0, 0.0).when(F.col(m) == 1, d[0]).when(F.col(m) == 2, d[1]).otherwise(d[2]) for m, d in discounts(counts).items()}
        context = F.substring("gram", 1, order - 1) if order > 1 else F.lit("")
        sums = counts.groupBy(context.alias("context")).agg(*[F.sum(m).alias(f"total_{m}") for m in MODELS], *[F.sum(off[m]).alias(f"off_{m}") for m in MODELS])
        # A context that a model never has leaves all to lower orders.
        rest = sums.select("context", *[f"total_{m}" for m in MODELS], *[F.when(F.col(f"total_{m}") > 0, F.col(f"off_{m}") / F.col(f"total_{m}")).alias(f"rest_{m}") for m in MODELS])
        own = counts.withColumn("context", context).join(rest, "context").select("gram", *[F.when(F.col(m) > 0, (F.col(m) - off[m]) / F.col(f"total_{m}")).alias(f"own_{m}") for m in MODELS])
        tables.append((own, rest.select("context", *[f"rest_{m}" for m in MODELS])))
        counts = counts.groupBy(F.substring("gram", 2, order - 1).alias("gram")).agg(*[F.count_if(F.col(m) > 0).alias(m) for m in MODELS])
    return tables


def gram_probabilities(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """gram and logp_n, logp_n0, logp_n1 for every one of ``grams`` under each model of ``counts`` (gram, n, n0, n1); null under a model of nothing."""
    tables = model_tables(counts)
    symbols = tables[-1][0].agg(*[F.count(f"own_{m}").alias(m) for m in MODELS]).first()
    # One more for what trusted text never has.
    found = grams.select("gram", *[F.lit(1.0 / (symbols[m] + 1) if symbols[m] or m == "n" else None).cast("double").alias(f"p_{m}") for m in MODELS])
    for order, (own, rest) in zip(range(1, ORDER + 1), reversed(tables), strict=True):
        tail = F.substring("gram", ORDER - order + 1, order)
        found = found.withColumn("_g", tail).withColumn("_c", F.substring("gram", ORDER - order + 1, order - 1) if order > 1 else F.lit(""))
        found = found.join(own.withColumnRenamed("gram", "_g"), "_g", "left").join(rest.withColumnRenamed("context", "_c"), "_c", "left")
        found = found.select("gram", *[(F.coalesce(f"own_{m}", F.lit(0.0)) + F.coalesce(f"rest_{m}", F.lit(1.0)) * F.col(f"p_{m}")).alias(f"p_{m}") for m in MODELS])
    return found.select("gram", *[F.log(f"p_{m}").alias(f"logp_{m}") for m in MODELS])


def surprise(chunks: DataFrame, text: str, probabilities: DataFrame) -> DataFrame:
    """chunk, row, grams, nats, held: how many n-grams a row has, minus the sum of their log-probabilities, and that by the other fold's model, which holds for trusted rows."""

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("gram").to_numpy().astype(f"<U{ORDER}") if len(right) else np.zeros(0, f"<U{ORDER}")
        order = np.argsort(names)
        names, values = names[order], right.column("logp").to_numpy()[order]
        others = [np.nan_to_num(right.column(c).to_numpy()[order].astype(float)) for c in ("held0", "held1")]
        sizes, nats, held = [], [], []

        def sums(of: np.ndarray, grams: Grams, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            """Minus the sum of each text's values."""
            behind = np.concatenate([[0.0], np.cumsum(of[at][numbers])])
            ends = np.cumsum(grams.sizes)
            return -(behind[ends] - behind[ends - grams.sizes])

        for _, _, texts in _text_parts(left, text):
            grams = Grams(texts)
            distinct, numbers = np.unique(grams.codes, return_inverse=True)
            at = np.searchsorted(names, grams.spelled(distinct)) if len(distinct) else np.zeros(0, np.int64)
            sizes.append(grams.sizes)
            nats.append(sums(values, grams, at, numbers))
            folds = np.array([fold(t) for t in texts])
            held.append(np.where(folds == 0, *(sums(o, grams, at, numbers) for o in others)))
        let_go()
        return pa.table([left.column("chunk"), left.column("row"), *(pa.array(np.concatenate(v)) for v in (sizes, nats, held))], names=["chunk", "row", "grams", "nats", "held"])

    schema = "chunk long, row long, grams long, nats double, held double"
    return chunks.select("chunk", "row", text).groupBy("chunk").cogroup(probabilities.groupBy("chunk")).applyInArrow(read, schema)


def _judged(chunks: DataFrame, columns: list[str], trusted_ids: DataFrame, quantile: float, margin: float) -> DataFrame:
    """chunk, row, doc_id, lang, perplexity, threshold, keep of every stored row."""
    doc_id, text, lang = (f"c{columns.index(c)}" for c in ("doc_id", "text", "lang"))
    keys = materialise(chunks.select("chunk", "row", F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang")))
    trusted = materialise(keys.join(trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").select("chunk", "row"))
    grams = materialise(gram_counts(chunks, text, trusted))
    counts = grams.groupBy("gram").agg(*[F.sum(n).alias(n) for n in FOLDS]).withColumn("n", F.col("n0") + F.col("n1"))
    probabilities = materialise(gram_probabilities(counts.select("gram"), counts.where("n > 0")))
    # Only the rows of the one fold are read by the other's model; a fold of nothing leaves all to the model of all.
    values = grams.join(probabilities, "gram").select("chunk", "gram", F.col("logp_n").alias("logp"), *[F.when(F.col(own) > 0, F.coalesce(f"logp_{other}", "logp_n")).alias(f"held{k}") for k, (own, other) in enumerate(zip(FOLDS, reversed(FOLDS), strict=True))])
    read = materialise(surprise(chunks, text, values))
    rows = keys.join(read, ["chunk", "row"]).join(trusted.withColumn("trusted", F.lit(True)), ["chunk", "row"], "left").fillna({"trusted": False})
    # Means and quantiles of a language are aggregated piecewise; nothing is gathered by language.
    basis = rows.where("trusted and grams > 0")
    mean = lambda of: (F.sum("held") / F.sum("grams")).alias(of)
    overall = basis.agg(mean("all_mean"))
    shrunk = lambda nats: (F.col(nats) + SHRINK * F.col("mean")) / (F.col("grams") + SHRINK)
    means = basis.groupBy("lang").agg(mean("own_mean")).withColumnRenamed("lang", "mean_lang")
    rows = rows.join(means, F.col("lang").eqNullSafe(F.col("mean_lang")), "left").crossJoin(F.broadcast(overall)).withColumn("mean", F.coalesce("own_mean", "all_mean", F.lit(0.0)))
    rows = materialise(rows.withColumn("level", F.when(F.col("grams") > 0, shrunk("nats"))).withColumn("held", F.when(F.col("trusted") & (F.col("grams") > 0), shrunk("held"))).select("chunk", "row", "doc_id", "lang", "grams", "nats", "mean", "level", "held"))
    at = lambda of: F.percentile_approx(of, F.lit(quantile), F.lit(10_000))
    basis = rows.where("held is not null")
    limits = basis.groupBy("lang").agg(F.when(F.count("*") >= FEWEST, at("held")).alias("own_limit"), F.first("mean").alias("_mean")).withColumnRenamed("lang", "limit_lang")
    limited = rows.join(limits, F.col("lang").eqNullSafe(F.col("limit_lang")), "left").crossJoin(F.broadcast(basis.agg(at("held").alias("all_limit"), at(F.col("held") - F.col("mean")).alias("all_beyond"))))
    limit = F.coalesce("own_limit", F.col("_mean") + F.col("all_beyond"), "all_limit") + margin
    keep = F.col("level").isNotNull() & (limit.isNull() | (F.col("level") <= limit))
    return limited.select("chunk", "row", "doc_id", "lang", F.when(F.col("grams") > 0, F.exp(F.col("nats") / F.col("grams"))).alias("perplexity"), F.exp("level").alias("level"), F.exp(limit).alias("threshold"), keep.alias("keep"))


def judge(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, perplexity, level (shrunk perplexity), threshold and keep of every document."""
    slim = docs.select("doc_id", "text", "lang")
    return _judged(chunked(slim), slim.columns, trusted_ids, quantile, margin).drop("chunk", "row")


def keep_good(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    chunks = chunked(docs)
    kept = materialise(_judged(chunks, docs.columns, trusted_ids, quantile, margin).where("keep").select("chunk", "row"))
    names = [f"c{i}" for i in range(len(docs.columns))]

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        return left.filter(pc.is_in(left.column("row"), right.column("row").combine_chunks())).select(names)

    schema = T.StructType([f for f in chunks.schema.fields if f.name in names])
    good = chunks.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(chosen, schema)
    return good.toDF(*docs.columns)
