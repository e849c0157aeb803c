"""The registered queries of the training-data operators and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import bpe, chat, hamming, importance, language, lexical, mixing, packing, quality, simhash, tokencounts, topk, toxicity
from cellframe.llm.common import crc_mod

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    linked = chat.link_turns(table(spark, folder, "conversations"))
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    told = language.identify(docs, language.train(docs.where(~held_out)))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), lambda i: i % 100 == 0)


def op6_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op7_quality_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return quality.judge(table(spark, folder, "documents"), trusted)


def op8_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return hamming.nearest(table(spark, folder, "embeddings"), lambda i: i % 20 == 0)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(PIECE_BPE))


def op11_best_position_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


def op12_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL = {
    "op3_tool_call_linking": """
        WITH RECURSIVE calls AS (
            SELECT CAST(conv_id AS VARCHAR) AS conversation, concat(conv_id, ':', turn) AS call_id, turn, text,
                   CASE role WHEN 'system' THEN 'configure' ELSE 'respond' END AS name,
                   concat(conv_id, ':', turn - 1) AS dep1, concat(conv_id, ':', turn - 2) AS dep2
            FROM conversations WHERE role IN ('system', 'user')
        ), edges AS (
            SELECT c.call_id, d.call_id AS dep FROM calls c JOIN calls d ON d.call_id IN (c.dep1, c.dep2)
        ), walks AS (
            SELECT call_id, 0 AS level FROM calls
            UNION
            SELECT e.call_id, w.level + 1 FROM edges e JOIN walks w ON w.call_id = e.dep
        ), levels AS (
            SELECT call_id, max(level) AS level FROM walks GROUP BY call_id
        ), answers AS (
            SELECT concat(conv_id, ':', turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
            FROM conversations WHERE role = 'assistant' GROUP BY ALL
        )
        SELECT c.conversation, c.call_id, CAST(l.level AS INTEGER) AS level,
               CASE WHEN c.text IS NULL THEN 'invalid' WHEN a.n_results IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
               CASE WHEN c.text IS NULL THEN 'prompt is missing' ELSE '' END AS errors, CAST(a.n_results AS BIGINT) AS n_results,
               CAST(to_json({'arguments': {'prompt': c.text, 'turn': c.turn}, 'id': c.call_id, 'name': c.name, 'result': a.content}) AS VARCHAR) AS message
        FROM calls c JOIN levels l USING (call_id) LEFT JOIN answers a USING (call_id)""",
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op11_best_position_search": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), sized AS (
            SELECT row, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0
        ), total AS (
            SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM sized
        ), items AS (
            SELECT row_number() OVER () AS item, item_id, text FROM benchmark
        ), wanted AS (
            SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM items
        ), tokens AS (
            SELECT row, doc_id, n, unnest(terms) AS term FROM sized
        ), postings AS (
            SELECT row, doc_id, n, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * CAST(N_ AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM postings, total GROUP BY term, N_
        ), impacts AS (
            SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * N_) // L_))) AS impact
            FROM postings JOIN weights USING (term), total
        ), scores AS (
            SELECT item, item_id, row, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL
        ), ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scores WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_importance_resampling": r"""
        WITH crc_step AS (
            SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)
        ), crc_table AS (
            SELECT list(v ORDER BY i) AS steps FROM crc_step
        ), docs AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), targets AS (
            SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
        ), features AS (
            SELECT row, unnest(words) AS word FROM docs
        ), spelled AS (
            SELECT word, list_transform(range(len(hex(encode(word))) // 2), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes
            FROM (SELECT word FROM features UNION SELECT word FROM targets)
        ), hashed AS (
            SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
            FROM spelled, crc_table
        ), s AS (
            SELECT bucket, count(*) AS s FROM features JOIN hashed USING (word) GROUP BY bucket
        ), t AS (
            SELECT bucket, count(*) AS t FROM targets JOIN hashed USING (word) GROUP BY bucket
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM features) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM targets) + 10000)))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket)
        ), weights AS (
            SELECT row, sum(gain) AS weight FROM features JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row
        ), scored AS (
            SELECT row, doc_id, coalesce(len(words), 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
            FROM docs LEFT JOIN weights USING (row)
        ), noisy AS (
            SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored
        ), ranked AS (
            SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM noisy WHERE n_features >= 20
        )
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
        FROM noisy LEFT JOIN ranked USING (row)""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
