"""The registered queries: columns, types, held-out rows, and what their digests must agree with."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cellframe.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_best_fit_packing": "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    "op2_simhash_near_dedup": "doc_id long, fingerprint string, component_id long",
    "op4_language_id": "doc_id long, held_out boolean, lang_pred string, score double",
    "op5_exact_top_k": "query_id long, rank int, vec_id long, score long",
    "op6_bpe_round_trip": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op8_multi_index_hashing": "query_id long, rank int, vec_id long, score double",
    "op9_toxicity": "doc_id long, held_out boolean, score double, predicted int",
    "op10_token_counts": "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, FOLDER) for name, query in queries.queries().items()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_columns_and_types(results):
    assert len(results) == 13
    for name, columns in COLUMNS.items():
        types = dict(results[name].dtypes)
        for column in columns.split(", "):
            column, kind = column.split()
            assert types[column] == {"long": "bigint"}.get(kind, kind), (name, column)


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ("op1_best_fit_packing", "op5_exact_top_k", "op8_multi_index_hashing")] + ["op7_quality_perplexity"])
def test_one_row_a_document(results, docs, name):
    assert sorted(r.doc_id for r in results[name].collect()) == sorted(docs)


def test_language_is_held_out_by_the_id_and_right(results, docs):
    rows = results["op4_language_id"].collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang]
    assert len(right) > 20 and np.mean(right) >= 0.9
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", docs[r.doc_id].text or "")) for r in rows)


def test_toxicity_is_held_out_by_the_id_and_predicted_by_the_score(results):
    rows = results["op9_toxicity"].collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_digests_are_those_of_the_libraries(results, docs):
    import sentencepiece
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    words.no_truncation()
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_BPE))
    ids = {d: words.encode(r.text or "", add_special_tokens=False).ids for d, r in docs.items()}
    for r in results["op6_bpe_round_trip"].collect():
        own = np.array(ids[r.doc_id], dtype="<u4").tobytes()
        decoded = words.decode(ids[r.doc_id], skip_special_tokens=False).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(own).hexdigest(), hashlib.sha256(decoded).hexdigest())
    for r in results["op10_token_counts"].collect():
        text = docs[r.doc_id].text or ""
        n = len(pieces.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
    places = {}
    for r in results["op1_best_fit_packing"].collect():
        part = np.array([*ids[r.doc_id], 0], dtype="<u4")[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(part) == r.length <= 2048 and zlib.crc32(part.tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(n for own in places.values() for _, n in own) == sum(len(i) + 1 for i in ids.values())
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(own)] == [0, *ends[:-1]]


def test_searches_against_brute_force(results, spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("embedding is not null").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    whole = np.floor(1024 * x).astype(np.int64)
    exact = {}
    for q in ids[ids % 100 == 0]:
        scores = whole @ whole[ids == q][0]
        best = [(int(ids[i]), int(scores[i])) for i in np.lexsort((ids, -scores)) if ids[i] != q][:10]
        exact |= {(q, n + 1): pair for n, pair in enumerate(best)}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in results["op5_exact_top_k"].collect()} == exact
    hits, found = 0, {}
    for r in results["op8_multi_index_hashing"].collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert sorted(found) == sorted(ids[ids % 20 == 0])
    for q, own in found.items():
        scores = x @ x[ids == q][0]
        hits += len(set(own) & set([int(ids[i]) for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]))
        assert len(own) == 20 and all(s == pytest.approx(float(scores[ids == v][0]), abs=1e-12) for v, s in own.items())
    assert hits >= 0.9 * 20 * len(found)


def test_quality_and_calls(results, spark):
    assert {"doc_id", "perplexity", "keep"} <= set(results["op7_quality_perplexity"].columns)
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet").where(F.col("role").isin("system", "user")).count()
    assert results["op3_tool_call_linking"].count() == turns
