"""Packing, encoding and token counts against the libraries themselves."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cellframe.llm import bpe, packing, tokencounts

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "  ", "a<|endoftext|>b. <|ENDOFTEXT|>! x", "İ. aİ.. xक़!? ড়, 가. é. 3. ². Ⅻ; 你.", "İstanbul ﬁ. Ⅷ ²! naïve café. ÉCOLE GROß", "a.,b!c's I'll $5.00% é́ \x1c\x85", "</w> a</w> 你好。 世界 　", "ΑΣ ΣΑΣ.", "  a  b", "日本語\n\n", "<s> </s> <0x0A> 😀😀", "▁▁ ▁x", "word " * 3000, "long" * 4000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("abcde thinger \n.,1é😀", k=rng.randint(1, 80))) for _ in range(80)]
    rows = [(k, t, "clash", -1.0) for k, t in enumerate(texts)] + [(3, ODD[3], "again", 0.0), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, n_tokens double").repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoding_and_decoding(docs, tokenizer):
    expected = sorted(((r.doc_id is None, r.doc_id, ids_of(tokenizer, r.text)) for r in docs.collect()), key=str)
    encoded = bpe.encode_documents(docs, WORDS)
    assert sorted(((r.doc_id is None, r.doc_id, list(r.ids)) for r in encoded.collect()), key=str) == expected
    digests = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, WORDS).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == sorted(((n, d, len(i), sha(np.array(i, dtype="<u4").tobytes()), sha(tokenizer.decode(i, skip_special_tokens=False).encode())) for n, d, i in expected), key=str)
    decoded = sorted(((r.doc_id is None, r.doc_id, r.text) for r in bpe.decode_documents(encoded, WORDS).collect()), key=str)
    assert decoded == sorted(((n, d, tokenizer.decode(i, skip_special_tokens=False)) for n, d, i in expected), key=str)
    table = {r.word: list(r.ids) for r in bpe.word_table(docs, WORDS).collect()}
    assert all(ids_of(tokenizer, w) == i for w, i in table.items())


def test_every_letter_mark_and_number_before_trailing_punctuation(tokenizer):
    import unicodedata

    from cellframe.llm.wordtokens import TRAILING, encode_texts, word_encoder

    letters = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c))[0] in "LMN"]
    texts = [c + "." for c in letters] + ["a" + c + TRAILING[k % len(TRAILING)] for k, c in enumerate(letters) if k % 3 == 0]
    ids, ends = encode_texts(word_encoder(WORDS), pa.array(texts, pa.large_string()))
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert all(ids[a:b].tolist() == w for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), want, strict=True))
    word_encoder(WORDS).forget()


def test_pieces_cover_every_document_and_places_have_no_gap(docs, tokenizer):
    rows = packing.pack_documents(docs, WORDS, 64).collect()
    want = {}
    for r in docs.collect():
        ids = np.array(ids_of(tokenizer, r.text) + [0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[(r.doc_id, k)] = (at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert sum(n for _, n in own) <= 64 and all(o == sum(n for _, n in sorted(own)[:k]) for k, (o, _) in enumerate(sorted(own)))
    assert len(rows) == docs.count() - 1 - 1 + sum(1 for _, k in want if k) + 1 + sum(1 for (d, k) in want if d == 3) - sum(1 for (d, k) in want if d == 3 and k)
    joined = packing.packed_sequences(docs, WORDS, 64).collect()
    assert len(joined) == len(places) and sum(len(r.ids) for r in joined) == sum(r.length for r in rows)


def test_plan_uses_every_length_once_and_is_tight():
    rng = random.Random(1)
    for capacity in (8, 50, 200):
        lengths = [rng.randint(1, capacity) for _ in range(400)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = {}
        patterns = packing.plan_packing(counts, capacity)
        for times, members in patterns:
            assert sum(n * k for n, k in members) <= capacity
            for n, k in members:
                used[n] = used.get(n, 0) + times * k
        assert used == counts
        assert sum(t for t, _ in patterns) <= -(-sum(lengths) // capacity) * 1.03 + 1
    assert packing.plan_packing({}, 10) == []
    free = np.zeros(11, dtype=np.int64)
    free[[2, 3, 5]] = [1, 2, 1]
    assert packing.complement(free, 8) == [5, 3] and packing.complement(free, 6) == [3, 3] and sorted(packing.complement(free, 10)) == [2, 3, 5]
    assert packing.complement(free, 9) is None


def test_counts_of_all_prefixes(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.count_tokens(docs, PIECES, 20).collect()}
    assert rows == {(r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 20) for r in docs.collect()}
    short = docs.where("length(text) < 100 or text is null")
    texts = {r.doc_id: r.text or "" for r in short.collect()}
    table = {r.doc_id: list(r.counts) for r in tokencounts.prefix_table(short, PIECES).collect()}
    assert table == {d: [len(sp.encode(t[:k])) for k in range(len(t) + 1)] for d, t in texts.items()}
    fitting = {r.doc_id: r.fitting_chars for r in tokencounts.count_tokens(short, PIECES, 5).collect()}
    cut = {d: max(k for k, n in enumerate(c) if n <= 5) for d, c in table.items()}
    assert all(len(sp.encode(texts[d][: fitting[d]])) <= 5 for d in texts)
    assert fitting == cut
    kept = {r.doc_id: r.text for r in tokencounts.truncated(short.where("doc_id is not null").dropDuplicates(["doc_id"]), tokencounts.prefix_table(short.where("doc_id is not null").dropDuplicates(["doc_id"]), PIECES), 5).collect()}
    assert kept == {d: t[: cut[d]] for d, t in texts.items() if d is not None}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, WORDS).count() == bpe.round_trip_digests(empty, WORDS).count() == tokencounts.count_tokens(empty, PIECES).count() == 0


def test_every_four_positions_hold_a_covering_triple():
    from cellframe.llm.simhash import covering_triples

    triples = [set(t) for t in covering_triples()]
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))
