"""Lexical search, mixing and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cellframe.llm import importance, lexical, mixing, queries

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score int, term string, rank long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain_search(docs, items, k=10):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    found = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        found += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return found


def awkward(rng, n=160):
    """Rows with ties, repeats, nulls, empty and long texts."""
    words = [*"abcdefghij", "Ab", "é", "x9", "the"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(n)]
    rows = [(int(i), t, f"s{i % 5}") for i, t in enumerate(texts)]
    rows += rows[:9] * 4 + [(900 + i, texts[3], "s1") for i in range(30)] + [(7, "other A-b_c", "s2")] * 3
    rows += [(None, texts[5], None), (None, "zz", None), (1001, None, "s3"), (1002, "", None), (1003, " \t., !", "s0"), (1004, " ".join(texts) * 3, "S"), (1005, "ZZ zz" * 5000, "empty")]
    rows += [(1006, None, "void")]
    return [(*r, 1, "q", 3) for r in rows]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [(2 << 20, 1 << 15), (300, 8)])
def test_search_equals_scoring_everything(spark, monkeypatch, sizes):
    rng = np.random.default_rng(1)
    rows = awkward(rng)
    items = [(1, "a b c the"), (2, "zz"), (3, None), (4, "nowhere"), (5, "A é x9 x9 j"), (5, "j"), (None, "a"), (6, " ".join(r[1] or "" for r in rows))]
    monkeypatch.setattr(lexical, "SHARD_BYTES", sizes[0])
    monkeypatch.setattr(lexical, "SHARD_ROWS", sizes[1])
    monkeypatch.setattr(lexical, "PART_TERMS", 20)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, 5, "x") for i in items], "item_id long, text string, item int, score string")
    found = lexical.search(lexical.build(docs), asked)
    assert as_rows(found) == sorted(plain_search([r[:2] for r in rows], items), key=repr)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(lexical.build(docs.limit(0)), asked).count() == lexical.search(lexical.build(docs), asked.limit(0)).count() == 0


def test_reading_stops_before_the_end_of_the_lists():
    n, rng = 4000, np.random.default_rng(2)
    rows = np.concatenate([rng.permutation(n) for _ in range(3)]).astype(np.uint16)
    impacts = np.concatenate([np.sort((rng.pareto(2, n) * 1000).astype(np.int64))[::-1] for _ in range(3)])
    lists = lexical._Lists(rows, impacts, np.arange(3) * n, np.full(3, n), n)
    found, scores = lists.best(10, 0)
    total = np.zeros(n, np.int64)
    np.add.at(total, rows, impacts)
    assert len(found) < n / 2 and (total[found] == scores).all()
    assert sorted(scores)[-10:] == sorted(total)[-10:]
    assert len(lists.best(10, int(total.max()))[0]) <= len(found)


def plain_targets(sizes, repeats=3):
    """The water level by bisection: each source gets min(its weight times the level, three times its size)."""
    weight = [1 + i % 3 for i in range(len(sizes))]
    low, high = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w * mid, repeats * s) for w, s in zip(weight, sizes)) < sum(sizes) else (low, mid)
    return [min(w * high, repeats * s) for w, s in zip(weight, sizes)]


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = awkward(rng) + [(2000 + i, "w " * int(rng.integers(1, 90)), "hot", 1, "q", 3) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.taken_words(docs.repartition(3)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r["size"]) for r in found) == sorted((r[0] or -1, size(r[1])) for r in rows)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    sums = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in names}
    targets = dict(zip(names, plain_targets([sums[s] for s in names])))
    by_target = Counter()
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        by_target[r.source_size] += r.taken
    assert {round(r.target, 3) for r in found} == {round(t, 3) for t in targets.values()}
    for s in names:
        assert abs(by_target[sums[s]] - targets[s]) <= 1.5 * mixing.BLOCK, s
    again = mixing.taken_words(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_slots_hold_what_was_drawn(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 64)
    monkeypatch.setattr(mixing, "GROUP", 3)
    sources = [mixing.Source("a", 64 * 400 - 5), mixing.Source("b", 64 * 90), mixing.Source("c", 64 * 700)]
    mixing.set_targets(sources)
    assert [s.target / s.size for s in sources][1] == 3.0 and sum(s.target for s in sources) == pytest.approx(sum(s.size for s in sources))
    found = mixing.slots(spark, sources, 5).collect()
    for k, s in enumerate(sources):
        used = Counter(r.block for r in found if r.number == k)
        assert sum(used.values()) == s.slots and max(used.values()) - min(used.get(b, 0) for b in range(s.blocks)) <= 1
    for shard in {r.shard for r in found}:
        own = [r for r in found if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= 64
    shares = np.array([[sum(r.number == k for r in found if r.shard == shard) for k in range(3)] for shard in {r.shard for r in found if r.shard < 10}])
    want = 64 * np.array([s.slots for s in sources]) / sum(s.slots for s in sources)
    assert shares.std(axis=0).min() > 1 and np.abs(shares.mean(axis=0) - want).max() < 5


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        orders = [mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key)) for key in (1, 2)]
        assert all(sorted(o) == list(range(n)) for o in orders) and (n < 10 or (orders[0] != orders[1]).any())


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_resampling(docs, targets, longest, buckets=10_000):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in targets for b in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    found = []
    for d, x in docs:
        own = features(x)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        found.append((d, len(words_of(x)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    good = sorted((r for r in found if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = good[: len(good) // 10]
    rest = [r for r in found if r[1] < 20] + good[len(drawn) :]
    return [(*r, i + 1) for i, r in enumerate(drawn)] + [(*r, None) for r in rest]


@pytest.mark.parametrize("longest, share", [(1, importance.SHARE), (1, 0.05), (2, 0.02), (3, 1.0)])
def test_resampling_equals_plain_counting(spark, monkeypatch, longest, share):
    monkeypatch.setattr(importance, "RANGE", 40)
    rows = awkward(np.random.default_rng(4))
    targets = ["a b the", None, "zz é", "é é x9 a b"]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "score long, text string")
    found = importance.resample(docs, target, longest=longest, share=share)
    assert as_rows(found) == sorted(plain_resampling([r[:2] for r in rows], targets, longest), key=repr)
    assert importance.resample(docs.limit(0), target.limit(0)).count() == 0


def test_head_is_what_is_frequent(spark):
    texts = spark.createDataFrame([("a a a b",), ("a b c " + "y" * 200,), (None,)], "text string")
    assert sorted(importance.frequent(texts, 0.25)) == [b"a", b"b"] and sorted(importance.frequent(texts, 0.4, True)) == [b"a a", b"a b"]


def test_registered_queries(spark):
    results = {n: queries.queries()[n](spark, FOLDER) for n in ("op11_best_position_search", "op12_source_mixing", "op13_importance_resampling")}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert as_rows(results["op11_best_position_search"]) == sorted(plain_search(docs, items), key=repr)
    wanted = [(r[0], *r[2:]) for r in plain_resampling(docs, [t for _, t in items], 1)]
    assert as_rows(results["op13_importance_resampling"]) == sorted(wanted, key=repr)
    mixed = results["op12_source_mixing"].collect()
    assert sorted(r.doc_id for r in mixed) == sorted(d for d, _ in docs) and all(r.taken <= 3 * r["size"] for r in mixed)
    for kind, columns in {"op11_best_position_search": "bigint int bigint bigint", "op12_source_mixing": "bigint bigint bigint double bigint", "op13_importance_resampling": "bigint bigint bigint bigint bigint"}.items():
        assert " ".join(t for _, t in results[kind].dtypes) == columns
