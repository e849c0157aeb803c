"""Near-duplicates and searches against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellframe.llm import hamming, simhash, topk
from cellframe.llm.components import connected_components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius):
    label = list(range(len(fps)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(k) for k in range(len(fps))]


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("ab cd ef gh ij kl mn op".split(), k=rng.randint(30, 300))) for _ in range(25)]
    texts = [None, "", " \t", "one", "ONE", "a b c", "  É é"] + base + [t.replace("ab", "AB", 1) for t in base[:5]] + [t + " tail" for t in base[:15]] + base[:3]
    rows = [(k + 10, t, "x", 0) for k, t in enumerate(texts)] + [(12, texts[2], "y", 1), (None, base[0], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int").repartition(3)
    found = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(fps, 4)
    want = {k + 10: (f"{fps[k]:016x}", roots[k] + 10) for k in range(len(texts))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found if r.doc_id is not None} == want
    assert len(found) == len(rows) and [r.component_id for r in found if r.doc_id is None] == [want[17][1]]
    kept = sorted(r.doc_id for r in simhash.distinct_documents(docs, 4, 4, 1).collect() if r.doc_id is not None)
    assert kept == sorted(set(c for _, c in want.values())) and simhash.distinct_documents(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.distinct_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [2, 5, 1024])
def test_links_keep_components_however_long_the_lists(spark, bound):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 6, dtype=np.int64)
    members = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            flips = rng.choice(63, size=rng.integers(1, 8), replace=False)
            members.add(int(c) ^ int(sum(1 << int(f) for f in flips)))
    values = sorted(members)
    found = connected_components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp0 long"), 4, bound))
    roots = {r.node: r.root for r in found.collect()}
    want = plain_components(values, 4)
    assert [roots.get(v, v) for v in values] == [values[w] for w in want]


def test_links_of_lists_of_any_length(monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2**63, (4, 2), dtype=np.int64)
    values = np.array([c ^ np.array([sum(1 << int(f) for f in rng.choice(63, rng.integers(0, 8), replace=False)) for _ in "ab"]) for c in centres for _ in range(40)])
    values = rng.permutation(values)
    offsets = np.array([0, 2, 4, 7, 12, 20, 60, 160])
    near = lambda i, j: (np.unpackbits((values[i] ^ values[j]).view(np.uint8)).sum() <= 12) and ((values[i] ^ values[j]).view(np.uint8) == 0).sum() >= 3

    def grouped(pairs, a, b):
        label = list(range(a, b))
        for i, j in pairs:
            if a <= i < b:
                one, two = label[i - a], label[j - a]
                label = [min(one, two) if x in (one, two) else x for x in label]
        return label

    for at_once in (256, 16):
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        found = simhash.links_of_lists(values, offsets, 12, 3).tolist()
        assert all(near(i, j) for i, j in found)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            assert grouped(found, a, b) == grouped([(i, j) for i in range(a, b) for j in range(a, i) if near(i, j)], a, b)


@pytest.mark.parametrize("bound", [3, 1024])
def test_wide_links_pass_the_tally_and_the_bits(spark, bound):
    rng = np.random.default_rng(5)
    values = []
    for c in rng.integers(0, 256, (5, 16), dtype=np.uint8):
        for flips in (0, 3, 10, 18, 24, 30, 12, 6):
            own = np.unpackbits(c)
            own[rng.choice(128, flips, replace=False)] ^= 1
            values.append(np.packbits(own).view(np.int64).tolist())
    found = connected_components(simhash.links(spark.createDataFrame(values, "fp0 long, fp1 long"), 24, bound, 2))
    roots = {r.node: r.root for r in found.collect()}
    names = ["".join(f"{v & (1 << 64) - 1:016X}" for v in pair) for pair in values]
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            xor = np.array(values[i]) ^ np.array(values[j])
            if (xor.view(np.uint8) == 0).sum() >= 3 and np.bitwise_count(xor.view(np.uint64)).sum() <= 24:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    own = [roots.get(n, n) for n in names]
    assert all((own[i] == own[j]) == (label[i] == label[j]) for i in range(len(own)) for j in range(i))


def test_one_document_of_each_group_of_similar_ones_stays(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    rows, similar = [], {}
    for k in range(40):
        text = rng.choices(words, k=400)
        rows.append((10 * k, " ".join(text)))
        for n in (1, 2):
            other = list(text)
            for at in rng.sample(range(400), 1):  # at most 5 of 396 shingles each
                other[at] = "x"
            rows.append((10 * k + n, " ".join(other)))
    rows += [(5, "a b c"), (5, "a b c"), (5, "d e f"), (None, "a b c"), (None, None), (0, rows[0][1])]
    docs = spark.createDataFrame([(d, t, "c", d) for d, t in rows], "doc_id long, text string, fp0 string, salt long").repartition(3)
    kept = simhash.distinct_documents(docs)
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    clean = [(10 * k, dict(rows)[10 * k]) for k in range(1, 40)] + [(0, rows[0][1]), (5, "a b c"), (5, "d e f"), (None, "a b c"), (None, None)]
    assert found == sorted(clean, key=str) and kept.columns == docs.columns
    assert simhash.distinct_documents(docs.limit(0)).count() == 0


def test_links_are_verified_by_the_texts_shingles(spark):
    rng = random.Random(12)
    words, rows, sets = [f"w{k}" for k in range(3000)], [], []
    for k in range(30):
        text = rng.choices(words, k=rng.choice([60, 200, 900]))
        for n, share in enumerate((0, 0.004, 0.01, 0.015, 0.03, 0.05)):
            other = [w if rng.random() >= share else rng.choice(words) for w in text]
            rows.append((10 * k + n, " ".join(other)))
            sets.append({tuple(other[i : i + 5]) for i in range(len(other) - 4)})
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for a, b in [(0, 1), (0, 2), (1, 5), (0, 6)]:
        sketches = simhash.sketch(rows[a][1]), simhash.sketch(rows[b][1])
        assert simhash.similarity_of(*sketches) == similar(a, b)
        assert abs(simhash.similarity_of(*(s[:128] for s in sketches), 128) - similar(a, b)) < 0.2
    assert not len(simhash.sketch("")) and len(simhash.sketch("one two")) == 1 and simhash.similarity_of(simhash.sketch(""), simhash.sketch("")) == 1
    kept = {r.doc_id for r in simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    # Groups through links of 0.8 and more lose nothing but their first; nine in ten of the documents with such a link go.
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a - a % 6, a):
            if similar(a, b) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    firsts = {rows[k][0] for k in range(len(rows)) if label[k] == k}
    assert firsts <= kept
    assert len(kept - firsts) <= 0.1 * (len(rows) - len(firsts))


@pytest.mark.parametrize("bound", [3, 1024])
def test_nearest_links_of_three_integers(spark, bound):
    rng = np.random.default_rng(15)
    values = []
    for c in rng.integers(0, 256, (6, 24), dtype=np.uint8):
        for flips in (0, 5, 12, 20, 28, 36, 44, 50):
            own = np.unpackbits(c)
            own[rng.choice(192, flips, replace=False)] ^= 1
            values.append(np.packbits(own).view(np.int64).tolist())
    found = simhash.links(spark.createDataFrame(values, "fp0 long, fp1 long, fp2 long"), 40, bound, 3).collect()
    names = ["".join(f"{v & (1 << 64) - 1:016X}" for v in own) for own in values]
    got, want = list(range(len(values))), list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            xor = np.array(values[i]) ^ np.array(values[j])
            if (xor.view(np.uint8) == 0).sum() >= 4 and np.bitwise_count(xor.view(np.uint64)).sum() <= 40:
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    for r in found:
        one, two = got[names.index(r.a)], got[names.index(r.b)]
        got = [min(one, two) if x in (one, two) else x for x in got]
    assert got == want


def test_long_text_in_stretches(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choices("ab cd ef gh".split(), k=5000))
    whole = simhash.fingerprint(text), simhash.fingerprint(text, 5, 2)
    sketched = simhash.fingerprint(text, 5, 3), simhash.sketch(text, 5, 100).tolist()
    monkeypatch.setattr(simhash, "STRETCH", 37)
    assert whole == (simhash.fingerprint(text), simhash.fingerprint(text, 5, 2)) and whole[0] == (plain_fingerprint(text),)
    assert sketched == (simhash.fingerprint(text, 5, 3), simhash.sketch(text, 5, 100).tolist())


def test_components_of_a_chain(spark):
    links = spark.range(40).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert roots == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16)) * 0.3
    x[50:150] = x[50]
    rows = [(k, [float(v) for v in x[k]], "c") for k in range(400)]
    rows += [(400, None, "c"), (500, [float("nan")] * 16, "c"), (600, [None] + [0.1] * 15, "c"), (700, [0.0] * 16, "c"), (800, [float("inf")] + [0.0] * 15, "c"), (401, [], "c"), (None, [0.1] * 16, "c"), (0, [float(v) for v in x[0]], "again")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4), x


def top(table, step, k):
    found = {}
    for r in topk.top_k(table, lambda i: i % step == 0, k).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(f) for q, f in found.items()}


def plain_top(rows, step, k):
    """Exactly, with whole numbers of any size; each query row has its own list."""
    want = {}
    for q, v in rows:
        if q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:k]
            want[q] = sorted(want.get(q, []) + [(n + 1, i, -s) for n, (s, i) in enumerate(best)])
    return want


def test_exact_top_k(vectors):
    table, x = vectors
    whole = {**{k: np.floor(1024 * x[k]).astype(int).tolist() for k in range(400)}, 700: [0] * 16}
    candidates = [*whole.items(), (0, whole[0])]
    for k, step in ((10, 100), (150, 100), (1000, 200)):
        assert top(table, step, k) == plain_top(candidates, step, k)
    assert topk.top_k(table.limit(0), lambda i: i % 2 == 0).count() == 0


def test_exact_top_k_of_repeated_ids_and_long_vectors(spark):
    rng = random.Random(7)
    rows = [(k // 2, [rng.uniform(-1, 1) * 10 ** rng.choice((0, 4)) for _ in range(4)]) for k in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(k, [int(np.floor(1024 * c)) for c in v]) for k, v in rows]
    assert top(table, 5, 4) == plain_top(whole, 5, 4)
    large = [(k, [c * 1e2 for c in v]) for k, v in rows]
    table = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    whole = [(k, [int(np.floor(1024 * c)) for c in v]) for k, v in large]
    assert max(abs(s) for found in plain_top(whole, 5, 4).values() for _, _, s in found) > 1 << 53 and top(table, 5, 4) == plain_top(whole, 5, 4)
    with pytest.raises(ValueError, match="long"):
        topk.top_k(spark.createDataFrame([(0, [1e9] * 4), (1, [1e9] * 4)], "vec_id long, embedding array<double>"), lambda i: i == 0)


def test_nearest_neighbors(vectors):
    table, x = vectors
    found = {}
    for r in hamming.nearest(table, lambda i: i % 20 == 0, 10).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 400, 20):
        own = sorted(set(found[q]))
        want = sorted((-float((x[q] * x[i]).sum()), i) for i in range(400) if i != q)[:10]
        assert [n for n, *_ in own] == list(range(1, 11)) and all(s == float((x[q] * x[i]).sum()) for _, i, s in own)
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        hits, total = hits + len({i for _, i, _ in own} & {i for _, i in want}), total + 10
    assert hits / total >= 0.9 and 700 not in found
    few = table.where("vec_id in (20, 21, 22)")
    assert sorted((r.query_id, r.vec_id) for r in hamming.nearest(few, lambda i: i % 20 == 0, 10).collect()) == [(20, 21), (20, 22)]
    assert hamming.nearest(table.limit(0), lambda i: i % 2 == 0).count() == 0


def test_pigeonhole_probes_retrieve_every_code_in_the_radius_once():
    rng = np.random.default_rng(8)
    own, query = rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 2**64, 20, dtype=np.uint64)
    own[:20] = query ^ np.uint64(0b1011)
    for radius in (0, 2, 3, 7, 8, 20, 28, 64):
        found = np.zeros((20, 500), dtype=int)
        for part, reach in enumerate(hamming.reaches(radius)):
            q, r = hamming.within(part, query, own, radius)
            found[q, r] += 1
            apart = np.bitwise_count((query[q] ^ own[r]).view(np.uint16).reshape(-1, 4)[:, part])
            assert (apart <= reach).all()
        assert (found == (np.bitwise_count(query[:, None] ^ own[None]) <= radius)).all()


def test_groups_blocks_and_repeats_change_no_result(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 32))
    x[100:400] = x[100]
    x[0] = x[100] * 0.5
    rows = [(k, x[k].tolist()) for k in range(900)] + [(0, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ask = lambda: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in hamming.nearest(table, lambda i: i % 50 == 0, 5).collect())
    whole = ask()
    monkeypatch.setattr(hamming, "ROWS", 40)
    monkeypatch.setattr(hamming, "QUERIES", 4)
    monkeypatch.setattr(hamming, "TOGETHER", 3)
    assert ask() == whole and len(whole) == 19 * 5
    assert [(n, v) for q, n, v, _ in whole if q == 150] == [(k + 1, 100 + k) for k in range(5)]


def test_repeated_ids_do_not_push_out_other_ids(spark):
    rng = np.random.default_rng(9)
    v = [0.6, 0.8, 0.0, 0.0]
    rows = [(0, v)] * 30 + [(i, v) for i in range(1, 26)] + [(100 + i, list(map(float, 0.5 * x / np.linalg.norm(x)))) for i, x in enumerate(rng.normal(size=(60, 4)))]
    found = hamming.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0, k=5)
    assert {(r["rank"], r.vec_id, round(r.score, 9)) for r in found.collect()} == {(k, k, 1.0) for k in range(1, 6)}


def test_entries_of_the_index_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    fps = simhash.materialise(spark.range(3000).select(*[F.xxhash64(F.floor(F.col("id") / 2), F.lit(k)).bitwiseXOR(F.when(F.lit(k) == 0, F.col("id") % 2).otherwise(0)).alias(f"fp{k}") for k in range(3)]))
    found = simhash.links(fps, 40, width=3)
    assert found.count() == 1500
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("first", [2, 16])
def test_links_that_a_failed_one_stood_for_are_found(spark, monkeypatch, first):
    """A list passes a tree of its nearest links; where some fail, farther ones must hold the same documents together."""
    monkeypatch.setattr(simhash, "BETWEEN", first)
    rng = np.random.default_rng(21)
    values = []
    for c in rng.integers(0, 256, (5, 24), dtype=np.uint8):
        for _ in range(9):
            own = np.unpackbits(c)
            own[rng.choice(24, rng.integers(3, 8), replace=False)] ^= 1
            values.append(np.packbits(own).view(np.int64).tolist())
    names = ["".join(f"{v & (1 << 64) - 1:016X}" for v in own) for own in values]
    near = lambda i, j: (xor := np.array(values[i]) ^ np.array(values[j])) is not None and (xor.view(np.uint8) == 0).sum() >= 4 and np.bitwise_count(xor.view(np.uint64)).sum() <= 40
    holds = {(i, j) for i in range(len(values)) for j in range(i) if rng.random() < 0.15}
    allowed = spark.createDataFrame([(min(names[i], names[j]), max(names[i], names[j])) for i, j in holds], "a string, b string")
    label = list(range(len(values)))
    for i, j in holds:
        if near(i, j):
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    hashed = spark.createDataFrame([(k, *v, 0) for k, v in enumerate(values)], "doc_id long, fp0 long, fp1 long, fp2 long, salt int")
    verify = lambda found: found.select(*(f(*"ab").alias(n) for f, n in ((F.least, "a"), (F.greatest, "b")))).join(allowed, ["a", "b"], "left_semi")
    found = {r.doc_id: r.component_id for r in simhash._labelled(hashed, 40, 3, verify).collect()}
    assert [found[k] for k in range(len(values))] == label and 5 < len(set(label)) < 30


def test_long_texts_are_compared_by_whole_sets(spark):
    """Pairs near the limit of which the smallest 1024 hashes say the wrong."""
    rng = random.Random(17)
    words, rows, lost = [f"w{k}" for k in range(5000)], [], set()
    wanted = {True: 3, False: 3}
    while any(wanted.values()):
        text = rng.choices(words, k=2500)
        other = list(text)
        for at in rng.sample(range(2500), 58):
            other[at] = "x"
        one, two = " ".join(text), " ".join(other)
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (text, other))
        similar = len(a & b) / len(a | b) >= 0.8
        apart = np.array(simhash.fingerprint(one, 5, 3), dtype=np.uint64) ^ np.array(simhash.fingerprint(two, 5, 3), dtype=np.uint64)
        passes = np.bitwise_count(apart).sum() <= simhash.SIMILAR and (apart.view(np.uint8) == 0).sum() >= 4
        told = simhash.similarity_of(simhash.sketch(one), simhash.sketch(two)) >= 0.8
        if passes and told != similar and wanted[similar]:
            wanted[similar] -= 1
            rows += [(len(rows), one), (len(rows) + 1, two)]
            lost |= {len(rows) - 1} if similar else set()
    kept = {r.doc_id for r in simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(len(rows))) - kept == lost and len(lost) == 3
