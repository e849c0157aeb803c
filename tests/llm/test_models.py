"""Language, quality, toxicity, tool calls and the pipeline against plain versions."""

import json
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cellframe.llm import chat, common, language, quality, toxicity

SYLLABLES = {"en": "the and ing ou th er st".split(), "de": "der sch und ei zu ück ß".split(), "fr": "le eau é que oi ent".split()}


def prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(20, 80)), lang, "s", -1.0) for k in range(240)]
    rows += [(900, None, "en", None, None), (901, "", None, "s", 0.0), (902, "12 34 !!", "fr", "s", 0.0), (None, prose(rng, "de", 30), None, "s", 1.0), (5, rows[5][1], rows[5][2], "again", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)


def naive_phrases(text, sample):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n] in sample and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_language_phrases_are_longest_matches():
    samples = {"de": language.letters("der den oder ding größe"), "en": language.letters("the then other thing"), "zh": language.letters("你好 世界 和平")}
    model = language.automata(samples)
    texts = ["the other", "oder den ding", "xyz the q", "", "123", "then " * 300, "th" * 900, "世界你好 größe" * 200, "t" * 2000 + "𝒳 then", "e " * 1500]
    rates, sizes = language.parse(model, texts)
    for k, text in enumerate(texts):
        plain = language.letters(text)
        assert sizes[k] == len(plain)
        for n, name in enumerate(model.names):
            assert rates[n, k] * max(sizes[k], 1) == pytest.approx(naive_phrases(plain, samples[name]))
    assert language.parse(model, [])[0].shape == (3, 0)


def test_large_alphabets_and_many_languages(spark):
    rng = random.Random(12)
    scripts = {name: [chr(first + k) for k in range(600)] for name, first in (("a", 0x4E00), ("b", 0x7000), ("c", 0x20000))}
    rows = [(k, "".join(rng.choices(scripts[s := "abc"[k % 3]], k=200)), s) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs.where("doc_id % 2 = 0"))).collect()}
    assert sum(told[k] == s for k, _, s in rows if k % 2) >= 0.95 * 150
    many = spark.createDataFrame([(k, chr(0x4E00 + k) * 3, f"l{k:03}") for k in range(300)], "doc_id long, text string, lang string")
    model = language.train(many)
    assert len(model.names) == 300 and all(r.lang_pred == r.lang for r in language.identify(many, model).join(many, "doc_id").collect())


def test_languages_are_told(docs):
    told = language.identify(docs, language.train(docs.where("doc_id % 2 = 0")))
    rows = {r.doc_id: r for r in told.collect()}
    truth = {r.doc_id: r.lang for r in docs.where("doc_id < 240").collect()}
    assert sum(rows[d].lang_pred == lang for d, lang in truth.items()) >= 0.98 * len(truth)
    assert all(rows[d].lang_pred == "und" and rows[d].score == 0 for d in (900, 901, 902)) and rows[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in rows.values())
    none = language.train(docs.where("lang is null"))
    assert none.names == [] and {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    kept = language.keep_identified(docs, language.train(docs), 0.5)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3 and language.identify(docs.limit(0), none).count() == 0


def plain_model(texts, order=4):
    """Interpolated modified Kneser-Ney over characters, straight from its definition."""
    counts = Counter()
    for t in texts:
        padded = quality.START * (order - 1) + t + quality.END
        counts.update(padded[i : i + order] for i in range(len(padded) - order + 1))
    levels = []
    for _ in range(order):
        n = Counter(min(c, 5) for c in counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d = [min(max(v, 0.05), k - 0.05) for k, v in enumerate(raw, 1)]
        total, off = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        levels.append(({g: (c - d[min(c, 3) - 1]) / total[g[:-1]] for g, c in counts.items()}, {k: off[k] / total[k] for k in total}))
        counts = Counter(g[1:] for g in counts)
    symbols = len(levels[-1][0]) + 1

    def probability(gram):
        p = 1 / symbols
        for own, rest in reversed(levels):
            tail = gram[len(gram) - len(next(iter(own))) :]
            p = own.get(tail, 0.0) + rest.get(tail[:-1], 1.0) * p
        return p

    return probability


def test_perplexity_equals_the_plain_model(docs):
    trusted = docs.where("doc_id < 120").select("doc_id")
    rows = quality.judge(docs, trusted).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = [r.text for r in docs.where("doc_id < 120").collect()]
    probability = plain_model(good)
    for r in rows:
        text = texts[r.doc_id]
        if not text:
            assert r.perplexity is None and not r.keep
            continue
        padded = quality.START * 3 + text + quality.END
        nats = -sum(math.log(probability(padded[i : i + 4])) for i in range(len(padded) - 3))
        assert r.perplexity == pytest.approx(math.exp(nats / (len(text) + 1)), rel=1e-9)
    assert len(rows) == docs.count()


def test_quality_rejects_what_is_unlike_trusted_text(spark, docs):
    rng = random.Random(9)
    junk = [(2000 + k, " ".join(w.upper() + "!!#" for w in prose(rng, "en", 40).split()), "en", "s", 0.0) for k in range(10)]
    both = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    kept = quality.keep_good(both, docs.where("doc_id < 200").select("doc_id"))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and not any(i is not None and i >= 900 for i in ids)
    assert len([i for i in ids if i is not None]) >= 0.97 * 241 and None in ids and ids.count(5) == 2
    everything = quality.judge(docs, docs.where("doc_id < 0").select("doc_id")).collect()
    assert all(r.keep == (r.perplexity is not None) for r in everything)
    assert quality.judge(docs.limit(0), docs.select("doc_id")).count() == 0


def test_quality_keeps_clean_documents_that_trained_nothing(spark):
    rng = random.Random(12)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(1500)] for lang, letters in {"en": "abcdefghijklm", "fr": "nopqrstuvwxyz"}.items()}
    rows = [(k, " ".join(rng.choices(words["fr" if k % 10 == 0 else "en"], k=60)), "fr" if k % 10 == 0 else "en") for k in range(400)]
    rows += [(1000 + k, "".join(rng.choices("abcdefghijklm ", k=60)).upper() + "#" * 40, "en") for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    judged = quality.judge(table, table.where("doc_id < 200").select("doc_id")).collect()
    for lang in words:  # 180 trusted documents of one, 20 of the other
        new = [r.keep for r in judged if r.lang == lang and 200 <= r.doc_id < 1000]
        assert sum(new) >= 0.95 * len(new)
    assert not any(r.keep for r in judged if r.doc_id >= 1000) and all(r.keep for r in judged if r.doc_id < 200 and r.lang == "fr")
    one = quality.judge(table, table.where("doc_id = 0").select("doc_id")).collect()
    assert all(r.threshold > 1 for r in one) and [r.keep for r in one if r.doc_id == 0] == [True]


def test_toxicity(spark, docs):
    rng = random.Random(4)
    bad = ["blastard", "grumpkin", "snorfel"]
    rows = []
    for k in range(400):
        words = prose(rng, "en", 60).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, 60), rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.where("doc_id % 5 <> 0").select("doc_id", "toxic"), 4000)
    found = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    held = [(found[d], t) for d, _, t in rows if d % 5 == 0]
    assert all((s >= 0.5) == (t == 1) for s, t in held) and all(0 <= s <= 1 for s, _ in held)
    clashing = table.where("doc_id % 5 <> 0").selectExpr("doc_id", "toxic", "'x' as text", "1 as _n", "2 as a")
    assert toxicity.train(table, clashing).toxic == model.toxic
    # Plainly, window by window with zstandard itself, a long word among them.
    compressed = [toxicity.Lengths._compressor(c).compress for c in (model.ordinary, model.toxic)]
    texts = {**{d: t for d, t, _ in rows}, -1: "snorfel" * 100 + " snorfel", -2: "x " * 5000 + "grumpkin"}
    plain = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    for r in toxicity.score(plain, model).collect():
        words = [w[i : i + 128] for w in re.findall(r"[^\W\d_]+", texts[r.doc_id].lower()) for i in range(0, len(w), 128)]
        pairs = [[len(c(f"    {w}    ".encode())) for c in compressed] for w in words]
        count = sum(o - t >= model.saving and t <= model.covered + model.slack for o, t in pairs)
        z = sum(w * x for w, x in zip(model.weights, [1.0, count > 0, math.log1p(count), min(1.0, 20 * count / len(words))], strict=True))
        assert r.windows == count and r.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)
    odd = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert odd[900] == odd[901] < 0.5 and len(odd) == docs.select("doc_id").distinct().count()
    nothing = toxicity.train(table, table.where("toxic = 1").select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score(table, nothing).collect()} == {0.0} and toxicity.score(table.limit(0), model).count() == 0


def test_tool_calls(spark):
    calls = [
        ("c", "1", "add", '{"b": 2, "a": 1}', []), ("c", "2", "add", '{"a": 1.5}', ["1", "gone"]), ("c", "3", "add", "[1]", ["2", "1"]), ("c", "4", "add", "{", []), ("c", "5", "none", "{}", []),
        ("c", "6", "add", '{"a": 1, "b": 1}', ["7"]), ("c", "7", "add", '{"a": 1, "b": 1}', ["6"]), ("c", "1", "add", '{"a":1,"b":2}', None), (None, None, "add", '{"a":1,"b":2,"z":0}', ["1"]), ("d", "9", None, None, None),
    ]
    results = [("1", "3"), ("1", "2"), ("3", None), (None, "lost"), ("8", "of nothing")]
    schema = json.dumps({"a": {"type": "integer", "required": True}, "b": {"type": "integer", "required": True}})
    args = (spark.createDataFrame(calls, "conversation string, call_id string, name string, arguments string, depends_on array<string>"), spark.createDataFrame(results, "call_id string, content string"), spark.createDataFrame([("add", schema)], "name string, schema string"))
    rows = chat.link(*args).collect()
    by = {r.call_id: r for r in rows if r.call_id != "1"}
    assert len(rows) == len(calls) and [(r.level, r.status, r.n_results, r.message) for r in rows if r.call_id == "1"] == [(0, "ok", 2, '{"arguments":{"a":1,"b":2},"id":"1","name":"add","result":"2"}')] * 2
    assert (by["2"].level, by["2"].status, by["2"].errors) == (1, "invalid", ["b is missing", "a is no integer"])
    assert (by["3"].level, by["3"].errors, by["3"].n_results) == (2, ["arguments are no object"], 1)
    assert by["4"].errors == ["arguments are no JSON"] and by["5"].status == by["9"].status == "unknown"
    assert by["6"].status == by["7"].status == "cyclic" and by["6"].level is None and by[None].errors == ["z is not in the schema"]
    for bound in (1, 2, 100):
        assert {r.call_id: r.level for r in chat.levels(args[0].where("call_id is not null"), bound).collect()} == {"1": 0, "2": 1, "3": 2, "4": 0, "5": 0, "9": 0}
    assert chat.link(*(a.limit(0) for a in args)).count() == 0
    talk = spark.createDataFrame([(1, 0, "system", "s", 9), (1, 1, "user", "ü\n", 9), (1, 2, "assistant", "ok", 9), (1, 3, "user", None, 9), (None, 0, "user", "x", 9), (1, 4, None, "y", 9)], "conv_id long, turn long, role string, text string, level int")
    found = {r.call_id: (r.level, r.status, r.message) for r in chat.link_turns(talk).collect()}
    assert found["1:1"] == (1, "ok", '{"arguments":{"prompt":"ü\\n","turn":1},"id":"1:1","name":"respond","result":"ok"}')
    assert found["1:3"][:2] == (2, "invalid") and len(found) == 4


def test_arguments_and_schemas_that_are_odd(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rules = {"loose": {"v": {}}, "null": {"v": {"type": "null"}}, "either": {"v": {"type": ["string", "null"]}}, "what": {"v": {"type": "what"}}, "flat": {"v": 3}, "number": {"v": {"type": "integer"}}}
    schemas = [(k, json.dumps(v), 7) for k, v in rules.items()] + [("list", "[1]", 7), ("broken", "{", 7), ("none", None, 7), ("deep", deep, 7)]
    arguments = [("loose", '{"v":"\\ud800"}'), ("loose", '{"v":' + deep + "}"), ("loose", '{"v":NaN}'), ("loose", '{"v":-Infinity}'), ("loose", '{"v":1e999}'), ("loose", '{"v":[1.0,100.0,-0.0,1e3,0.1,1.5e300]}'), ("null", '{"v":null}'), ("null", '{"v":0}'), ("either", '{"v":null}'), ("either", '{"v":1}'), ("what", '{"v":[]}'), ("flat", '{"v":{}}'), ("number", '{"v":2.0}'), ("number", '{"v":true}'), ("list", '{"v":1}'), ("broken", "{}"), ("none", "{}"), ("deep", "{}"), ("loose", '{"\\ud801":1}')]
    calls = spark.createDataFrame([("c", f"{k:02}", name, text, [], 1.0) for k, (name, text) in enumerate(arguments)], "conversation string, call_id string, name string, arguments string, depends_on array<string>, level double")
    results = spark.createDataFrame([("00", "r", "x")], "call_id string, content string, name string")
    rows = sorted(chat.link(calls, results, spark.createDataFrame(schemas, "name string, schema string, level int")).collect(), key=lambda r: r.call_id)
    states = ["ok", "invalid", "invalid", "invalid", "invalid", "unanswered", "unanswered", "invalid", "unanswered", "invalid", "unanswered", "unanswered", "unanswered", "invalid", "unknown", "unknown", "unknown", "unknown", "invalid"]
    assert [r.status for r in rows] == states
    assert '"v":"\\ud800"' in rows[0].message and '"v":[1,100,0,1000,0.1,1.5e+300]' in rows[5].message and rows[9].errors == ["v is no string or null"]
    assert all(json.loads(r.message, parse_constant=lambda c: pytest.fail(c)) for r in rows)


def test_levels_of_a_long_conversation_in_many_blocks(spark):
    rng = random.Random(9)
    needs = {k: rng.sample(range(max(0, k - 30), k), min(k, rng.randint(0, 3))) for k in range(2000)}
    calls = spark.createDataFrame([("c", f"c:{k}", [f"c:{d}" for d in own]) for k, own in needs.items()], "conversation string, call_id string, depends_on array<string>")
    want = {}
    for k, own in needs.items():
        want[f"c:{k}"] = 1 + max((want[f"c:{d}"] for d in own), default=-1)
    assert {r.call_id: r.level for r in chat.levels(calls, 300).collect()} == want


def test_pipeline_equals_its_stages_in_plain(spark, tmp_path, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    spark.range(0, 150).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "best_fit_packing"] and corpus_pipeline.ORACLE_SQL is None
    found = corpus_pipeline.run(spark, folder).collect()

    kept = spark.read.parquet(f"{folder}/documents.parquet")
    told = {(r.doc_id): r for r in language.identify(kept, language.train(kept)).collect()}
    rows = [r for r in kept.collect() if told[r.doc_id].lang_pred != "und" and told[r.doc_id].score >= corpus_pipeline.LEAST_CERTAINTY]
    good = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, kept.schema), spark.range(150).withColumnRenamed("id", "doc_id")).where("keep").collect()}
    rows = [r for r in rows if r.doc_id in good]
    shingles = {r.doc_id: {" ".join(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in rows if r.doc_id is not None}
    group = {d: d for d in shingles}
    for a, b in combinations(sorted(shingles), 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
            low, high = sorted((group[a], group[b]))
            group = {d: low if g == high else g for d, g in group.items()}
    first = {d for d, g in group.items() if d == g}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows if r.doc_id in first or r.doc_id is None}
    got = defaultdict(int)
    for r in found:
        got[r.doc_id] += r.length
    assert dict(got) == lengths


def test_pipeline_of_an_empty_table(spark, tmp_path, docs):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.limit(0).select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    spark.range(0, 5).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_language_samples_are_bounded_however_rows_repeat(spark):
    rows = [(None, f"der hund lief {k} mal um das haus und bellte", "de") for k in range(300)] + [(7, "the dog ran round the house", "en")] * 1000
    learnt = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=20, sample_bytes=100)
    assert learnt.names == ["de", "en"] and len(learnt.table) <= learnt.width * (2 * 20 * 100 * 2 + 100)
    told = language.identify(spark.createDataFrame([(1, "der hund bellte das haus"), (2, "the house ran round")], "doc_id long, text string"), learnt)
    assert {r.doc_id: r.lang_pred for r in told.collect()} == {1: "de", 2: "en"}


def test_toxic_samples_are_drawn_by_document(spark):
    rows = [(k, ("you rotten filth scum " if k % 2 else "a calm walk by the river ") + f"word{k}") for k in range(40)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 30, "doc_id long, toxic int")
    found = toxicity._sample(docs, labels, 10).collect()
    assert {r.toxic for r in found} == {0, 1} and len(found) <= 80
    whole = toxicity._sample(docs, labels, 40).collect()
    assert len(whole) == 40 or len({r.text for r in whole}) == len(whole)


def test_levels_of_chains_with_random_ids_take_few_rounds(spark, monkeypatch):
    rng = random.Random(8)
    ids = [f"{rng.getrandbits(64):016x}" for _ in range(121)]
    calls = [("c", a, [b]) for a, b in zip(ids[1:], ids, strict=False)] + [("c", ids[0], [])]
    ring = [f"r{rng.getrandbits(64):016x}" for _ in range(5)]
    calls += [("c", a, [b, ids[3]]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)] + [("c", "behind", [ring[2]]), ("d", "apart", [ids[120], ids[7]])]
    stored = []
    monkeypatch.setattr(chat, "materialise", lambda df: stored.append(1) or common.materialise(df))
    frame = spark.createDataFrame(calls, "conversation string, call_id string, depends_on array<string>")
    want = {a: n for n, a in enumerate(ids)} | {"apart": 121}
    assert {r.call_id: r.level for r in chat.levels(frame, 61).collect()} == want
    assert len(stored) < 20
    stored.clear()
    assert {r.call_id: r.level for r in chat.levels(frame, 130).collect()} == want
    assert len(stored) < 10
