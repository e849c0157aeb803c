"""Language identification by cross-parsing entropy.

Per language, a bounded sample of labelled text becomes a suffix automaton over the bytes of its
letters, so no alphabet is too large for it.  A text is parsed against each automaton into phrases,
each the longest match with the language's sample; the language that needs the fewest phrases per
byte wins.

Texts are parsed whole and a phrase goes on as long as it matches: texts are cut into windows that all
languages and many texts pass through in step, each window begins in the state in which the one before
it ended, and a window whose beginning was guessed wrong is parsed again.

The sample is the one thing that is bounded: ``sample_docs`` documents per language, fewer where
languages are so many that ``all_docs`` would be passed (one at least), chosen by a hash of id and text, of
each ``sample_bytes`` bytes of letters from a stretch that the hash chooses.  The automata are thereby
small enough to be sent to every task.

Defined cases: null texts and texts without a letter are ``und`` with score 0; equal phrase counts go
to the language first in alphabetical order; rows with null language train nothing, rows without id train like others and copies of a row once; without any
labelled text all are ``und``; with one language the
runner-up counts as a phrase a byte; repeated rows repeat; a long text is parsed whole; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.common import filled, let_go, text_slices

#: Bytes of a window and of the run-up from which its first state is guessed; neither changes a result.
WINDOW, RUN_UP = 512, 64
#: Windows that pass through the automata in step.
TOGETHER = 8192
#: Characters of the stretch from which a document's sample is taken, for each byte of the sample.
STRETCH = 4
_letters = re.compile(r"[^\W\d_]+")


@dataclass
class Languages:
    """Automata of all languages in one table: state * width + symbol -> state * width, 0 for none.

    ``symbols`` gives each byte its symbol, 0 for bytes that no sample holds.
    """

    names: list[str]
    symbols: np.ndarray
    width: int
    roots: np.ndarray
    table: np.ndarray


def letters(text: str) -> bytes:
    """The words of ``text`` in lower case, a space before, between and behind them."""
    words = _letters.findall(text.lower())
    return f" {' '.join(words)} ".encode() if words else b""


def suffix_automaton(text: list[int], width: int) -> np.ndarray:
    """Transitions of the automaton of all substrings: rows of states, 0 for no transition, state 1 the start."""
    steps: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in text:
        new = len(steps)
        steps.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(steps), width), dtype=np.int32)
    for state, own in enumerate(steps):
        for c, to in own.items():
            table[state, c] = to
    return table


def automata(samples: dict[str, bytes]) -> Languages:
    """The automata of each language's sample."""
    names = sorted(samples)
    present = sorted(set(b"".join(samples.values())))
    symbols = np.zeros(256, dtype=np.int32)
    symbols[present] = np.arange(1, len(present) + 1)
    width, roots, tables, first = len(present) + 1, [], [], 0
    for name in names:
        table = suffix_automaton(symbols[list(samples[name])].tolist(), width)
        roots.append((first + 1) * width)
        tables.append(np.where(table > 0, (table + first) * width, 0).astype(np.int32))
        first += len(table)
    return Languages(names, symbols, width, np.array(roots, dtype=np.int32), np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32))


def train(labelled: DataFrame, sample_docs: int = 96, sample_bytes: int = 400, all_docs: int = 768) -> Languages:
    """Automata from rows (doc_id, text, lang): of every language ``sample_docs`` documents, of all about ``all_docs`` at most."""
    usable = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    usable = usable.withColumn("_key", F.xxhash64("doc_id", "text"))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("_key").alias("_n"))  # a row a language: as many as automata, which every task gets
    most = max(1, min(sample_docs, all_docs // max(1, sizes.count())))
    # Hash thinning leaves a few hundred documents of a language, however many it has, before they are ranked;
    # copies of a row count once, so that they neither fill a sample nor pass its bound.
    keyed = usable.join(F.broadcast(sizes), "lang")
    thin = F.pmod("_key", F.greatest(F.lit(1), F.floor(F.col("_n") / (4 * most)))) == 0
    long = STRETCH * sample_bytes
    start = F.pmod("_key", F.greatest(F.lit(1), F.length("text") - long)).cast("int") + 1
    drawn = keyed.where(thin).select("lang", "_key", F.substring("text", start, F.lit(long)).alias("text")).dropDuplicates(["lang", "_key"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_key"))
    rows = drawn.withColumn("_rank", rank).where(F.col("_rank") <= most)
    samples: dict[str, bytes] = {}
    for row in rows.orderBy("lang", "_rank").toLocalIterator():
        samples[row["lang"]] = samples.get(row["lang"], b"") + letters(row["text"])[:sample_bytes]
    return automata(samples)


def phrases(languages: Languages, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each of the windows (``start``, ``size``) and the states behind them, one row a language."""
    counts, states = np.zeros(state.shape, dtype=np.int32), state.copy()
    table, roots = languages.table, languages.roots[:, None]
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), TOGETHER):
        own = order[at : at + TOGETHER]
        sizes, place = size[own], start[own]
        now, count = state[:, own], np.zeros((len(state), len(own)), dtype=np.int32)
        alive = len(own)
        for step in range(int(sizes[0])):
            while sizes[alive - 1] <= step:
                alive -= 1
            symbol = symbols[place[:alive] + step]
            before = now[:, :alive]
            to = table[before + symbol]
            missed = to == 0
            again = table[roots + symbol]
            # A miss ends a phrase; a byte that no phrase starts with is one by itself.
            count[:, :alive] += missed.astype(np.int32) + (missed & (again == 0) & (before != roots))
            now[:, :alive] = np.where(missed, np.where(again == 0, roots, again), to)
        counts[:, own], states[:, own] = count, now
    return counts, states


def parse(languages: Languages, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per byte of each text against each language, and the bytes of each text's letters."""
    plain = [letters(t) for t in texts]
    sizes = np.array([len(p) for p in plain], dtype=np.int64)
    symbols = languages.symbols[np.frombuffer(b"".join(plain), dtype=np.uint8)]
    parts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), parts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = (np.cumsum(sizes) - sizes)[owner] + within * WINDOW
    size = np.minimum(WINDOW, sizes[owner] - within * WINDOW)
    total = np.zeros((len(languages.names), len(texts)), dtype=np.int64)
    if len(owner):
        behind = np.flatnonzero(within > 0)  # windows that another one stands before
        begin = np.repeat(languages.roots[:, None], len(owner), axis=1)
        begin[:, behind] = phrases(languages, symbols, start[behind] - RUN_UP, np.full(len(behind), RUN_UP), begin[:, behind])[1]
        counts, end = phrases(languages, symbols, start, size, begin)
        while len(behind := behind[(begin[:, behind] != end[:, behind - 1]).any(axis=0)]):
            begin[:, behind] = end[:, behind - 1]
            counts[:, behind], end[:, behind] = phrases(languages, symbols, start[behind], size[behind], begin[:, behind])
            behind = np.unique(np.concatenate([behind, behind[behind + 1 < len(owner)] + 1]))
            behind = behind[within[behind] > 0]
        counts[:, within == parts[owner] - 1] += (end != languages.roots[:, None])[:, within == parts[owner] - 1]
        for k in range(len(languages.names)):
            np.add.at(total[k], owner, counts[k])
    return total / np.maximum(sizes, 1), sizes


def _told(languages: Languages, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Each text's language and score."""
    if not languages.names:
        return ["und"] * len(texts), np.zeros(len(texts))
    rates, sizes = parse(languages, texts)
    ranked = np.sort(rates, axis=0)
    second = ranked[1] if len(ranked) > 1 else np.ones(len(texts))
    scores = np.where(sizes > 0, second / np.maximum(second + ranked[0], 1e-12), 0.0)
    return [languages.names[k] if n else "und" for k, n in zip(rates.argmin(axis=0).tolist(), sizes.tolist(), strict=True)], scores


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, lang_pred and score: how much of the best two languages' phrases the runner-up needs, 0.5 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch, 1):
                names, scores = _told(shared.value, filled(batch.column(1).slice(a, b - a)).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(told, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, languages: Languages, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    text = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch, text):
                part = batch.slice(a, b - a)
                names, scores = _told(shared.value, filled(part.column(text)).to_pylist())
                yield part.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores.tolist(), strict=True)], pa.bool_()))
        let_go()

    return docs.mapInArrow(kept, docs.schema)
