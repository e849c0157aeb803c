"""Exact token counts of every prefix by dynamic programming, for pieces merged pair by pair.

The tokenizer writes spaces as a mark before the word, and no piece has a mark behind another
character, so a text falls into segments (a run of marks and what follows it) whose tokens never
join.  Within a segment the count of a prefix follows from shorter ones: exactly one piece can end
it, the one that is a valid successor of the last piece of the rest, and the count is the rest's plus
one.  So one pass stores the count at every prefix, and questions about budgets and truncation read
it instead of encoding anew.

Defined cases: null and empty texts count zero; repeated rows repeat; an empty table gives an empty
result; further columns are ignored; documents without id are counted too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import filled, text_slices

#: Fixed value: the mark that stands for a space.
MARK = "▁"
#: Segments and successions that a worker remembers; beyond it forgets all, which changes no result.
REMEMBERED = 600_000

_open: dict[str, "PrefixCounter"] = {}


def prefix_counter(path: str) -> "PrefixCounter":
    """The worker's counter for the model at ``path``."""
    if path not in _open:
        _open[path] = PrefixCounter(path)
    return _open[path]


class PrefixCounter:
    """Counts tokens of prefixes by a sentencepiece model of kind BPE with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        model.normalizer_spec.add_dummy_prefix = False
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        special = [self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i) or self.processor.is_unused(i) for i in range(len(pieces))]
        plain = [p for p, s in zip(pieces, special, strict=True) if not s]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in plain):
            raise ValueError("a piece reaches over the start of a segment")
        # Pieces that no merge leads to never end a prefix.
        whole = self.processor.encode(plain, out_type=str, num_threads=1)
        # By text: the number of each piece, and -1 for what is only the end of a longer piece.
        self.tails = {p[i:]: -1 for p in plain for i in range(1, len(p))}
        self.tails.update((p, i) for i, (p, e) in enumerate(zip(plain, whole, strict=True)) if e == [p])
        self.plain = plain
        self.follows: dict[int, bool] = {}
        self.counts: dict[str, int] = {}

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether the pieces numbered ``before`` and ``piece`` stay two tokens side by side."""
        if len(self.follows) > REMEMBERED:
            self.follows.clear()
        pair = [self.plain[before], self.plain[piece]]
        known = self.follows[before << 32 | piece] = self.processor.encode("".join(pair), out_type=str) == pair
        return known

    def extend(self, segment: str, counts: list[int], last: list[int]) -> None:
        """Carries on ``counts`` and the last pieces of the prefixes, known up to len(counts) - 1 characters."""
        tails, follows = self.tails, self.follows
        for end in range(len(counts), len(segment) + 1):
            for start in range(end - 1, -1, -1):
                piece = tails.get(segment[start:end])
                if piece is None:
                    start = -1
                    break
                if piece < 0:
                    continue
                before = last[start]
                if before < 0:
                    break
                fits = follows.get(before << 32 | piece)
                if fits is None:
                    fits = self.may_follow(before, piece)
                if fits:
                    break
            else:
                start = -1
            if start >= 0:
                counts.append(counts[start] + 1)
                last.append(piece)
            else:  # a character outside the vocabulary: its bytes, with which nothing merges
                counts.append(counts[end - 1] + len(segment[end - 1].encode()))
                last.append(-1)

    def prefix_counts(self, segment: str) -> list[int]:
        """Token counts of the segment's prefixes of 0, 1, 2, ... characters."""
        counts: list[int] = [0]
        self.extend(segment, counts, [-1])
        return counts

    def segment_counts(self, segments: list[str]) -> np.ndarray:
        """Token counts of whole segments, which are distinct; each starts from the prefix it shares with the one before."""
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        known = self.counts
        before, counts, last = "", [0], [-1]
        for s in sorted([s for s in segments if s not in known]):
            shared = 0
            for x, y in zip(before, s, strict=False):
                if x != y:
                    break
                shared += 1
            del counts[shared + 1 :], last[shared + 1 :]
            self.extend(s, counts, last)
            known[s] = counts[-1]
            before = s
        return np.fromiter(map(known.__getitem__, segments), dtype=np.int64, count=len(segments))


def segments(text: str) -> list[str]:
    """The segments of ``text`` as the tokenizer sees it: with a mark before it and for each space."""
    if not text:
        return []
    return re.findall(f"{MARK}+[^{MARK}]*|^[^{MARK}]+", MARK + text.replace(" ", MARK))


def segment_table(counter: PrefixCounter, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of ``texts``: the offsets of each one's segments, the segments as numbers, and the distinct segments."""
    odd = pc.or_(pc.match_substring_regex(texts, f"^ |  | $|{MARK}"), pc.equal(texts, ""))
    if pc.any(odd).as_py():
        lists = pa.array([segments(t) if o else [MARK + w for w in t.split(" ")] for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], type=pa.list_(pa.large_string()))
        found = lists.flatten().dictionary_encode()
        return np.asarray(lists.offsets), found.indices.to_numpy(), found.dictionary
    lists = pc.split_pattern(texts, " ")
    found = lists.flatten().dictionary_encode()
    return np.asarray(lists.offsets) - lists.offsets[0].as_py(), found.indices.to_numpy(), pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), found.dictionary, pa.scalar("", pa.large_string()))


def _cut(counter: PrefixCounter, ends: np.ndarray, counts: np.ndarray, codes: np.ndarray, distinct: pa.Array, budget: int) -> int:
    """Characters of the longest prefix whose count is at most ``budget``."""
    # A segment counts at least one token and its prefixes count at most their bytes, so only the
    # segment in which the budget ends, and those before it, can hold the cut.
    at = int(np.searchsorted(np.cumsum(counts), budget, side="right"))
    if at == len(codes):
        return int(ends[-1])
    before = int(counts[:at].sum())
    own = np.array(counter.prefix_counts(distinct[int(codes[at])].as_py()))
    fits = int(np.flatnonzero(own <= budget - before)[-1])
    start = int(ends[at - 1]) if at else -1
    return max(0, start + fits)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fitting_chars: the longest prefix of at most ``limit`` tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for batch in batches:
            for a, b in text_slices(batch, 1):
                texts = filled(batch.column(1).slice(a, b - a))
                offsets, codes, distinct = segment_table(counter, texts)
                known = counter.segment_counts(distinct.to_numpy(zero_copy_only=False).tolist())
                sums = np.concatenate([[0], np.cumsum(known[codes])])
                total = sums[offsets[1:]] - sums[offsets[:-1]]
                fitting = np.asarray(pc.utf8_length(texts)).copy()
                sizes = np.asarray(pc.utf8_length(distinct))
                for k in np.flatnonzero(total > limit):
                    own = codes[offsets[k] : offsets[k + 1]]
                    # the first mark is the tokenizer's own and no character of the text
                    fitting[k] = _cut(counter, np.cumsum(sizes[own]) - 1, known[own], own, distinct, limit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.asarray(pc.binary_length(texts)), type=pa.int64()), pa.array(total), pa.array(total > limit), pa.array(fitting, type=pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")


def prefix_table(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and counts: the exact token count of the text's prefix of i characters at place i, for every i."""

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for batch in batches:
            for a, b in text_slices(batch, 1, 1 << 18):
                rows = []
                for text in filled(batch.column(1).slice(a, b - a)).to_pylist():
                    parts, base = [np.zeros(1, dtype=np.int64)], 0
                    for k, segment in enumerate(segments(text)):
                        own = np.array(counter.prefix_counts(segment)) + base
                        parts.append(own[2:] if not k else own[1:])
                        base = int(own[-1])
                    rows.append(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, type=pa.list_(pa.int64()))], ["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tabled, "doc_id long, counts array<long>")


def truncated(docs: DataFrame, prefixes: DataFrame, budget: int) -> DataFrame:
    """doc_id and the longest prefix of its text within ``budget`` tokens, read from ``prefix_table``."""
    fitting = F.array_max(F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: F.element_at("counts", i + 1) <= budget))
    return docs.join(prefixes, "doc_id").select("doc_id", F.expr("coalesce(text, '')").substr(F.lit(1), fitting).alias("text"))
