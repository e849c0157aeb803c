"""Encoding of whitespace-separated words with a ``tokenizers`` file, each distinct word once.

The tokenizer's pre-tokenizer drops white space and never joins across it, so a text's ids are its
words' ids one after another.  A run of plain punctuation behind a letter or digit is a pre-token of
its own and is encoded apart, which leaves far fewer distinct words.  Which letters are such is asked of
the tokenizer itself: some become a letter and a mark when it normalises them, and a mark joins the run.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cellframe.llm.common import gather

#: Punctuation that is split from the end of a word.
TRAILING = ".,!$%*#&?;:"
#: Words that a worker remembers; beyond it forgets all and starts anew, which changes no result.
REMEMBERED = 150_000
#: Words that are encoded as one string.
JOINED = 256
#: Words that normalise to lower case and stay one pre-token: letters of the Latin-1 range.
SIMPLE = re.compile("[a-zA-Z\u00df-\u00f6\u00f8-\u00ff\u00c0-\u00d6\u00d8-\u00de]+").fullmatch

_open: dict[str, "WordEncoder"] = {}


def word_encoder(path: str) -> "WordEncoder":
    """The worker's encoder of the file at ``path``."""
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]


class WordEncoder:
    """Ids of words: ``ids[starts[s] : starts[s] + lengths[s]]`` are those of the word in slot ``s``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.simple = Tokenizer(self.tokenizer.model)
        self.simple.normalizer = normalizers.Lowercase()
        self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.pieces = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.closing = np.array([p.endswith("</w>") for p in self.pieces])
        self.ends: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.starts = np.zeros(1, dtype=np.int64)
        self.lengths = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, ends = len(self.starts), np.cumsum(lengths) + len(self.ids)
        self.slots.update(zip(words, range(first, first + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def ends_word(self, letter: str) -> bool:
        """Whether punctuation behind ``letter`` is a pre-token of its own, as the tokenizer splits them."""
        if letter not in self.ends:
            parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(letter + "."))
            self.ends[letter] = len(parts) > 1 and parts[-1][0] == "."
        return self.ends[letter]

    def slots_of(self, words: list[str]) -> np.ndarray:
        """A slot for each of ``words``, which are distinct."""
        new = [w for w in words if w not in self.slots]
        simple = [w for w in new if SIMPLE(w)]
        if simple:
            joined = [" ".join(simple[i : i + JOINED]) for i in range(0, len(simple), JOINED)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.simple.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.closing[ids]) + 1
            self._add(simple, ids, np.diff(ends, prepend=0))
        others = [w for w in new if not SIMPLE(w)]
        if others:
            parts = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            lengths = np.array([len(p) for p in parts], dtype=np.int64)
            self._add(others, np.array([x for p in parts for x in p], dtype=np.uint32), lengths)
        return np.fromiter(map(self.slots.__getitem__, words), dtype=np.int64, count=len(words))

    def slots_of_words(self, words: pa.Array) -> np.ndarray:
        """Two slots for each of the distinct ``words``: that of the word and that of its trailing punctuation."""
        if len(self.slots) > REMEMBERED:
            self.forget()
        base = pc.utf8_rtrim(words, characters=TRAILING)
        stems, whole = listed(pc.ascii_lower(base)), listed(words)
        ends = [""] * len(whole)
        for i in np.flatnonzero(pc.not_equal(base, words).to_numpy(zero_copy_only=False)).tolist():
            stem, word = stems[i], whole[i]
            if stem and self.ends_word(stem[-1]):
                ends[i] = word[len(stem) :]
            else:
                stems[i] = word
        for i in np.flatnonzero(pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)).tolist():
            stems[i], ends[i] = whole[i], ""
        distinct = pa.array(stems + ends, type=pa.large_string()).dictionary_encode()
        slots = self.slots_of(listed(distinct.dictionary))[distinct.indices.to_numpy()]
        return slots.reshape(2, -1).T.copy()


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts: the offsets of each one's words, the words as numbers, and the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    return np.asarray(lists.offsets) - lists.offsets[0].as_py(), words.indices.to_numpy(zero_copy_only=False), words.dictionary


def encode_texts(encoder: WordEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``texts`` one after another, and the offsets of each one's."""
    offsets, codes, distinct = split_words(texts)
    slots = encoder.slots_of_words(distinct)
    flat = slots[codes].ravel()
    lengths = encoder.lengths[flat]
    ids = encoder.ids[gather(encoder.starts[flat], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ids, ends[2 * offsets]
