"""Token ids of many texts, each different word encoded once for as long as it is kept.

For tokenizers that drop white space before they merge, lower-case, and take a run of signs
after a letter for itself. The ids of a text are then those of its words, joined. Words are
told apart on whole Arrow columns; only words that are new go to the tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a Python worker keeps the ids of; beyond it, those seen in one batch only go.
WORD_CACHE = 300_000
#: Text bytes of a batch, about; a longer text is a batch of its own.
BATCH_BYTES = 3 << 20
#: Signs between a letter and white space.
SIGNS = r"([a-zÀ-ÖØ-öø-ÿ])([.,!*$%&#;:?)]+)([ \n])"
#: Words of ASCII and Latin-1 letters, in UTF-8.
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Byte-level vocabularies write a byte that is no visible Latin-1 character as one from 256 on, in order.
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordTokens:
    """``tokens(texts)``: the ids of all texts of an Arrow string array, joined, and where each text's ids end (with a 0 before)."""

    def __init__(self, tokenizer: str, cache: int = WORD_CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        whole = Tokenizer.from_file(tokenizer)
        self.size = whole.get_vocab_size()
        self.encode, self.merge, self.cache = whole.encode_batch_fast, whole.model.tokenize, cache
        self.keep(np.zeros(0, np.int64), [])
        probe = "Ab1 c, \tÉß's <|x|>..  q"
        for text in (probe, probe.replace("<|", "<")):
            if self(pa.array([text]))[0].tolist() != whole.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{tokenizer} keeps white space or case")

    def keep(self, codes: np.ndarray, words: list[bytes]) -> None:
        """Only ``words``, which have the numbers ``codes`` now, stay."""
        if not len(codes):
            self.index: dict[bytes, int] = {}
            self.first, self.flat, self.seen = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int32)
            return
        start, n = self.first[codes], self.first[codes + 1] - self.first[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        self.flat = self.flat[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
        self.first, self.seen = ends, np.ones(len(codes), np.int32)  # they have to be met again before the next time
        self.index = dict(zip(words, range(len(words))))

    def add(self, new: list[bytes]) -> None:
        """Words of Latin letters alone are one pre-token and go to the merges at once; the others take the tokenizer's whole way."""
        ids: list[list[int]] = [[]] * len(new)
        merge, latin, rest = self.merge, [], []
        for k, w in enumerate(new):
            if w.isalpha():  # of bytes: ASCII letters
                ids[k] = [t.id for t in merge(w.decode().lower())]
            else:
                (latin if LATIN.fullmatch(w) else rest).append(k)
        if latin:
            spelt = b"\n".join([new[k] for k in latin]).decode().lower().encode().decode("latin-1").translate(BYTE_CHARS)
            for k, w in zip(latin, spelt.split(chr(BYTE_CHARS[10]))):
                ids[k] = [t.id for t in merge(w)]
        for k, e in zip(rest, self.encode([new[k].decode() for k in rest], add_special_tokens=False)):
            ids[k] = e.ids
        n, at = len(self.index), self.first[len(self.index)]
        ends = at + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.first, self.seen, self.flat = room(self.first, n + len(new) + 1), room(self.seen, n + len(new)), room(self.flat, ends[-1])
        self.first[n + 1 : n + len(new) + 1] = ends
        self.flat[at : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, ends[-1] - at)
        self.index.update(zip(new, range(n, n + len(new))))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.cache:
            often = [(w, c) for w, c in self.index.items() if self.seen[c] > 1]
            often = often if len(often) <= self.cache // 2 else []
            self.keep(np.array([c for _, c in often], np.int64), [w for w, _ in often])
        texts = pc.fill_null(texts, "")
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.replace_substring_regex(pc.ascii_lower(texts), SIGNS, r"\1 \2\3")))
        flat = words.flatten().cast(pa.large_binary()).dictionary_encode()
        own = flat.dictionary.to_pylist()
        codes = np.fromiter(map(self.index.get, own, repeat(-1)), np.int64, len(own))
        if len(new := np.flatnonzero(codes < 0)):
            codes[new] = len(self.index) + np.arange(len(new))
            self.add([own[k] for k in new.tolist()])
        self.seen[codes] += 1
        first = self.first[codes]
        n = (self.first[codes + 1] - first)[at := flat.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((first[at] - ends[:-1]).astype(np.int32), n)
        place += np.arange(ends[-1], dtype=np.int32)
        return self.flat[place], ends[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])]


def room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with place for n values; it doubles when it grows."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


@lru_cache(1)
def word_tokens(tokenizer: str) -> WordTokens:
    """One for all tasks of a Python worker."""
    return WordTokens(tokenizer)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part's ``column`` holds about ``size`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
