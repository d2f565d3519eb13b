"""Encoding whole texts with the tokenizers library, one distinct piece at a time.

Both byte-level BPE with a `` ?word`` pattern and lower-casing word BPE cut every text before white space that follows
something else, and between a letter and a mark of ASCII (but not after an apostrophe, for ``'s``), so the ids of a text are
those of such pieces in a row.  Pieces repeat: a worker keeps the ids of those it has met and asks for new ones only.

A text that may hold the name of an added token, like <|endoftext|>, is encoded whole, as the library finds such names first.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import BLANK, held, ragged, strings, view


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def open_tokenizer(path: str):
    """The tokenizer of a file as the library reads it: the name of a special token in a text is that token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Kinds of bytes: letters and marks of ASCII, without the apostrophe.
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
MARK[39] = False


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, except before a byte over ASCII (it may compose with the letter), and each blank of ASCII a space."""
    upper = (data >= 65) & (data <= 90)
    upper[:-1] &= data[1:] < 0x80
    data = data + (upper * np.uint8(32))
    data[BLANK[data]] = 32
    return data


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text's start, before a blank of ASCII that follows no white space, between letters and marks."""
    if not len(data):
        return np.zeros(0, np.int64)
    blank, letter, mark = BLANK[data], LETTER[data], MARK[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = (blank[1:] & ~blank[:-1]) | (letter[:-1] & (mark[1:] | (data[1:] == 39))) | (mark[:-1] & letter[1:])
    high = np.flatnonzero(begins[1:] & (data[:-1] >= 0x80)) + 1
    if len(high):
        a, b, c = data[np.maximum(high - 3, 0)], data[np.maximum(high - 2, 0)], data[high - 1]
        wide = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        wide |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        begins[high[wide]] = False
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(begins)


def between(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Where parts begin: at each text's start and between bytes that stand apart in a table of pairs."""
    begins = np.zeros(len(data), bool)
    begins[1:] = apart[data[:-1], data[1:]]
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(begins)


class PieceEncoder:
    """Ids of texts through a cache of capacity pieces; when it is full, further ones are kept for their batch only.

    Texts that match the pattern whole go to encode_whole."""

    def __init__(self, encode_batch, fold: bool = False, capacity: int = 300_000, apart: np.ndarray | None = None, whole: str | None = None, encode_whole=None) -> None:
        self.encode_batch, self.fold, self.capacity, self.apart = encode_batch, fold, capacity, apart
        self.whole, self.encode_whole = whole, encode_whole
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())  # piece i has count[i] ids of the pool from first[i] on
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _add(self, pieces: list[str]) -> None:
        """Ids of pieces for the places behind the known ones, some thousands of pieces at a time."""
        parts, counts = [], []
        for a in range(0, len(pieces), 8192):
            ids = self.encode_batch(pieces[a : a + 8192])
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            parts.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(counts[-1].sum())))
        ids, counts = np.concatenate(parts), np.concatenate(counts)
        n, m = len(self.words), len(ids)
        while len(self.first) < n + len(pieces):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while len(self.pool) < self.used + m:
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + m] = ids
        self.first[n : n + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(pieces)] = counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls) in a row, and len + 1 offsets of the texts in them."""
        if self.whole is None:
            return self._by_pieces(texts)
        apart = pc.match_substring_regex(texts, self.whole)
        rows = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        if not len(rows):
            return self._by_pieces(texts)
        ids, at = self._by_pieces(pc.if_else(apart, pa.scalar("", texts.type), texts))
        parts, size, a = [], np.diff(at), 0
        for row in rows.tolist():
            own = np.array(self.encode_whole(texts[row].as_py()), np.uint32)
            parts += [ids[a : at[row]], own]
            size[row], a = len(own), at[row]
        return np.concatenate([*parts, ids[a:]]), np.concatenate([[0], np.cumsum(size)])

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = view(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.fold:
            data = folded(data)
        starts = cuts(data, offsets) if self.apart is None else between(data, offsets, self.apart)
        coded = strings(data, np.append(starts, len(data))).dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.words)
        if place.null_count > max(0.7 * len(place), self.capacity - len(self.words)):  # other texts than before
            self.clear()
            place = pc.index_in(coded.dictionary, value_set=self.words)
        slots = place.fill_null(-1).to_numpy().astype(np.int64)
        lacking = slots < 0
        new = coded.dictionary.filter(pa.array(lacking))
        if len(new):
            slots[lacking] = len(self.words) + np.arange(len(new))
            self._add(new.to_pylist())
        slots = slots[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[slots]
        ids = self.pool[ragged(self.first[slots], counts)]
        if stay := min(len(new), self.capacity - len(self.words)):
            self.words = pa.concat_arrays([self.words, new.slice(0, stay)])
            self.used = int(self.first[len(self.words) - 1] + self.count[len(self.words) - 1])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.searchsorted(starts, offsets)]


def _lower_batch(tokenizer, path: str):
    """encode_batch of a lower-casing tokenizer: words of a-z alone need neither its normaliser nor its splitting."""
    from tokenizers import pre_tokenizers

    plain = open_tokenizer(path)
    plain.normalizer = None
    plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def encode(pieces: list[str]) -> list[list[int]]:
        bare = [p.strip(" ") for p in pieces]
        easy = [w.isascii() and w.isalpha() and w.islower() for w in bare]
        of = (iter([e.ids for e in t.encode_batch_fast([w for w, ok in zip(bare, easy, strict=True) if ok == which], add_special_tokens=False)]) for t, which in ((plain, True), (tokenizer, False)))
        first, second = of
        return [next(first) if ok else next(second) for ok in easy]

    return encode


def encoder(path: str) -> PieceEncoder:
    """This worker process's encoder of a tokenizer file; it stays for later batches and tasks."""

    def make() -> PieceEncoder:
        tokenizer = open_tokenizer(path)
        fold = tokenizer.normalizer is not None and tokenizer.encode("A\nB", add_special_tokens=False).ids == tokenizer.encode("a b", add_special_tokens=False).ids
        batch = _lower_batch(tokenizer, path) if fold else lambda pieces: [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        whole = "(?i)" + "|".join(map(re.escape, names)) if names else None  # in any case, as a normaliser may lower it
        return PieceEncoder(batch, fold, whole=whole, encode_whole=lambda t: tokenizer.encode(t, add_special_tokens=False).ids)

    return held(path, make)
