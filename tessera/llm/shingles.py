"""Word shingles of whole texts as sorted 64-bit hashes, a batch at a time.

A set is known by its hashes: n different shingles of a text share one with a chance of n * n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm.common import BLANK, lower_ascii, mix, strings, view

STEP = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(64)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, of texts without nulls; len + 1 offsets of the texts.

    Each distinct word of the batch is hashed once by XXH3, so two words share a hash by chance only (64 bits)."""
    data, offsets = view(lower_ascii(texts))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inner = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = inner.copy()
    begin[1:] &= ~inner[:-1] | first[1:-1]
    a = np.flatnonzero(begin)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    packed = np.concatenate([[0], np.cumsum(inner)])  # bytes of words before each place
    words = strings(data[inner], np.append(packed[a], packed[-1])).dictionary_encode()
    kinds = words.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))
    return hashes[words.indices.to_numpy(zero_copy_only=False)], np.searchsorted(a, offsets)


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of width words in order, repeated ones too; a text of fewer words is one shingle, of none has none."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    span = len(words) - width + 1
    whole = np.zeros(0, np.uint64)
    if span > 0:
        whole = words[:span] * STEP[0]
        for k in range(1, width):
            whole = whole + words[k : k + span] * STEP[k]
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(int(sizes.sum()), np.uint64)
    begin = np.cumsum(sizes) - sizes
    long = counts >= width
    if long.any():
        shift = np.repeat((at[:-1] - begin)[long], sizes[long])
        place = np.flatnonzero(np.repeat(long, sizes))
        out[place] = whole[place + shift]
    for i in np.flatnonzero((counts > 0) & ~long):
        own = words[at[i] : at[i + 1]]
        out[begin[i]] = (own * np.array(STEP[: len(own)])).sum() + np.array(STEP[width + len(own)])
    return mix(out), np.append(begin, len(out))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ascending."""
    hashes, at = shingle_hashes(texts, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[at[:-1][at[:-1] < len(hashes)]] = True
    ends = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], ends[at]
