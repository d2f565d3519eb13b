import zlib

import numpy as np
import pytest

from tessera.llm.pieces import open_tokenizer, tokenizer_path
from tessera.llm.token_files import SEGMENT, _every, canonical, code_lengths, lookup, pack_bits, read_tokens, token_digest, unpack_bits, write_tokens

from .conftest import ODD


@pytest.mark.parametrize("n, limit", [(1, 16), (2, 16), (3, 2), (40, 6), (5000, 16)])
def test_code_is_prefix_free_and_limited(n, limit):
    counts = (np.random.default_rng(n).zipf(1.3, n) % 10**6) + 1
    lengths = code_lengths(counts, limit)
    assert lengths.max() <= limit and lengths.min() >= 1
    assert n == 1 or sum(2.0 ** -lengths.astype(float)) == 1
    ids = np.random.default_rng(0).integers(0, n, 4000).astype(np.uint32)
    at = np.array([0, 0, 1, 700, 700, 4000])
    raw, begin, positions = pack_bits(ids, at, canonical(lengths), lengths)
    table = lookup(lengths)
    sizes = np.diff(at)
    marks = positions[_every(sizes)]
    per = -(-sizes // SEGMENT)
    assert (_every(sizes) == np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(at[:-1], at[1:])])).all()
    assert (begin[:-1][sizes > 0] * 8 == marks[np.cumsum(per)[sizes > 0] - per[sizes > 0]]).all()
    counts = np.concatenate([[min(SEGMENT, s - SEGMENT * j) for j in range(p)] for s, p in zip(sizes, per)]).astype(int)
    assert (unpack_bits(raw, marks, counts, table) == ids).all()


def test_limit_costs_little_and_matches_huffman():
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 300)
    heap = list(counts)
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert (code_lengths(counts, 24) * counts).sum() == cost


def test_files_round_trip(spark, docs, tmp_path):
    texts = ODD + ["many words here " * 900]
    ids = [5 * (7 * i % len(texts)) - 9 for i in range(len(texts))]
    tokenizer = open_tokenizer(tokenizer_path("word_bpe_49k.json"))
    frame = docs(texts, ids=ids, extra=("n", "start", "range"))
    write_tokens(frame, str(tmp_path / "t"), block_tokens=1000)
    got = sorted(read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.doc_id)
    start = 0
    for (i, t), r in zip(sorted(zip(ids, texts)), got, strict=True):
        want = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(want), want.tobytes())
        start += len(want)
    digest = {r.doc_id: r.ids_crc32 for r in token_digest(frame).collect()}
    assert digest == {r.doc_id: zlib.crc32(bytes(r.ids)) for r in got}


def test_null_ids_repeats_and_empty(docs):
    rows = token_digest(docs(["b", "a", "a", None], ids=[None, 3, 3, None])).collect()
    assert sorted((r.doc_id is not None, r.start) for r in rows) == [(False, 0), (False, min(r.start for r in rows if r.start)), (True, 3), (True, 5)]
    assert token_digest(docs([])).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_whole_texts(name):
    import random

    import pyarrow as pa

    from tessera.llm.pieces import PieceEncoder, encoder

    rng = random.Random(4)
    parts = ["a", "B", "word", "I\u0307", "W\u030a", "e\u0301", "'s", "'", "'T", "(", "...", "9", "1a", "\u00a0", "\u2003", "\u3000", "\x85", " ", "  ", "\n", "\t\n", "é", "Σ", "日本", "_", "\x1c", "\u200b", "<", "\u0338", "-", "ʼn", "K"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    tokenizer, encode = open_tokenizer(tokenizer_path(name)), encoder(tokenizer_path(name))
    small = PieceEncoder(encode.encode_batch, encode.fold, capacity=50)
    for one in (encode, small, small):
        ids, at = one(pa.array(texts))
        for t, a, b in zip(texts, at[:-1], at[1:]):
            assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name, special", [("word_bpe_49k.json", 49407), ("byte_bpe_50k.json", 50256)])
def test_names_of_special_tokens_are_those_tokens(name, special):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from tessera.llm.pieces import encoder

    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endoft", "ext|>", "word", " end", "A", " ", "\n", "é", "\u0338", "'s", "..."]
    texts = ["end of doc <|endoftext|> next", "", *("".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(1000)), "plain"]
    plain, encode = Tokenizer.from_file(tokenizer_path(name)), encoder(tokenizer_path(name))
    for some in (texts, texts[:1], texts[1:2], ["a b", "c"]):
        ids, at = encode(pa.array(some))
        for t, a, b in zip(some, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    ids, at = encode(pa.array(texts[:1]))
    assert special in ids.tolist() and len(ids) == {49407: 5, 50256: 6}[special]
