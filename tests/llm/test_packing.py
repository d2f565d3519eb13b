import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm.packing import best_two_fit, pack
from tessera.llm.pieces import open_tokenizer, tokenizer_path

from .conftest import ODD


@pytest.mark.parametrize("low, high", [(1, 40), (1, 2049), (600, 1500), (2048, 2049)])
def test_plan_places_every_piece_once(low, high):
    counts = np.bincount(np.random.default_rng(low).integers(low, high, 3000), minlength=2049)
    plan = best_two_fit(counts, 2048)
    placed = np.zeros_like(counts)
    for times, members in plan:
        assert sum(x * k for x, k in members) <= 2048
        for x, k in members:
            placed[x] += times * k
    assert (placed == counts).all()


def test_two_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = 1, 1, 2  # 6 + 3 leaves 1; 6 + 2 + 2 fills the bin
    assert best_two_fit(counts, 10)[0] == (1, [(6, 1), (2, 2)])


def test_pieces_against_whole_texts(docs):
    texts = ODD + ["long words here " * 2000] + ["hot"] * 500
    rows = pack(docs(texts, extra=("length", "rank", "part"))).collect()
    tokenizer = open_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:])
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) <= 2048
    assert len(by_bin) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_empty_and_repeated(docs):
    assert pack(docs([])).count() == 0
    rows = pack(docs([None, "a", "a"], ids=[None, 1, 1])).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3


def piece_by_piece(lengths, capacity):
    """The method itself, a bin and a piece at a time: how many bins."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], capacity
        for x in sorted(left, reverse=True):
            if x <= gap:
                own.append(x)
                gap -= x
        if gap and len(own) > 1:
            rest = list(left)
            for x in own:
                rest.remove(x)
            small = min(own)
            pairs = [a + b for i, a in enumerate(rest) for b in rest[i + 1 :] if a + b <= gap + small]
            if pairs and max(pairs) > small:
                best = max(pairs)
                a, b = next((a, b) for i, a in enumerate(rest) for b in rest[i + 1 :] if a + b == best)
                own.remove(small)
                own += [a, b]
        for x in own:
            left.remove(x)
        bins.append(own)
    assert all(sum(b) <= capacity for b in bins)
    return len(bins)


def fewest(lengths, capacity):
    """The least number of bins, by trying every place for each piece."""
    best = len(lengths)

    def place(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for j in range(len(gaps)):
            if gaps[j] >= lengths[i] and gaps[j] not in gaps[:j]:
                place(i + 1, [*gaps[:j], gaps[j] - lengths[i], *gaps[j + 1 :]])
        place(i + 1, [*gaps, capacity - lengths[i]])

    place(0, [])
    return best


def test_histogram_plan_against_pieces_and_the_optimum():
    rng = random.Random(2)
    over = 0
    for _ in range(150):
        capacity = rng.randrange(4, 16)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
        plan = best_two_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert sorted(x for times, members in plan for x, k in members for _ in range(k * times)) == sorted(lengths)
        assert all(sum(x * k for x, k in members) <= capacity for _, members in plan)
        bins = sum(times for times, _ in plan)
        assert abs(bins - piece_by_piece(lengths, capacity)) <= 1  # pairs that tie may differ
        optimum = fewest(lengths, capacity)
        assert bins <= optimum + 1
        over += bins > optimum
    assert over <= 15
