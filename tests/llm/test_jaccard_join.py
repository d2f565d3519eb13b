import random
import re

import pytest

from tessera.llm.jaccard_join import jaccard_components, one_of_each

from .conftest import ODD


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def family(rng, size, spread, n=60):
    words = [f"w{rng.randrange(5000)}" for _ in range(n)]
    for _ in range(size):
        own = list(words)
        for _ in range(rng.randrange(spread)):
            own[rng.randrange(n)] = f"x{rng.randrange(5000)}"
        yield " ".join(own[: n - rng.randrange(4)])


@pytest.mark.parametrize("seed, chunk, at_once, hot", [(1, 2000, 1 << 19, 13), (2, 7, 0, 3)])
def test_against_brute_force(docs, monkeypatch, seed, chunk, at_once, hot):
    """The second case takes what a large corpus takes: chunks, salted shingles, the distributed loop for components."""
    monkeypatch.setattr("tessera.llm.jaccard_join.CHUNK", chunk)
    monkeypatch.setattr("tessera.llm.jaccard_join.HOT", hot)
    monkeypatch.setattr("tessera.llm.common.AT_ONCE", at_once)
    rng = random.Random(seed)
    texts = ODD + [t for k in range(6) for t in family(rng, 25, 6)] + ["one two three"] * 3 + ["One two THREE", "a b c d e", "a b c d e f"]
    passage = " ".join(f"p{i}" for i in range(55))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 200))) for _ in range(60)]
    rng.shuffle(texts)
    rows = jaccard_components(docs(texts, extra=("n", "rep", "component_id"))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts)


def test_order_of_frequent_shingles_keeps_links(docs):
    rng = random.Random(5)
    texts = list(family(rng, 150, 5, 40)) + [f"{i} b c d e f g" for i in range(40)]
    rows = jaccard_components(docs(texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts)


def test_null_ids_repeats_and_empty(docs):
    assert jaccard_components(docs([])).count() == 0
    rows = jaccard_components(docs(["a b", "a b", "a b", None, ""], ids=[None, 4, 4, 9, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in rows if r.doc_id) == [(4, 1, 4), (4, 1, 4), (9, 0, 9)]
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.doc_id is None) == [(0, None), (1, None)]


def test_one_of_each_keeps_columns(docs):
    clash = ("kept", "rid", "part", "row", "__gone", "rep")
    left = one_of_each(docs(["a b c d e f", "A b c d e f", "other", None, ""], ids=[3, 1, 2, 5, 6], extra=clash))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 6]


def test_rows_dealt_anew(docs):
    texts = [f"a{i % 300} b{i % 300} c d e f{i % 300} g h" + " z" * (i // 300) for i in range(900)]
    left = one_of_each(docs(texts).repartition(5)).collect()
    assert {r.doc_id for r in left} == {i for i, (_, root) in brute(texts).items() if i == root}
    assert all(r.text == texts[r.doc_id] for r in left)


def test_words_that_collide_under_polynomials(docs):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64, for any base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([word, other] * 4), f"{word} one two three four", f"{other} one two three four"]
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(texts)).collect()}
    assert rows == {0: (2, 0), 1: (1, 1), 2: (1, 2)}
