import math

import numpy as np
import pytest

from tessera.llm.embedding_dedup import COUNTED, LOST, Windows, calibrate, near_vectors, window_count

ROWS = "vec_id long, embedding array<float>, label int, kept int"


def brute(vectors):
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(vectors[i], np.float32).astype(float) for i in good}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    label, links = list(range(len(vectors))), [0] * len(vectors)

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in good:
        for j in good:
            if i < j and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [(links[i], root(i)) for i in range(len(vectors))]


def near(rng, v, cosine):
    away = rng.standard_normal(len(v))
    away -= away @ v * v
    return cosine * v + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)


def test_count_is_calibrated():
    half, need = window_count(0.95)
    hits = np.abs(np.random.default_rng(0).standard_normal((200_000, COUNTED)) * math.sqrt(0.1)) <= half
    assert 0 < (hits.sum(1) < need).mean() <= 1.2 * LOST


@pytest.mark.parametrize("shift, chunk", [(0.0, 2048), (1.5, 30)])
def test_recall_and_exactness(spark, monkeypatch, shift, chunk):
    monkeypatch.setattr("tessera.llm.embedding_dedup.CHUNK", chunk)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 64)) + shift
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = [*base, *(near(rng, b, c) for b in base[:60] for c in (0.949, 0.9501, 0.96, 0.99)), *([base[5]] * 80), *(near(rng, base[6], 0.999) for _ in range(80))]
    vectors = [v.astype(np.float32).tolist() for v in vectors]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], ROWS)).collect()}
    want = brute(vectors)
    found, there = sum(r.n_links for r in got.values()), sum(n for n, _ in want)
    assert 0.93 * there <= found <= there
    assert all(got[i].n_links <= n for i, (n, _) in enumerate(want))
    assert np.mean([got[i].component_id == c for i, (_, c) in enumerate(want)]) > 0.97


def test_odd_vectors(spark):
    one, other = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    vectors = [one, one, other, None, [], [0.0, 0.0, 0.0], [None, 1.0, 1.0], [math.nan, 1.0, 1.0], [math.inf, 1.0, 1.0], [1.0, 2.0], [1e-30, 2e-30, 3e-30]]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], ROWS)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in enumerate(brute(vectors))}
    rows = near_vectors(spark.createDataFrame([(None, one, 0, 0), (3, one, 0, 0), (3, one, 0, 0)], ROWS)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in rows) == [(-1, 0, True), (3, 1, True), (3, 1, True)]
    assert near_vectors(spark.createDataFrame([], ROWS)).count() == 0


def test_windows_of_sorted_lists_are_distances():
    rng = np.random.default_rng(3)
    seen = np.concatenate([rng.standard_normal((60, 5)), np.repeat(rng.standard_normal((1, 5)), 9, 0)])
    got = Windows(seen, 0.4).collisions(10, 40)
    want = (np.abs(seen[10:40, None] - seen[None, 10:]) <= 0.4).sum(2)
    assert (got == want).all()


def test_recall_just_over_the_threshold(spark):
    """Planted pairs of cosines from 0.9501 to 0.96, the hardest to find."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((700, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pairs = [near(rng, b, 0.9501 + 0.0099 * rng.random()) for b in base]
    vectors = [v.astype(np.float32).tolist() for v in [*base, *pairs]]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], ROWS)).collect()}
    want = brute(vectors)
    found, there = sum(r.n_links for r in got.values()), sum(n for n, _ in want)
    print("recall", found / there)
    assert there >= 1400 and found >= 0.95 * there
    assert all(got[i].n_links <= n for i, (n, _) in enumerate(want))


def test_tables_that_cannot_reach_the_recall_are_an_error(monkeypatch):
    monkeypatch.setattr("tessera.llm.embedding_dedup.MOST_TABLES", 2)
    x = np.random.default_rng(0).standard_normal((100, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    with pytest.raises(ValueError):
        calibrate(x, x.mean(0), 40, 0.95)
