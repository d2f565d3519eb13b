import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm.common import rice_decode, rice_encode
from tessera.llm.exact_dedup import drop_copies, exact_dedup

from .conftest import ODD


def plain(text):
    return (text or "").encode().lower()


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        values = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        values[n // 2 :] = values[n // 2 :][:1].repeat(n - n // 2) if n else values
        k, blob = rice_encode(np.sort(values), 0, 1 << 64)
        assert (rice_decode(blob, k, n, 0) == np.sort(values)).all()


@pytest.mark.parametrize("bits, size", [(2, 7), (64, 1 << 17)])
def test_against_brute_force(docs, bits, size):
    texts = ODD * 3 + ["hot"] * 100
    rows = {r.doc_id: r for r in exact_dedup(docs(texts, extra=("kept", "rid")), print_bits=bits, list_rows=size).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[plain(t)].append(i)
    assert len(rows) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(ids), len(ids), i == max(ids))
            assert rows[i].text_sha256 == hashlib.sha256(t).hexdigest()


def test_repeated_rows_null_ids_and_empty(docs):
    got = exact_dedup(docs(["a", "a", "a", "b"], ids=[7, 7, None, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got) == [(-1, -1, 1), (-1, 7, 3), (7, 7, 3), (7, 7, 3)]
    assert sum(r.kept for r in got) == 2
    assert exact_dedup(docs([])).count() == 0


def test_drop_copies_keeps_columns(docs):
    clash = ("rid", "part", "row", "__rid", "keep_rid")
    left = drop_copies(docs(["x", "X", "y", None, ""], extra=clash))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 4]


def test_inputs_that_are_no_plain_scans(docs):
    """Rows dealt anew by every run of the plan: each text stays once, in the row with its largest id."""
    texts = [f"text {i % 500}" for i in range(1500)]
    rows = docs(texts).repartition(7)
    for given in (rows, rows.where("doc_id >= 0").repartition(3), rows.join(rows.select("doc_id"), "doc_id").repartition(5)):
        left = drop_copies(given).collect()
        assert sorted(r.doc_id for r in left) == list(range(1000, 1500))
        assert all(r.text == f"text {r.doc_id % 500}" for r in left)


def test_very_long_texts(docs):
    long = "Word " * 2_000_000
    rows = {r.doc_id: r.keep_id for r in exact_dedup(docs([long, long + "x", long.lower(), "b"])).collect()}
    assert rows == {0: 2, 1: 1, 2: 2, 3: 3}
