"""The stages over a small corpus, against brute force."""

import random

import pytest

import corpus_pipeline

from .conftest import DOCS
from .test_jaccard_join import brute
from .test_models import BAD, DE, EN, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        lang = ("en", "de")[i % 2]
        words = prose(rng, EN if lang == "en" else DE, rng.randrange(40, 120)).split()
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), lang))
        labels.append((i, 1, int(toxic)))
    clean = [r for r, l in zip(rows, labels) if not l[2]]
    for k, (_, text, lang) in enumerate(clean[:20]):
        rows.append((1000 + k, text.upper(), lang))  # the same but for A-Z
        words = text.split()
        words[len(words) // 2] = f"changed{k}"
        rows.append((2000 + k, " ".join(words), lang))
    rows += [(3000, "12 34 !!", "en"), (3001, None, "de"), (3002, "", "en")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {i: t for i, t, _ in rows}, {i for i, _, x in labels if x}


def test_stages(spark, folder):
    path, texts, toxic = folder
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), dict(texts)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        out = f"{path}/out-{name}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns, name
        got = {r.doc_id: r.text for r in docs.collect()}
        assert all(left[i] == t for i, t in got.items())
        if name == "toxicity":
            assert not toxic & got.keys() and left.keys() - got.keys() <= toxic
        elif name == "language-id":
            assert left.keys() - got.keys() == {3000, 3001, 3002}
        elif name == "exact-dedup":
            last = {}
            for i, t in sorted(left.items()):
                last[(t or "").encode().lower()] = i
            assert got.keys() == set(last.values())
        else:
            ids = sorted(left)
            parts = brute([left[i] for i in ids])
            assert got.keys() == {ids[root] for _, root in parts.values()}
        left = got
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {p.doc_id for p in pieces} == left.keys()


def test_run_is_the_stages_in_order(spark, folder):
    path, texts, toxic = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert not {r.doc_id for r in rows} & (toxic | {3000, 3001, 3002})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language-id", "exact-dedup", "jaccard-join", "packing"]
