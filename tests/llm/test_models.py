"""Held-out accuracy, methods and odd inputs of the trained operators."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.language import Net, keep_known, language, windows
from tessera.llm.learn import sample_texts
from tessera.llm.quality import PASSAGE, Bags, measures, quality
from tessera.llm.toxicity import Scorer, keep_clean, toxicity
from tessera.llm.toxicity import train as train_toxicity

from .conftest import ODD

EN = "the house and river with some people walking over green hills to their small town where every morning begins".split()
DE = "das haus und der fluss mit einigen leuten die über grüne hügel zu ihrer kleinen stadt gehen jeden morgen".split()
BAD = ["scoundrel", "vermin", "blockhead"]


def prose(rng, words, n=40):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        text, toxic, good = prose(rng, EN if lang == "en" else DE, rng.randrange(25, 200)), int(i % 5 == 0), int(i % 4 != 0)
        if toxic:
            words = text.split()
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
            text = " ".join(words)
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 8 else " ".join(w + " " + w + " " + w for w in text.split())
        rows.append((i, text, lang, toxic, good))
    return rows


@pytest.fixture
def tables(spark, corpus):
    docs = spark.createDataFrame([(i, t, lang, "s", len(t), 0) for i, t, lang, _, _ in corpus], "doc_id long, text string, lang string, source string, n_chars long, score int")
    labels = spark.createDataFrame([(i, good, toxic) for i, _, _, toxic, good in corpus], "doc_id long, quality int, toxic int")
    return docs, labels


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_toxicity_held_out(tables, corpus):
    rows = {r.doc_id: r for r in toxicity(*tables).collect()}
    assert len(rows) == len(corpus)
    test = [(rows[i].predicted, toxic) for i, _, _, toxic, _ in corpus if held(i, 5, 0)]
    assert all(rows[i].held_out == held(i, 5, 0) and rows[i].predicted == (rows[i].score >= 0.5) for i, *_ in corpus)
    assert np.mean([a == b for a, b in test]) >= 0.95
    left = keep_clean(*tables)
    assert left.columns == tables[0].columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in rows.items() if not r.predicted}


def test_disguises_are_restored(corpus):
    model = train_toxicity([(i, t, toxic) for i, t, _, toxic, _ in corpus])
    for disguise in ("sc0undrel", "SC0UNDR3L", "v.e.r.m.i.n", "verrrrmin", "bl0ckhe@d", "ve-rmin", "v3rmin!", "(vermin),"):
        assert model.hit(model.word(disguise)) > 0, disguise
    for plain in ("house", "r1ver", "2024", "3.5", "green-hills"):
        assert model.hit(model.word(plain)) == 0, plain
    score = Scorer(model)
    text = prose(random.Random(1), EN, 30)
    clean, spaced = score(pa.array([text, text + " you v e r m i n and v e r m i n"]))
    assert clean < 0.5 < spaced
    small = Scorer(model, capacity=3)
    texts = pa.array([t for _, t, *_ in corpus])
    assert np.allclose(score(texts), small(texts))


def test_signs_at_edges_and_doubled_letters_are_restored(corpus):
    model = train_toxicity([(i, t, toxic) for i, t, _, toxic, _ in corpus])
    for disguise in ("$coundrel", "(scoundre|", "$coundre|!", "scoundre|.", "!verm!n", "verm!n!", "(vermin", "b|ockhead+", "veermin", "vveerrmmiinn", "bblloocckkhheeaadd!", "(VEERM!N)"):
        assert model.hit(model.word(disguise)) > 0, disguise
    for plain in ("house!", "(river", "|hills|", "+morning", "hills", "over!!", "$100", "(2024)", "!", "((", "walking+", "green|hills"):
        assert model.hit(model.word(plain)) == 0, plain
    bad = ["idiot", "clown", "loser", "asshat", "trash"]
    model = train_toxicity([(i, f"{t} {bad[i % 5]}" if toxic else t, toxic) for i, (_, t, _, toxic, _) in enumerate(corpus * 2) for t in [f"{t} {i}"]])
    model.lexicon |= {f"{w}$": 3.0 for w in ("idiot", "clown", "loser", "trash", "ass")}
    for disguise in ("!diot", "!d!ot", "(lown", "|oser", "+rash", "a$$", "iidiot", "iiddiioott", "(|own!"):
        assert model.hit(model.word(disguise)) > 0, disguise
    text = prose(random.Random(2), EN, 30)
    clean, hidden = Scorer(model)(pa.array([text, text + " !diot (lown |oser iiddiioott"]))
    assert clean < 0.5 < hidden


def test_restored_words_are_the_best_of_the_whole_lattice(corpus):
    model = train_toxicity([(i, t, toxic) for i, t, _, toxic, _ in corpus])

    def cost(parts):
        a = b = "\0"
        total = sum(toll for _, toll in parts)
        for c in "".join(out for out, _ in parts) + "\0":
            total += model.price(a, b, c)
            a, b = b, c
        return total

    rng = random.Random(4)
    words = ["v3rm1n", "b|0ckh3@d", "sc..0uunn", "1|1|1", "日1本@語", "aa11bb", "+.+.$"] + ["".join(rng.choice("aaehvmin013@$.-|!") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    for word in words:
        for lead, tail in ((0, 0), (1, 0), (0, 1)) if word[0] in "@$!|+(" and word[-1] in "@$!|+(" else ((0, 0),):
            every = [parts for parts in itertools.product(*model.lattice(word, lead, tail))]
            best = min(map(cost, every))
            assert any("".join(out for out, _ in parts) == model.restore(word, lead, tail) and abs(cost(parts) - best) < 1e-6 for parts in every), word
    assert model.restore("a1" * 50_000).count("1") < 50_000  # long ones too


def test_words_that_are_not_restored_have_no_hit(corpus):
    """The short way of value() against restoring every word."""
    model = train_toxicity([(i, t, toxic) for i, t, _, toxic, _ in corpus])
    model.lexicon |= {"ass$": 3.0, "loos": 2.5, "trass": 2.0}
    rng = random.Random(6)
    words = ["ass", "a$$", "aass!", "loose", "lloooser", "as$", "as$$", "tras$$", "TRASH!!", "hills$$$", "too!!", "vermi$$", "vermin!!", "blockhea|"]
    words += ["".join(rng.choice("aasslootrvermin") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randrange(1, 7))) + rng.choice(("", "!", "$$", "|", ".", "!!", "$!")) for _ in range(3000)]
    for word in words:
        assert model.value(word) == model.hit(model.word(word)), word
    assert sum(model.value(w) > 0 for w in words) > 10


def test_three_hundred_languages_are_all_learned(spark):
    rng = random.Random(9)
    rows = [(5 * k + j, " ".join(f"{chr(0x4E00 + 2 * k)}{chr(0x4E01 + 2 * k)}{rng.choice('abc')}" for _ in range(12)), f"l{k:03}") for k in range(300) for j in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = sample_texts(docs, docs.selectExpr("doc_id", "lang AS label"), docs["doc_id"] >= 0, 2)
    assert len(sample) == 600 and len({y for _, _, y in sample}) == 300
    assert len(sample_texts(docs, docs.selectExpr("doc_id", "lang AS label"), docs["doc_id"] >= 0, 2, 450)) == 300
    with pytest.raises(ValueError):
        sample_texts(docs, docs.selectExpr("doc_id", "lang AS label"), docs["doc_id"] >= 0, 2, 299)


def test_what_only_the_end_of_a_long_text_shows_is_learned():
    from tessera.llm.language import train as train_language
    from tessera.llm.quality import train as train_quality

    rng = random.Random(8)
    same = lambda: prose(rng, EN, 3000)
    bad = lambda: same() + " " + "#$%& @@@ |||| " * 400
    model = train_quality([(2 * i + k, (bad if k else same)(), 1 - k) for i in range(40) for k in (0, 1)])
    assert (model(pa.array([same() for _ in range(10)])) > 0.5).all() and (model(pa.array([bad() for _ in range(10)])) < 0.5).all()
    late = [(2 * i + k, (EN[0] + " ") * 2000 + prose(rng, DE if k else EN, 4000), ("en", "de")[k]) for i in range(6) for k in (0, 1)]
    names, _ = train_language(late)(pa.array([prose(rng, EN, 50), prose(rng, DE, 50)]))
    assert names == ["en", "de"]


def test_names_of_columns_may_clash(tables):
    docs, labels = tables
    docs = docs.selectExpr("*", "1 AS __text", "2 AS row", "3 AS predicted")
    for kept in (keep_clean(docs, labels), keep_known(docs, docs)):
        assert kept.columns == docs.columns and kept.agg({"predicted": "min"}).first()[0] == 3


def test_language_held_out(tables, corpus):
    docs, _ = tables
    rows = {r.doc_id: r for r in language(docs, docs).collect()}
    assert all(rows[i].lang_pred == lang for i, _, lang, _, _ in corpus if held(i, 5, 0))
    assert all(0 <= r.score <= 1 for r in rows.values())
    left = keep_known(docs, docs)
    assert left.columns == docs.columns and left.count() == len(corpus)


def test_pair_tables_equal_the_convolution():
    net = Net(["a", "b", "c"])
    x = np.random.default_rng(0).integers(0, 256, (20, 128)).astype(np.uint8)
    p, tops = net.params, []
    for w in (2, 3, 4):
        tops.append(np.stack([sum(p[f"t{w}"][i][x[:, at + i]] for i in range(w)) for at in range(128 - w + 1)]).max(0))
    logits = np.tanh(np.concatenate(tops, 1)) @ p["out"] + p["bias"]
    assert np.allclose(net.log_odds(x), logits - np.log(np.exp(logits).sum(1, keepdims=True)), atol=1e-4)


def test_windows_hold_every_byte():
    texts = ["", "A" * 127, "b" * 128, "ç" * 100]
    x, owner = windows(pa.array(texts))
    assert owner.tolist() == [1, 2, 3, 3]
    assert x[2:].tobytes().rstrip() == ("ç" * 100).encode()


@pytest.mark.parametrize("kind", ["net", "bags"])
def test_gradients(kind):
    rng = np.random.default_rng(0)
    if kind == "net":
        model = Net(["a", "b"])
        model.params = {k: v.astype(float) for k, v in model.params.items()}
        x, y = rng.integers(97, 103, (6, 128)).astype(np.uint8), np.array([0, 1, 1, 0, 1, 0])

        def loss(p):
            tops = np.concatenate([sum(p[f"t{w}"][i][x[:, i : i + 129 - w]] for i in range(w)).max(1) for w in (2, 3, 4)], 1)
            z = np.tanh(tops) @ p["out"] + p["bias"]
            return -np.mean((z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(6), y])

        grads = model.gradient(model.params, x, y)
    else:
        model = Bags(9)
        x, bag, y = rng.standard_normal((10, 9)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3, 3]), np.array([1.0, 0, 1, 0])

        def loss(p):
            code, _, _, s = model.encode(x, p)
            total = 0
            for i in range(4):
                e = np.exp(s[bag == i])
                q = 1 / (1 + np.exp(-((e / e.sum()) @ code[bag == i] @ p["w"] + p["b"][0])))
                total -= np.log(q if y[i] else 1 - q) / 4
            return total

        grads = model.gradient(model.params, x, bag, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        moved = []
        for step in (1e-5, -1e-5):
            p = {k: v.copy() for k, v in model.params.items()}
            p[name][at] += step
            moved.append(loss(p))
        assert abs((moved[0] - moved[1]) / 2e-5 - g[at]) < 1e-4, name


def test_quality_held_out(tables, corpus):
    rows = {r.doc_id: r for r in quality(*tables).collect()}
    test = [(rows[i].predicted, good) for i, _, _, _, good in corpus if held(i, 3, 1)]
    assert all(rows[i].held_out == held(i, 3, 1) for i, *_ in corpus)
    assert np.mean([a == b for a, b in test]) >= 0.95


def test_measures_take_the_whole_text():
    long = "word " * 5000 + "END!!"
    x, owner = measures(pa.array(["", long]))
    assert owner.tolist() == [0] + [1] * -(-len(long) // PASSAGE)
    assert x[-1, 8] > 0 and not x[:-1, 8].any()


def test_scores_do_not_depend_on_batches(corpus):
    from tessera.llm.quality import train as train_quality

    model = train_quality([(i, t, good) for i, t, _, _, good in corpus])
    texts = [t for _, t, *_ in corpus] + [t or "" for t in ODD]
    one = np.concatenate([model(pa.array([t])) for t in texts])
    assert np.allclose(model(pa.array(texts)), one)


def test_odd_texts_and_missing_labels(docs, tables):
    odd, (train_docs, labels) = docs(ODD, ids=[None, *range(1000, 1000 + len(ODD) - 1)]), tables
    none = labels.where("false")
    for op in (toxicity, quality):
        assert op(odd, labels).count() == len(ODD)
        assert len({r.score for r in op(odd, none).collect()}) == 1
        assert op(docs([]), labels).count() == 0
    rows = language(odd, odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows} == {"en", "und"}
    assert sum(r.lang_pred == "und" for r in rows) == sum(not any(c.isalpha() for c in t or "") for t in ODD)
    assert {r.lang_pred for r in language(odd, odd.where("false")).collect()} == {"und"}
    assert language(docs([]), docs([])).count() == 0


def test_samples_are_bounded_and_not_held_out(tables):
    from pyspark.sql import functions as F

    from tessera.llm.common import crc_of_id

    docs, labels = tables
    rows = sample_texts(docs, labels.select("doc_id", F.col("toxic").alias("label")), crc_of_id() % 5 != 0, 10)
    assert len(rows) == 20 and not any(held(i, 5, 0) for i, _, _ in rows)


def test_bags_against_a_plain_scorer(corpus):
    """Each document by itself, passage by passage, with loops instead of arrays."""
    import math

    from tessera.llm.quality import train as train_quality

    model = train_quality([(i, t, good) for i, t, _, _, good in corpus])
    p = {k: v.tolist() for k, v in model.params.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda row, table, j: sum(a * table[i][j] for i, a in enumerate(row))
    for text in [corpus[0][1], corpus[1][1] * 9, "", "x"]:
        x, _ = measures(pa.array([text]))
        weight, total = 0.0, [0.0] * len(p["eb"])
        for row in x:
            row = [max(-6.0, min(6.0, (a - s) / c)) for a, s, c in zip(row, model.shift, model.scale)]
            code = [math.tanh(dot(row, p["e"], j) + b) for j, b in enumerate(p["eb"])]
            gate = sum(math.tanh(dot(code, p["v"], j)) * sig(dot(code, p["u"], j)) * a for j, a in enumerate(p["a"]))
            weight += math.exp(gate)
            total = [t + math.exp(gate) * c for t, c in zip(total, code)]
        want = sig(sum(t / weight * w for t, w in zip(total, p["w"])) + p["b"][0])
        assert abs(float(model(pa.array([text]))[0]) - want) < 1e-9


def test_measures_against_counting():
    text = "The the cat sat. 12!! ÄÖ\n" * 60
    x, owner = measures(pa.array(["one", text]))
    raw = text.encode()
    for i in range(len(x) - 1):
        part = raw[PASSAGE * i : PASSAGE * (i + 1)]
        assert abs(x[1 + i, 0] - sum(97 <= b <= 122 for b in part) / len(part)) < 1e-12
        assert abs(x[1 + i, 2] - sum(48 <= b <= 57 for b in part) / len(part)) < 1e-12
        assert abs(x[1 + i, 5] - sum(b >= 128 for b in part) / len(part)) < 1e-12
    assert (owner == [0] + [1] * (len(x) - 1)).all()


@pytest.fixture(scope="module")
def many(spark):
    """Over 2000 labelled rows of each kind, and the model that the tables give."""
    from tessera.llm.toxicity import learn

    rng = random.Random(12)
    rows = []
    for i in range(6000):
        words = prose(rng, EN, 12).split() + [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"]
        rows.append((i, " ".join(words + [rng.choice(BAD)] * (i % 2)), i % 2))
    rows += [(9000 + k, rows[k][1], rows[k][2]) for k in range(50)]  # copies count once
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(7)
    return rows, learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def test_toxicity_learns_from_all_labelled_rows(many):
    """The lexicon, the known words and the regression of tables are those of all rows at hand."""
    rows, model = many
    want = train_toxicity([r for r in rows if not held(r[0], 5, 0)])
    assert model.lexicon and model.lexicon == want.lexicon and model.clean == want.clean
    assert np.allclose(model.weights, want.weights)


def test_letters_are_learned_from_all_labelled_rows(many):
    """Each document has a word of its own, and the letters of all of them count but for a few chance near copies."""
    rows, model = many
    assert model.after == train_toxicity([r for r in rows if not held(r[0], 5, 0)]).after
    own = [t.split()[12] for i, t, _ in rows if i < 9000 and not held(i, 5, 0)]
    heads = {}
    for w in own:
        heads[w[1]] = heads.get(w[1], 0) + 1
    assert len(own) > 4700 and all(model.after["\0w"][c] >= 0.9 * n for c, n in heads.items())


def test_documents_that_share_a_line_are_all_learned(spark):
    """Different texts with a common line are no copies; of equal ones one counts for each label, and the letters of all."""
    import math
    from collections import Counter

    from tessera.llm.toxicity import fold_of, learn, tells_known

    rng = random.Random(13)
    line = prose(rng, EN, 12)
    rows = [(i, " ".join([line, *("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(30)), *["vermin"] * (i % 2)]), i % 2) for i in range(300)]
    rows += [(1000 + k, rows[k][1].upper(), rows[k][2] if k % 3 else 1 - rows[k][2]) for k in range(60)]
    model = learn(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    rows = [r for r in rows if not held(r[0], 5, 0)]
    heads = Counter()
    for w, n in Counter(w for _, t, _ in rows for w in t.lower().split()).items():
        heads[w[0]] += 1 + math.log(n)
    assert model.after["\0\0"].keys() == heads.keys() and all(abs(model.after["\0\0"][c] - n) < 1e-3 for c, n in heads.items())
    once = {}
    for i, t, y in rows:
        once.setdefault((t.lower(), y), i)
    read = [(t, y) for (t, y), i in once.items() if not tells_known(y, fold_of(i))]
    n1, n0 = (sum(y == k for _, y in read) for k in (1, 0))
    c1, c0 = (sum("vermin" in t for t, y in read if y == k) for k in (1, 0))
    assert abs(model.lexicon["vermin$"] - (math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1)))) < 1e-9


def test_languages_are_learned_from_all_rows(spark):
    """Scripts that only documents beyond the first 600 by hash of their languages show, on the driver and in tasks."""
    from pyspark.sql import functions as F

    from tessera.llm.language import learn

    ids = [i for i in range(3800) if not held(i, 5, 0)]
    by_hash = [r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11)).collect()]
    rng, rows = random.Random(14), []
    scripts = {"de": "αβγδεζηθικλμ", "en": "бвгджзклмнпр"}
    word = lambda lang: "".join(rng.choice(scripts[lang]) for _ in range(6))
    for k, i in enumerate(by_hash):
        lang = ("en", "de")[k % 2]
        rows.append((i, " ".join(word(lang) for _ in range(60)) if k >= len(by_hash) - 300 else prose(rng, EN if lang == "en" else DE, 60), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    texts = {lang: pa.array([prose(rng, EN if lang == "en" else DE, 30)] + [" ".join(word(lang) for _ in range(30)) for _ in range(20)]) for lang in scripts}
    for net in (learn(docs, docs), learn(docs, docs, at_driver=0)):
        assert net.languages == ["de", "en"]
        for lang, own in texts.items():
            assert set(net(own)[0]) == {lang}
