import random
import re
from collections import defaultdict

from tessera.llm.line_dedup import DEPTH, MIN_DOCS, SHARE, line_dedup

from .conftest import ODD


def brute(texts):
    mask = lambda line: tuple("<*>" if re.search("[0-9]", t) else t for t in line.split(" "))
    docs = [[(line, mask(line)) for line in (t or "").split("\n")] for t in texts]
    of = defaultdict(set)  # the documents of each masked line
    for i, d in enumerate(docs):
        for line, m in d:
            if line:
                of[m].add(i)
    leaves = defaultdict(list)
    for m in of:
        leaves[len(m), m[:DEPTH]].append(m)
    gone = {m for m, rows in of.items() if len(rows) >= MIN_DOCS}
    for lines in leaves.values():
        if len(set().union(*(of[m] for m in lines))) < MIN_DOCS:
            continue
        votes = defaultdict(int)
        for m in lines:
            for at, token in enumerate(m[DEPTH:]):
                votes[at, token] += len(of[m]) * (token != "<*>")
        level = {key: (n // MIN_DOCS).bit_length() for key, n in votes.items()}
        groups = defaultdict(set)
        for m in lines:
            for least in {level[key] for key in enumerate(m[DEPTH:])} - {0}:
                kept = tuple(key for key in enumerate(m[DEPTH:]) if level[key] >= least)
                if len(kept) >= SHARE * len(m[DEPTH:]):
                    groups[kept].add(m)
        for like in groups.values():
            if len(set().union(*(of[m] for m in like))) >= MIN_DOCS:
                gone |= like
    return [("\n".join(x for x, m in d if not x or m not in gone), len(d), sum(x != "" and m in gone for x, m in d)) for d in docs]


def test_against_brute_force(docs):
    boiler = [f"Posted by {name} on day {i} of the month" for i, name in enumerate("ann bob cid dan eve fay gus".split())]
    texts = ODD + [f"{b}\nown line number {'x' * i} here\nAll rights reserved 20{i}\n\nshort one" for i, b in enumerate(boiler)]
    texts += ["Posted by nobody whatsoever", "a b c\n" * 9, "the same twice\nthe same twice"] + [f"u{i} v{i}a w x{'y' * i}" for i in range(9)] + ["hot line of all " + "z"] * 40
    rows = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs(texts, extra=("pos", "leaf", "rid"))).collect()}
    want = brute(texts)
    assert rows == dict(enumerate(want))
    assert sum(w[2] for w in want) > 50


def test_templates_that_share_a_leaf_with_each_other_and_with_prose(docs):
    """However many other lines a leaf holds, and whichever names the variable fields take."""
    rng = random.Random(1)
    names = ["n" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    lines = [f"This article was written by {n} for the Herald" for n in names[:60]] + [f"This article was edited by {n} at the Tribune" for n in names[60:90]]
    lines += ["This article was " + " ".join(rng.choice(names) for _ in range(6)) for _ in range(200)]
    rng.shuffle(lines)
    rows = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs([f"{x}\n{'o' * (i + 1)}wn" for i, x in enumerate(lines)])).collect()}
    assert all(("Herald" in x or "Tribune" in x) == (rows[i][2] == 1) for i, x in enumerate(lines))
    assert rows == dict(enumerate(brute([f"{x}\n{'o' * (i + 1)}wn" for i, x in enumerate(lines)])))


def test_lists_inside_one_document_stay(docs):
    cities = ["Paris", "Madrid", "Rome", "Bern", "Oslo", "Riga"]
    text = "\n".join(f"The capital of our good neighbour {c} is always well worth a visit" for c in cities)
    rows = line_dedup(docs([text, "other", text.replace("Paris", "Wien")[:70]])).collect()
    assert all(r.n_dropped == 0 for r in rows)


def test_rows_dealt_anew(docs):
    texts = [f"the same old line in all of them\n{'x' * (i + 1)}" for i in range(300)]
    rows = line_dedup(docs(texts).repartition(7)).collect()
    want = brute(texts)
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in rows} == dict(enumerate(want))
    assert all(w[2] == 1 for w in want)


def test_rows_with_null_or_repeated_ids_and_empty(docs):
    assert line_dedup(docs([])).count() == 0
    rows = line_dedup(docs(["one two three\n\n"] * 6 + [None], ids=[1, 1, None, None, 2, 3, 4])).collect()
    assert len(rows) == 7 and sorted(r.text for r in rows) == [""] + ["\n"] * 6


def test_main_path_is_native(docs):
    plan = line_dedup(docs(["a b c"] * 5))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
