"""Toxicity by noisy-channel deobfuscation.

A word that may be disguised (digits or marks for letters, marks between letters, letters repeated, letters spaced out)
becomes a lattice: each place may be read as itself or as the letters it stands for, marks inside may vanish, and runs may
shrink, each at a price.  Viterbi over the lattice, with all its states, finds the reading with the best price under a
character trigram model of the training words, of any alphabet.  Marks of EDGE around a word are left out, but those that
stand for letters are also read as letters: where the word without them is not one of clean training documents, the reading
that hits the lexicon hardest counts.  Letters doubled once shrink only in words that clean training documents lack.
Restored words are then scored: a lexicon of words and word beginnings (4 to 6 letters) with their log odds between toxic and
clean documents, and a logistic regression on how many words of a document hit it and how hard.

Training takes all labelled documents that are not held out.  The letters are counted in every one of them; else documents of
one label with the same words in the same order count once, as what stands in many copies of one text is no evidence.  A third
of the clean ones tell which words are known; of the rest the lexicon is learned on one half and the regression on the other,
then the lexicon on both.  Scoring reads every word of every text; a worker keeps what it knows of distinct words.

Defined cases: null or empty text has no hit and gets the lowest score; without labels of both kinds every score is 0; ids may
be null or repeat, each row is scored alone; of readings that tie in price the first in the order of LEET counts; a score of
exactly 0.5 predicts 1; an empty table gives no rows; other columns, of any names, are kept by keep_clean() and not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BLANK, by_number, crc_of_id, held, let_go, materialise, numbered, scope, slices, strings, view, width, wrapped
from tessera.llm.learn import logistic, newton, newton_sums, sigmoid

PREFIXES = (4, 5, 6)
LEAST_DOCS, TOXIC_SHARE, LEAST_ODDS = 4, 1000, 2.0  # a feature stands in 4 toxic documents, and in one of 1000
LEAST_KNOWN, KNOWN_SHARE = 2, 50_000  # a known word stands in 2 clean documents, and in one of 50000
PRIOR = 0.2  # weight of toxic documents in the regression: clean ones should stay
#: What marks and digits stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
DROPPED = set(".-_*~'`^:/\\,#\"")
EDGE = ".,;:!?'\"()[]{}<>%&#*-_~`^=/\\|+$"
SUSPECT = re.compile(r"[^\W\d_][\d@$!|+(€.\-_*~'`^:/\\,#\"]+[^\W\d_]|^[\d@$|+(€]+[^\W\d_]|[^\W\d_][\d@€]+$|([^\W\d_])\1\1")
DOUBLED = re.compile(r"([^\W\d_])\1")
DOUBLED_RUN = re.compile(r"([^\W\d_])\1+")
TRIPLED = re.compile(r"([^\W\d_])\1\1")
SIGNS = set(EDGE) & set(LEET)  # at an edge: punctuation or letters
PLAIN_EDGE = "".join(set(EDGE) - SIGNS)
_LEETING, _DROPPING, _SHRINKING, _STAYING = 1.0, 0.7, 0.6, 6.0


class Model:
    """The channel, the character model, the lexicon and the regression; small enough to broadcast."""

    def __init__(self) -> None:
        self.after: dict[str, dict[str, float]] = {}  # how often a letter follows one or two others; "" is a word's edge
        self.sums: dict[str, float] = {}
        self.one: dict[str, float] = {}
        self.prices: dict[tuple[str, str, str], float] = {}
        self.lexicon: dict[str, float] = {}
        self.clean: set[str] = set()  # words of clean training documents, as they are written
        self.weights: np.ndarray | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "bound"} | {"prices": {}}

    # --- character model

    def learn_letters(self, counts: dict[str, int]) -> None:
        """From what count_letters() counts."""
        two: dict[str, float] = {}
        three = {key: n / (1 << 20) for key, n in sorted(counts.items())}
        for key, n in three.items():
            two[key[1:]] = two.get(key[1:], 0.0) + n
        after: dict[str, dict[str, float]] = {}
        for table in (three, two):
            for key, n in table.items():
                after.setdefault(key[:-1], {})[key[-1]] = n
        self.after = after
        self.sums = {k: sum(v.values()) for k, v in after.items()}
        one = Counter()
        for before, v in after.items():
            if len(before) == 1:
                one.update(v)
        self.one = {"": sum(one.values()) + 0.5 * (len(one) + 1), **one}

    def price(self, a: str, b: str, c: str) -> float:
        """What the letter c costs after a and b: trigrams, smoothed by bigrams and those by letters."""
        if (known := self.prices.get((a, b, c))) is None:
            if len(self.prices) > 1_000_000:
                self.prices.clear()
            p = (self.one.get(c, 0.0) + 0.5) / self.one[""]
            p = (self.after.get(b, {}).get(c, 0.0) + 20 * p) / (self.sums.get(b, 0.0) + 20)
            p = (self.after.get(a + b, {}).get(c, 0.0) + 10 * p) / (self.sums.get(a + b, 0.0) + 10)
            known = self.prices[a, b, c] = -float(np.log(p))
        return known

    def lattice(self, word: str, lead: int = 0, tail: int = 0):
        """For each place or run of one sign: what it may be read as, and the price of the channel."""
        i = 0
        while i < len(word):
            c = word[i]
            run = i + 1
            while run < len(word) and word[run] == c and run not in (lead, len(word) - tail):
                run += 1
            long = run - i
            if c.isalpha():
                ways = [(c * k, _SHRINKING * (k != long)) for k in sorted({1, min(2, long), long})]
            else:
                ways = [(x * k, _LEETING * long) for x in LEET.get(c, "") for k in sorted({1, min(2, long)})]
                if lead <= i < len(word) - tail:
                    if c in DROPPED or c in LEET:
                        ways.append(("", _DROPPING * long + (5.0 if c.isdigit() else 2.5 if c in LEET else 0.0)))
                    ways.append((c * long, _STAYING))
            yield ways
            i = run

    def restore(self, word: str, lead: int = 0, tail: int = 0) -> str:
        """The reading of a lower-case word with the least cost: of the channel plus of the letters.

        The first lead and the last tail places are signs that must be read as letters."""
        states: dict[tuple[str, str], tuple[float, tuple]] = {("\0", "\0"): (0.0, ())}
        price = self.price
        for ways in self.lattice(word, lead, tail):
            after: dict[tuple[str, str], tuple[float, tuple]] = {}
            for (a, b), (paid, path) in states.items():
                for out, toll in ways:
                    x, y, cost = a, b, paid + toll
                    for letter in out:
                        cost += price(x, y, letter)
                        x, y = y, letter
                    if (x, y) not in after or cost < after[x, y][0]:
                        after[x, y] = (cost, (path, out) if out else path)
            states = after
        path = min(((paid + price(a, b, "\0"), i, path) for i, ((a, b), (paid, path)) in enumerate(states.items())))[2]
        parts = []
        while path:
            path, out = path
            parts.append(out)
        return "".join(reversed(parts))

    # --- lexicon and score

    def plain(self, word: str) -> str:
        """A word without marks around it, restored where it may be disguised."""
        return self.restore(word) if SUSPECT.search(word) or (word not in self.clean and DOUBLED.search(word)) else word

    def word(self, raw: str) -> str:
        """A word of a text as the lexicon sees it."""
        low = raw.lower()
        core = low.strip(PLAIN_EDGE)
        if core.isalpha():  # most words: nothing but a repeated letter can hide in them
            return self.restore(core) if DOUBLED.search(core) and (core not in self.clean or TRIPLED.search(core)) else core
        core = low.strip(EDGE)
        at = low.find(core)
        lead, tail = ("".join(c for c in part if c in SIGNS) for part in ((low[:at], low[at + len(core) :]) if core else (low, "")))
        if not (lead or tail) or not (len(lead + tail) > 1 or any(map(str.isalpha, core))):
            return self.plain(core)
        bare = self.plain(core)
        if bare in self.clean and "$" not in lead + tail:
            return bare
        ways = sorted({(a, b) for a in (lead, "") for b in (tail, "") if a or b}, key=lambda w: (len(w[0] + w[1]), w))
        read = [self.restore(a + core + b, len(a), len(b)) for a, b in ways]
        # the lattice shrinks runs and takes one letter of two: also each sign as its first and as its last letter
        as_is = [tuple("".join(LEET[c][x] for c in part) for part in way) for way in ways for x in (0, -1)]
        read += [a + bare + b for a, b in as_is]
        # a dollar is hardly punctuation: without a hit it is read as a letter, other signs are not
        read = [*read, bare] if "$" in lead + tail else [bare, *read]
        return max(read, key=self.hit)

    def hit(self, word: str) -> float:
        """The hardest hit of a word's features."""
        if len(word) < 3:
            return 0.0
        odds = self.lexicon.get
        best = odds(word + "$", 0.0)
        for k in PREFIXES:
            if len(word) < k:
                break
            best = max(best, odds(word[:k], 0.0))
        return best

    def value(self, raw: str) -> float:
        """The hardest hit of a word of a text.  Repeated letters and signs behind a word are only restored where some reading
        could hit: all readings are the same word once runs are one letter, but for letters that signs add at its end."""
        low = raw.lower()
        core = low.strip(PLAIN_EDGE)
        bare = core if core.isalpha() else core.rstrip(EDGE)
        if bare.isalpha() and core.startswith(bare) and (core != bare or DOUBLED.search(bare)):
            if not hasattr(self, "bound"):
                whole = {squeezed(f) for f in self.lexicon}
                self.bound = whole, {f[:k] for f in whole for k in range(1, len(f))}
            whole, begun = self.bound
            once = squeezed(bare)
            if not (once + "$" in whole or any(once[:k] in whole for k in range(1, PREFIXES[-1] + 1)) or (core != bare and once in begun)):
                return 0.0
        return self.hit(self.word(raw))

    def spaced(self, letters: str) -> float:
        """The hardest hit of letters that stood alone, at any place of them."""
        whole = self.plain(letters.lower()) if letters.isalpha() else self.restore(letters.lower())
        longest = max(map(len, self.lexicon), default=0)  # no entry reaches further
        return max((self.hit(whole[i : i + longest]) for i in range(max(1, len(whole) - 3))), default=0.0)

    def score(self, hits: np.ndarray, total: np.ndarray, top: np.ndarray, words: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(hits))
        return sigmoid(inputs(hits, total, top, words) @ self.weights[:-1] + self.weights[-1])


def squeezed(word: str) -> str:
    """A word with each run as one letter."""
    return DOUBLED_RUN.sub(r"\1", word)


def features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)] if len(word) > 2 else []


def inputs(hits, total, top, words) -> np.ndarray:
    return np.stack([np.log1p(hits), np.log1p(total), top, np.log((hits + 0.05) / (words + 5.0))], 1)


def fold_of(doc_id) -> int:
    """One of six parts of the training documents."""
    return zlib.crc32(f"{doc_id}t".encode()) % 6


def tells_known(label, fold) -> bool:
    """Whether a document tells which words are known: two sixths of the clean ones.  How a word is read depends on whether
    clean documents have it, so these are not counted again: their own words would be read in another way than those of toxic
    documents."""
    return (label == 0) & (fold < 2)


def print_of(text: str) -> bytes:
    """128 bits of a text's words and their order; two texts share one by a chance of 2**-128."""
    return xxhash.xxh3_128_digest(" ".join(text.lower().split()).encode())


def count_words(text: str, known: bool, counts: Counter, docs: Counter) -> None:
    """Adds how often a text has its words of letters, and those words once if it tells which are known."""
    low = text.lower().split()
    counts.update(w for x in low if (w := x.strip(EDGE)).isalpha())
    if known:
        docs.update({w for x in low if (w := x.strip(PLAIN_EDGE)).isalpha()})


def count_letters(words: Iterable[tuple[str, int]], counts: Counter) -> None:
    """Adds the trigrams of words that occur n times, in units of 2**-20 so that sums do not depend on their order."""
    for w, n in words:
        weight = round((1 + math.log(n)) * (1 << 20))
        padded = f"\0\0{w}\0"
        for i in range(len(w) + 1):
            counts[padded[i : i + 3]] += weight


def least_known(n: int) -> int:
    """In so many of n documents that tell which words are known a word stands at least."""
    return max(LEAST_KNOWN, -(-n // KNOWN_SHARE))


def least_toxic(n: int) -> int:
    return max(LEAST_DOCS, -(-n // TOXIC_SHARE))


def lexicon(counts: dict[str, np.ndarray], sizes: np.ndarray, cells: list[int]) -> dict[str, float]:
    """Log odds of features by the documents that have them; cells 2 * half + label of counts and of sizes."""
    clean, toxic = ([c for c in cells if c % 2 == y] for y in (0, 1))
    n0, n1 = sizes[clean].sum(), sizes[toxic].sum()
    out = {}
    for f, n in counts.items():
        if (c := n[toxic].sum()) >= least_toxic(n1):
            w = math.log((c + 0.5) / (n1 + 1)) - math.log((n[clean].sum() + 0.5) / (n0 + 1))
            if w >= LEAST_ODDS:
                out[f] = w
    return out


def steps(sizes: np.ndarray) -> tuple[list[int], list[int]] | None:
    """The cells that the lexicon and then the regression learn from: halves that have both labels, else all; None without."""
    if not sizes[[0, 2]].sum() or not sizes[[1, 3]].sum():
        return None
    return ([0, 1], [2, 3]) if sizes.all() else ([0, 1, 2, 3], [0, 1, 2, 3])


class Reader:
    """Features of a text; words that have been read are kept for later ones."""

    def __init__(self, model: Model, capacity: int = 200_000) -> None:
        self.model, self.capacity, self.known = model, capacity, {}

    def __call__(self, text: str) -> set[str]:
        if len(self.known) > self.capacity:
            self.known.clear()
        found: set[str] = set()
        for x in set(text.split()):
            if (own := self.known.get(x)) is None:
                own = self.known[x] = features(self.model.word(x))
            found.update(own)
        return found


def train(sample: list[tuple[int, str, object]]) -> Model:
    """What learn() makes of tables, of a few rows at hand."""
    model = Model()
    rows = [(t, int(y), fold_of(i)) for i, t, y in sorted(sample, key=lambda r: r[0])]
    first: dict[tuple[bytes, int], tuple[str, int, int]] = {}
    for r in rows:
        first.setdefault((print_of(r[0]), r[1]), r)
    counts, docs, letters = Counter(), Counter(), Counter()
    for r in rows:
        count_words(r[0], tells_known(*r[1:]) and first[print_of(r[0]), r[1]] is r, counts, docs)
    count_letters(counts.items(), letters)
    model.learn_letters(letters)
    rows = list(first.values())
    least = least_known(sum(tells_known(y, k) for _, y, k in rows))
    model.clean = {w for w, n in docs.items() if n >= least}
    rows = [(t, y, 2 * (k % 2) + y) for t, y, k in rows if not tells_known(y, k)]
    sizes = np.bincount([c for *_, c in rows], minlength=4)
    if not (chosen := steps(sizes)):
        return model
    reader, seen = Reader(model), {}
    for t, _, c in rows:
        for f in reader(t):
            seen.setdefault(f, np.zeros(4, np.int64))[c] += 1
    model.lexicon = lexicon(seen, sizes, chosen[0])
    part = [r for r in rows if r[2] in chosen[1]]
    x, y = inputs(*Scorer(model).stats(pa.array([t for t, *_ in part]))), np.array([y for _, y, _ in part])
    model.__dict__.pop("bound", None)  # that of this lexicon
    model.weights = logistic(x, y, PRIOR)
    model.lexicon = lexicon(seen, sizes, [0, 1, 2, 3])
    return model


ALONE = np.zeros(256, bool)
ALONE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"@$!|+("]] = True


class Scorer:
    """Hits of whole texts; what is known of distinct words stays for later batches."""

    def __init__(self, model: Model, capacity: int = 200_000) -> None:
        self.model, self.capacity, self.known = model, capacity, {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return self.model.score(*self.stats(texts))

    def stats(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text how many words hit, how hard in all and at most, and how many words it has."""
        data, offsets = view(texts)
        n = len(texts)
        hits, total, top, words = (np.zeros(n) for _ in range(4))
        inner = ~BLANK[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        begin = inner.copy()
        begin[1:] &= ~inner[:-1] | first[1:-1]
        a = np.flatnonzero(begin)
        if len(a):
            packed = np.concatenate([[0], np.cumsum(inner)])
            edges = np.append(packed[a], packed[-1])
            size = np.diff(edges)
            owner = np.searchsorted(offsets, a, side="right") - 1
            kinds = strings(data[inner], edges).dictionary_encode()
            names = kinds.dictionary.to_pylist()
            if len(self.known) > self.capacity:
                self.known.clear()
            known = self.known
            for w in names:
                if w not in known:
                    known[w] = self.model.value(w)
            value = np.fromiter(map(known.__getitem__, names), float, len(names))[kinds.indices.to_numpy(zero_copy_only=False)]
            hot = np.flatnonzero(value)
            words = np.bincount(owner, minlength=n).astype(float)
            np.add.at(hits, owner[hot], 1)
            np.add.at(total, owner[hot], value[hot])
            np.maximum.at(top, owner[hot], value[hot])
            single = (size == 1) & ALONE[data[a]]
            step = np.diff(np.concatenate([[False], single, [False]]).astype(np.int8))
            for x, y in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
                cut = [x, *(np.flatnonzero(np.diff(owner[x:y])) + x + 1).tolist(), y]
                for p, q in zip(cut[:-1], cut[1:], strict=True):
                    if q - p >= 3 and (h := self.model.spaced(data[a[p:q]].tobytes().decode("ascii"))) > 0:
                        hits[owner[p]] += 1
                        total[owner[p]] += h
                        top[owner[p]] = max(top[owner[p]], h)
        return hits, total, top, words


def _scorer(shared) -> Scorer:
    return held(("toxicity", shared.id), lambda: Scorer(shared.value))


class _Shared:
    """A broadcast with a number that tells a worker which model it holds."""

    def __init__(self, spark, value) -> None:
        self.held = spark.sparkContext.broadcast(value)
        self.id = self.held._jbroadcast.id()

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


def _score(shared: _Shared):
    def run(batches):
        scorer = _scorer(shared)
        for batch in slices(batches, "text", 4 << 20):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "score", pa.array(scorer(batch.column("text"))))

    return run


AT_ONCE = 200_000  # counts that a task holds before it sends them


def _prints(batches):
    let_go()
    for batch in slices(batches, "text", 2 << 20):
        prints = pa.array(map(print_of, batch.column("text").to_pylist()), pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "rid", "label")), prints], names=["doc_id", "rid", "label", "print"])


def _words(batches):
    counts, docs = Counter(), Counter()

    def sums():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([docs[w] for w in counts], pa.int64())], names=["word", "n", "docs"])

    for batch in slices(batches, "text", 2 << 20):
        for text, known in zip(*(batch.column(c).to_pylist() for c in ("text", "known")), strict=True):
            count_words(text, known, counts, docs)
            if len(counts) > AT_ONCE:
                yield sums()
                counts, docs = Counter(), Counter()
    if counts:
        yield sums()


def _letters(batches):
    counts = Counter()
    for batch in batches:
        count_letters(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True), counts)
        if len(counts) > AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])
            counts = Counter()
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])


def _features(shared: _Shared):
    def run(batches):
        reader = held(("toxic words", shared.id), lambda: Reader(shared.value))
        counts: Counter = Counter()

        def sums():
            names, cells = zip(*counts, strict=True)
            n = np.zeros((4, len(counts)), np.int64)
            n[np.array(cells), np.arange(len(counts))] = list(counts.values())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *map(pa.array, n)], names=["feature", "c0", "c1", "c2", "c3"])

        for batch in slices(batches, "text", 2 << 20):
            for text, cell in zip(batch.column("text").to_pylist(), batch.column("cell").to_pylist(), strict=True):
                counts.update((f, cell) for f in reader(text))
                if len(counts) > AT_ONCE:
                    yield sums()
                    counts = Counter()
        if counts:
            yield sums()

    return run


def _stats(shared: _Shared):
    def run(batches):
        scorer = _scorer(shared)
        for batch in slices(batches, "text", 4 << 20):
            x = inputs(*scorer.stats(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in x.T), batch.column("label")], names=["x0", "x1", "x2", "x3", "label"])

    return run


def _fitted(rows: DataFrame, sizes: np.ndarray) -> np.ndarray:
    """logistic() over rows(x0 .. x3, label): each step sums over all rows where they are, a row a task reaches the driver."""
    rows = rows.repartition(width(rows.sparkSession))

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            h, g = np.zeros((5, 5)), np.zeros(5)
            for batch in batches:
                x = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
                a, b = newton_sums(np.hstack([x, np.ones((len(x), 1))]), batch.column("label").to_numpy(), w, PRIOR, sizes)
                h, g = h + a, g + b
            yield pa.RecordBatch.from_arrays([pa.array([np.append(h.ravel(), g).tolist()], pa.list_(pa.float64()))], names=["sums"])

        total = np.sum([r.sums for r in rows.mapInArrow(run, "sums array<double>").collect()], 0)  # 30 numbers a task
        return total[:25].reshape(5, 5), total[25:]

    return newton(sums, 5)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all rows of labels(doc_id, toxic) that are not held out, whole texts.

    Texts meet their labels once and are written; all counts and sums are made where they lie.  The driver gets the trigrams of
    letters, the known words and the features of toxic documents that the thresholds leave."""
    spark = docs.sparkSession
    learnable = F.col("doc_id").isNotNull() & (crc_of_id() % 5 != 0)
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(learnable & F.col("label").isin(0, 1))
    one = one.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(learnable)
    fold = (F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("t")).cast("binary")) % 6).cast("int")
    with scope(spark):
        base = numbered(texts.join(one.hint("shuffle_hash"), "doc_id").withColumn("fold", fold), "training")
        prints = base.select("doc_id", "rid", "label", "text").mapInArrow(_prints, "doc_id long, rid long, label int, print binary")
        first = materialise(prints.groupBy("print", "label").agg(F.min(F.struct("doc_id", "rid")).alias("own")).select("own.rid", F.lit(True).alias("once")), "once")
        once = F.coalesce(F.col("once"), F.lit(False))
        known = tells_known(F.col("label"), F.col("fold"))
        every = by_number(base, first, "left").select("label", "text", once.alias("once"), (once & known).alias("known"), (F.col("fold") % 2 * 2 + F.col("label")).alias("cell"))
        rows = every.where("once")
        n = {(r.known, r.cell): r["count"] for r in rows.groupBy("known", "cell").count().collect()}  # a row a cell
        model = Model()
        words = every.select("text", "known").mapInArrow(_words, "word string, n long, docs long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        words = materialise(words, "words")
        letters = words.select("word", "n").mapInArrow(_letters, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        model.learn_letters(dict(zip(letters.column("key").to_pylist(), letters.column("n").to_pylist(), strict=True)))
        least = least_known(sum(v for (k, _), v in n.items() if k))
        model.clean = set(words.where(F.col("docs") >= least).select("word").toArrow().column("word").to_pylist())
        sizes = np.array([n.get((False, c), 0) for c in range(4)])
        if not (chosen := steps(sizes)):
            return model
        counted = rows.where("not known").select("text", "cell").mapInArrow(_features(_Shared(spark, model)), "feature string, c0 long, c1 long, c2 long, c3 long")
        counted = counted.groupBy("feature").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(4)))
        least = least_toxic(sizes[[c for c in chosen[0] if c % 2]].sum())  # all toxic documents ask for as many or more
        found = counted.where(F.col("c1") + F.col("c3") >= int(least)).toArrow().to_pydict()
        seen = {f: np.array(c) for f, *c in zip(*(found[c] for c in ("feature", "c0", "c1", "c2", "c3")), strict=True)}
        model.lexicon = lexicon(seen, sizes, chosen[0])
        x = rows.where(~F.col("known") & F.col("cell").isin(chosen[1])).select("text", "label").mapInArrow(_stats(_Shared(spark, model)), "x0 double, x1 double, x2 double, x3 double, label int")
        by_label = np.array([sizes[[c for c in chosen[1] if c % 2 == y]].sum() for y in (0, 1)])
        model.weights = _fitted(materialise(x, "inputs"), by_label)
        model.lexicon = lexicon(seen, sizes, [0, 1, 2, 3])
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs."""
    shared = _Shared(docs.sparkSession, learn(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _filter(shared: _Shared):
    def run(batches):
        scorer = _scorer(shared)
        for batch in slices(batches, "text", 4 << 20):
            yield batch.select(["row"]).filter(pa.array(scorer(batch.column("text")) < 0.5))

    return run


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose score is 0.5 or more; all columns stay as they are."""
    shared = _Shared(docs.sparkSession, learn(docs, labels))
    rows = wrapped(docs).select(F.col("row.text").cast("string").alias("text"), "row")
    return rows.mapInArrow(_filter(shared), T.StructType([T.StructField("row", docs.schema)])).select("row.*")
