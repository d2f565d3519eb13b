"""Language ID by a byte convolutional network trained in numpy.

A text, lower-cased, is cut into windows of WINDOW bytes (the last is filled with spaces).  Filters of 2, 3 and 4 bytes read
the window at every place as sums of table entries (a convolution over one-hot bytes), each filter keeps its largest value
in the window, and a softmax layer gives log probabilities of the languages.  A document's are the means over its windows.

Training takes all windows of all documents with a language that are not held out, in random order.  Where they are many, a
network of per_class documents of each language is where all tasks begin; each goes on over all of its windows, and the mean of
their networks is where they begin again (local SGD).  Scoring reads all windows of every text.  Inference adds entries for
pairs of bytes at once.

Defined cases: a text that is null or has no letter is `und` with score 0; ids may be null or repeat, each row is scored
alone; of languages that tie in probability the first by name is taken; of training texts that repeat one counts, with the
language of the largest id; without any language to learn every text is `und`; an empty table gives no rows; other columns,
of any names, are kept by keep_known() and not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import by_number, crc_of_id, let_go, materialise, numbered, scope, slices, view, wrapped
from tessera.llm.learn import MOST, adam, sample_texts

WINDOW, FILTERS, WIDTHS = 128, 8, (2, 3, 4)
PER_CLASS, EPOCHS, VISITS = 600, 2, 180_000
AT_DRIVER = VISITS // EPOCHS  # so many windows are learned on the driver
RATES, POOL = (0.003, 0.001), 1 << 16  # a pass over all windows each; a task draws from a pool of 2 * POOL
LEAST_SCORE = 0.5
LETTER = re.compile(r"[^\W\d_]")


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts without nulls, and which text each is of; an empty text has none."""
    data, offsets = view(pc.utf8_lower(texts))
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    out = np.full((len(owner), WINDOW), 32, np.uint8)
    place = np.repeat((np.cumsum(count) - count) * WINDOW, size) + np.arange(len(data)) - np.repeat(offsets[:-1], size)
    out.reshape(-1)[place] = data
    return out, owner


class Net:
    """tables[w][i] holds, for byte i of filters of width w, an entry for each byte value and filter."""

    def __init__(self, languages: list, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.params = {f"t{w}": 0.1 * rng.standard_normal((w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.params["out"] = 0.1 * rng.standard_normal((FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.params["bias"] = np.zeros(len(languages), np.float32)

    def gradient(self, params, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tops, at = [], []
        for w in WIDTHS:
            places = WINDOW - w + 1
            z = sum(params[f"t{w}"][i][x[:, i : i + places]] for i in range(w))
            at.append(z.argmax(1))
            tops.append(np.take_along_axis(z, at[-1][:, None], 1)[:, 0])
        h = np.tanh(np.concatenate(tops, 1))
        logits = h @ params["out"] + params["bias"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ params["out"].T) * (1 - h * h)
        grads = {"out": h.T @ p, "bias": p.sum(0)}
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            g = np.zeros_like(params[f"t{w}"])
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            for i in range(w):
                np.add.at(g[i], (x[rows, at[k] + i], np.arange(FILTERS)[None, :]), own)
            grads[f"t{w}"] = g
        return grads

    def ready(self) -> None:
        """Tables of byte pairs for inference."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, FILTERS)
        t = self.params
        self.fast = {2: (pair(*t["t2"]), None), 3: (pair(*t["t3"][:2]), t["t3"][2]), 4: (pair(*t["t4"][:2]), pair(*t["t4"][2:]))}

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages for each window."""
        if not hasattr(self, "fast"):
            self.ready()
        out = np.empty((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), 256):
            own = x[a : a + 256].astype(np.int32)
            two = own[:, :-1] * 256 + own[:, 1:]
            h = [self.fast[2][0].take(two, 0).max(1)]
            z = self.fast[3][0].take(two[:, :-1], 0)
            z += self.fast[3][1].take(own[:, 2:], 0)
            h.append(z.max(1))
            z = self.fast[4][0].take(two[:, :-2], 0)
            z += self.fast[4][1].take(two[:, 2:], 0)
            h.append(z.max(1))
            logits = np.tanh(np.concatenate(h, 1)) @ self.params["out"] + self.params["bias"]
            logits -= logits.max(1, keepdims=True)
            out[a : a + 256] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out

    def __call__(self, texts: pa.Array) -> tuple[list, np.ndarray]:
        """Languages and scores of texts without nulls."""
        x, owner = windows(texts)
        n, k = len(texts), len(self.languages)
        lettered = np.array([LETTER.search(t) is not None for t in texts.to_pylist()], bool)
        if not k:
            return ["und"] * n, np.zeros(n)
        odds = self.log_odds(x)
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        mean = np.stack([np.bincount(owner, odds[:, j], n) for j in range(k)], 1) / count[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, p.max(1), 0.0)

    def __getstate__(self):
        return {"languages": self.languages, "params": self.params}

    def __setstate__(self, state):
        self.__dict__.update(state)


def train(sample: list[tuple[int, str, object]], languages: list | None = None) -> Net:
    net = Net(sorted({y for _, _, y in sample}) if languages is None else languages)
    xs, ys = [], []
    for text, y in {t: y for _, t, y in sample}.items():
        x, _ = windows(pa.array([text]))
        if len(x):
            xs.append(x)
            ys.append(np.full(len(x), net.languages.index(y)))
    if xs and len(net.languages) > 1:
        x, y = np.concatenate(xs), np.concatenate(ys)
        epochs = max(EPOCHS, min(200, VISITS // len(x)))  # few windows are seen often, many are all seen
        adam(net.params, lambda p, i: net.gradient(p, x[i], y[i]), len(x), epochs, 64, 0.01, 1e-5)
    return net


def _pass(net, rate: float):
    """A task's number of windows, and the network that has gone on over all of them."""

    def run(batches):
        let_go()
        own = net.value
        params = {k: v.copy() for k, v in own.params.items()}
        place = {y: i for i, y in enumerate(own.languages)}
        rng = np.random.default_rng(0)
        n, xs, ys = 0, [], []

        def go_on(most: int | None) -> None:
            """Over windows drawn from the pool, others stay in it."""
            x, y = np.concatenate(xs), np.concatenate(ys)
            order = rng.permutation(len(x))
            now, later = order[:most], order[len(x) if most is None else most :]
            adam(params, lambda p, i: own.gradient(p, x[now[i]], y[now[i]]), len(now), 1, 64, rate, 1e-5)
            xs[:], ys[:] = [x[later]], [y[later]]

        for batch in slices(batches, "text", 4 << 20):
            x, owner = windows(batch.column("text"))
            xs.append(x)
            ys.append(np.array([place[y] for y in batch.column("label").to_pylist()])[owner])
            n += len(x)
            while sum(map(len, xs)) >= 2 * POOL:
                go_on(POOL)
        if n:
            go_on(None)
            whole = np.concatenate([params[k].ravel() for k in sorted(params)])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([whole.astype(np.float32).tobytes()], pa.binary())], names=["n", "params"])

    return run


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, at_driver: int = AT_DRIVER) -> Net:
    """A network from all rows of labels(doc_id, lang) that are not held out, with the whole texts of docs.

    Texts meet their languages once and are written.  Up to at_driver windows reach the driver; of more, per_class documents of
    each language (MOST in all), and then a network a task."""
    spark = docs.sparkSession
    learnable = F.col("doc_id").isNotNull() & (crc_of_id() % 5 != 0)
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label")).where(learnable & F.col("label").isNotNull())
    one = one.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(learnable & F.col("text").rlike("\\p{L}"))
    with scope(spark):
        base = numbered(texts.join(one.hint("shuffle_hash"), "doc_id"), "training")
        once = base.groupBy(F.unhex(F.md5("text")).alias("print")).agg(F.max(F.struct("doc_id", "rid")).alias("own"))
        rows = by_number(base, materialise(once.select("own.rid"), "once"), "inner").select("doc_id", "text", "label")
        if (rows.agg(F.sum(F.ceil(F.octet_length("text") / WINDOW))).first()[0] or 0) <= at_driver:
            return train(sorted(map(tuple, rows.collect()), key=lambda r: (r[0], r[1])))
        sample = sample_texts(rows, rows.select("doc_id", "label"), F.lit(True), per_class)
        net = train(sample, sorted(r.label for r in rows.select("label").distinct().limit(MOST + 1).collect()))  # sample_texts() raises an error for more
        for rate in RATES:
            parts = rows.select("text", "label").mapInArrow(_pass(spark.sparkContext.broadcast(net), rate), "n long, params binary").collect()
            mean = sum(r.n * np.frombuffer(r.params, np.float32).astype(float) for r in parts) / sum(r.n for r in parts)
            for k in sorted(net.params):
                own, mean = mean[: net.params[k].size], mean[net.params[k].size :]
                net.params[k] = own.reshape(net.params[k].shape).astype(np.float32)
    return net


def _apply(net, keep=None):
    def run(batches):
        let_go()
        for batch in slices(batches, "text", 4 << 20):
            names, score = net.value(batch.column("text"))
            rest = batch.remove_column(batch.schema.get_field_index("text"))
            if keep is not None:
                yield rest.filter(pa.array([n != "und" and s >= keep for n, s in zip(names, score, strict=True)], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([rest.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def language(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs."""
    net = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_apply(net), "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE, per_class: int = PER_CLASS) -> DataFrame:
    """docs without those that are `und` or whose score is under least; all columns stay as they are."""
    net = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))
    return wrapped(docs).select(F.col("row.text").cast("string").alias("text"), "row").mapInArrow(_apply(net, least), T.StructType([T.StructField("row", docs.schema)])).select("row.*")
