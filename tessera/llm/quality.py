"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes.  Each passage is encoded from measures of its bytes and words: shares of
kinds of bytes, of repeated and distinct words, lengths, and hashed counts of byte pairs.  A hidden layer encodes them, a
gated attention (tanh times sigmoid) weighs the passages, and the weighted sum of their codes is scored.  All of it is trained
in numpy from labels of documents alone.

Training takes at most per_class documents of each label by hash of id, every passage of each; scoring reads every passage of
every text.  A text of any length is one bag.

Defined cases: null or empty text is one empty passage; without labels of both kinds every score is 0.5; ids may be null or
repeat, each row is scored alone, and of rows with one text each has its score; of training texts that repeat one counts, with
the label of the largest id; a score of exactly 0.5 predicts 1; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_of_id, slices, view
from tessera.llm.learn import adam, sample_texts, sigmoid
from tessera.llm.shingles import word_hashes

PASSAGE, PAIRS = 512, 64
PER_CLASS, EPOCHS, HIDDEN, GATE = 1500, 40, 16, 8
KIND = np.full(256, 6, np.int64)  # other marks
for _k, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", range(128, 256)]):
    KIND[list(_bytes)] = _k
for _k, _bytes in enumerate([b".,;:'\"-()?", b"!", b"#$%&*", b"|", b"<>=/\\{}[]_@+^~`"]):
    KIND[list(_bytes)] = 7 + _k
KINDS = 12


def measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One row of measures for each passage of texts without nulls, and which text each is of."""
    data, offsets = view(texts)
    size = np.diff(offsets)
    count = np.maximum(-(-size // PASSAGE), 1)
    first = np.cumsum(count) - count
    n = int(count.sum())
    owner = np.repeat(np.arange(len(size)), count)
    place = np.repeat(first, size) + (np.arange(len(data)) - np.repeat(offsets[:-1], size)) // PASSAGE
    kind = KIND[data]
    kinds = np.bincount(place * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    total = kinds.sum(1, keepdims=True)
    pair = np.zeros((n, PAIRS))
    if len(data) > 1:
        bucket = (data[:-1].astype(np.uint32) * 31 + data[1:].astype(np.uint32) * 17) % PAIRS
        inside = np.ones(len(data), bool)
        inside[offsets[1:][np.diff(offsets) > 0] - 1] = False  # a text's last byte has no next one
        pair = np.bincount((place[:-1] * PAIRS + bucket)[inside[:-1]], minlength=n * PAIRS).reshape(n, PAIRS).astype(float)
    words, at = word_hashes(texts)
    per = np.diff(at)
    text_of = np.repeat(np.arange(len(per)), per)
    # the i-th of a text's words counts for the passage at the same share of the text
    inside = np.arange(len(words)) - np.repeat(at[:-1], per)
    spot = first[text_of] + inside * count[text_of] // np.maximum(per[text_of], 1)
    number = np.bincount(spot, minlength=n).astype(float)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text_of[1:] == text_of[:-1])
    key = np.sort((spot.astype(np.uint64) << np.uint64(40)) ^ (words >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    some = np.maximum(total, 1)
    rest = [np.bincount(spot, again, n) / np.maximum(number, 1), distinct / np.maximum(number, 1), np.log1p(number), np.log1p(total[:, 0]), total[:, 0] / np.maximum(number, 1) / 10]
    return np.hstack([kinds / some, np.sqrt(pair / some), np.stack(rest, 1)]), owner


class Bags:
    """The trained model: scaling of measures, encoder, gate and scorer."""

    def __init__(self, width: int, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        scale = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        self.params = {"e": scale(width, HIDDEN), "eb": np.zeros(HIDDEN), "v": scale(HIDDEN, GATE), "u": scale(HIDDEN, GATE), "a": scale(GATE), "w": scale(HIDDEN), "b": np.zeros(1)}
        self.shift, self.scale, self.trained = np.zeros(width), np.ones(width), False

    def encode(self, x: np.ndarray, p=None):
        p = p or self.params
        code = np.tanh(np.clip((x - self.shift) / self.scale, -6, 6) @ p["e"] + p["eb"])
        v, u = np.tanh(code @ p["v"]), sigmoid(code @ p["u"])
        return code, v, u, (v * u) @ p["a"]

    def gradient(self, p, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """bag: which of the documents y each passage x is of, ascending; every document has a passage."""
        code, v, u, s = self.encode(x, p)
        start = np.flatnonzero(np.diff(bag, prepend=-1))
        e = np.exp(s - np.maximum.reduceat(s, start)[bag])
        alpha = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(alpha[:, None] * code, start)
        out = (sigmoid(z @ p["w"] + p["b"]) - y) / len(y)
        dz = out[:, None] * p["w"]
        dot = (dz[bag] * code).sum(1)
        ds = alpha * (dot - np.add.reduceat(alpha * dot, start)[bag])
        dv, du = ds[:, None] * p["a"] * u * (1 - v * v), ds[:, None] * p["a"] * v * u * (1 - u)
        dcode = alpha[:, None] * dz[bag] + dv @ p["v"].T + du @ p["u"].T
        pre = dcode * (1 - code * code)
        xs = np.clip((x - self.shift) / self.scale, -6, 6)
        return {"e": xs.T @ pre, "eb": pre.sum(0), "v": code.T @ dv, "u": code.T @ du, "a": (v * u).T @ ds, "w": z.T @ out, "b": out.sum(keepdims=True)}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        if not self.trained:
            return np.full(n, 0.5)
        x, owner = measures(texts)
        code, _, _, s = self.encode(x)
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        e = np.exp(s - np.maximum.reduceat(s, start)[owner])
        z = np.add.reduceat(e[:, None] * code, start) / np.add.reduceat(e, start)[:, None]
        return sigmoid(z @ self.params["w"] + self.params["b"])


def train(sample: list[tuple[int, str, object]]) -> Bags:
    once = list({t: int(y) for _, t, y in sample}.items())
    model = Bags(KINDS + PAIRS + 5)
    if len({y for _, y in once}) < 2:
        return model
    bags = []
    for text, _ in once:
        bags.append(measures(pa.array([text]))[0])
    every = np.concatenate(bags)
    model.shift, model.scale = every.mean(0), every.std(0) + 0.02
    y = np.array([y for _, y in once], float)

    def gradient(p, rows):
        return model.gradient(p, np.concatenate([bags[i] for i in rows]), np.repeat(np.arange(len(rows)), [len(bags[i]) for i in rows]), y[rows])

    adam(model.params, gradient, len(bags), max(EPOCHS, min(300, 40_000 // len(bags))), 64, 0.01, 1e-4)
    model.trained = True
    return model


def _score(model):
    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value(batch.column("text")))], names=["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(train(sample_texts(docs, rows, crc_of_id() % 3 != 1, per_class)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
