"""What the trained operators share: bounded samples of labelled rows, and Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 20_000


def sample_texts(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int, most: int = MOST) -> list[tuple[int, str, object]]:
    """(doc_id, text, label) of labelled documents: for each label those whose ids have the smallest hashes.

    Of each label at most per_class are taken, fewer where all labels together would have more than `most`; no label is left
    out (more than `most` labels are an error).  A document with several labels takes the largest.  So many whole texts reach
    the driver.  Ranks are cut in each task first, so a label of a third of all rows is not gathered."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learnable).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = one.groupBy("label").agg(F.count("*").alias("n"))
    kinds = sizes.count()
    if kinds > most:
        raise ValueError(f"{kinds} labels are more than the {most} documents to learn from")
    if not kinds:
        return []
    take = min(per_class, most // kinds)
    one = one.withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    share = F.shiftrightunsigned("h", 11) / float(1 << 53)  # of all hashes, those that are less
    one = one.join(F.broadcast(sizes), "label").where(share * F.col("n") <= 4 * take + 100)  # `most` labels at most
    best = Window.partitionBy("label").orderBy(share, "doc_id")
    chosen = one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= take).select("doc_id", "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").collect()  # `most` ids at most
    return sorted(((r.doc_id, r.text or "", r.label) for r in rows), key=lambda r: (r[0], r[1]))


def adam(params: dict[str, np.ndarray], gradient: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], rows: int, epochs: int, batch: int, rate: float, decay: float = 0.0, seed: int = 0) -> None:
    """Trains params in place; gradient(params, row numbers) gives what to descend along."""
    rng, step = np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    total = max(1, epochs * -(-rows // batch))
    for _ in range(epochs):
        order = rng.permutation(rows)
        for a in range(0, rows, batch):
            step += 1
            pace = rate * 0.5 * (1 + np.cos(np.pi * step / total))
            for k, g in gradient(params, order[a : a + batch]).items():
                g = g + decay * params[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, prior: float = 0.5, decay: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the bias.  Class 1 counts for prior of all."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sizes = np.array([(y == k).sum() for k in (0, 1)])
    return newton(lambda w: newton_sums(x, y, w, prior, sizes), x.shape[1], decay, rounds)


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second and first derivatives of some rows; sizes: how many rows there are of class 0 and of class 1 in all."""
    share = np.where(y == 1, prior / max(1, sizes[1]), (1 - prior) / max(1, sizes[0]))
    p = sigmoid(x @ w)
    return (x * (share * p * (1 - p))[:, None]).T @ x, x.T @ (share * (p - y))


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, decay: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights by steps over sums of all rows."""
    ridge = decay * np.eye(n)
    ridge[-1, -1] = 1e-6
    w = np.zeros(n)
    for _ in range(rounds):
        second, first = sums(w)
        step = np.linalg.solve(second + ridge, first + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
