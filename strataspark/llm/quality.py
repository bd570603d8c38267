"""Quality classifier: Naive Bayes support vectors.

A text becomes the set of its hashed byte n-grams (indicators). Over all
labelled training rows each n-gram gets a class log-count ratio; the ratios
scale the indicators, and a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent. The score is the model's margin through
a fitted logistic curve.

Defined results: a null text counts as empty; an empty text has no n-gram and
gets the score of the intercept; a row whose id is null or has no label, or
whose id carries contradicting labels, never trains; repeated rows score alike;
without labels of both classes every text scores the known class's rate (0.5
where nothing is known). Extra columns of the input are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import drawn, text_batches

DIMS_BITS = 17
HASHED = 1 << DIMS_BITS
#: After the hashed n-grams: bigrams of a word and itself, by their share of
#: all the text's word bigrams (none, under 1 %, under 5 %, ... as REPEATS says).
REPEATS = (0.0, 0.01, 0.05, 0.1, 0.2, 0.4, 0.7)
DIMS = HASHED + len(REPEATS) + 1
ORDERS = 5
#: At most so many labelled rows of each class fit the hinge-loss model; the
#: log-count ratios always cover all labelled training rows.
TRAIN_ROWS_PER_CLASS = 800
#: Up to so many labels are broadcast to the texts (16 bytes each, measured by
#: a count); beyond it the join shuffles.
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3
FOLDS = 5


def indicators(text: str | None) -> np.ndarray:
    """Sorted ids of the text's hashed byte n-grams, 1 to ORDERS long."""
    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, dtype=np.uint8)
    seen = np.zeros(DIMS, dtype=bool)
    h = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        seen[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS_BITS)] = True
    words = raw.split()
    if len(words) > 1:
        same = sum(map(eq, words, words[1:])) / (len(words) - 1)
        seen[HASHED + int(np.searchsorted(REPEATS, same))] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of scaled indicators, the ratios multiplied in
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum() / max(1.0, np.sqrt(len(ids))) + self.bias)

    def probability(self, ids: np.ndarray) -> float:
        z = self.slope * self.margin(ids) + self.shift
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """log((pos + 1) / (n_pos + 2)) - log((neg + 1) / (n_neg + 2)) by indicator."""
    return np.log((pos + 1.0) / (n_pos + 2.0)) - np.log((neg + 1.0) / (n_neg + 2.0))


def dual_coordinate_descent(
    rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: np.ndarray,
    epochs: int = 60, tolerance: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost * hinge, one dual variable at a time.

    A row's values are its indicators' ratios over the root of their number; they
    are taken from ``ratios`` at each step instead of being held.
    """
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    scale = np.array([1.0 / max(1.0, np.sqrt(len(r))) for r in rows])
    squares = np.array([float(ratios[r] @ ratios[r]) * s * s + 1.0 for r, s in zip(rows, scale, strict=True)])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            own = rows[i]
            values = ratios[own] * scale[i]
            gradient = y[i] * (float(w[own] @ values) + bias) - 1.0
            new = min(max(alpha[i] - gradient / squares[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[own] += step * y[i] * values
                bias += step * y[i]
                most = max(most, abs(step))
        if most < tolerance:
            break
    else:
        logging.getLogger(__name__).warning("hinge fit: the last of %d epochs moved a dual variable by %.3g", epochs, most)
    return w, bias


def logistic_curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins (Newton steps)."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, 0.98, 0.02)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margins + b, -60, 60)))
        r, s = weight * (p - target), weight * p * (1 - p) + 1e-12
        g = np.array([r @ margins + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[s @ margins**2 + 1e-3, s @ margins], [s @ margins, s.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, n_pos: int, n_neg: int) -> Model:
    """Fit the hinge-loss model and its curve on the bounded training sample.

    Every fourth row of the sample is left out of a first fit, which gives the
    curve unseen margins; the final weights use all rows of the sample.
    """
    share = {1: n_pos / max(1, (y > 0).sum()), -1: n_neg / max(1, (y < 0).sum())}
    weight = np.array([share[int(v)] for v in y])

    def solve(keep: np.ndarray) -> tuple[np.ndarray, float]:
        own = y[keep]
        half = {v: len(own) / (2 * max(1, int((own == v).sum()))) for v in (1, -1)}
        cost = np.array([half[int(v)] for v in own])
        return dual_coordinate_descent([rows[i] for i in keep], ratios, own, cost)

    ids = np.arange(len(rows))
    out = ids[ids % 4 == 3]
    if len({*y[out]}) == 2 and len({*y[ids % 4 != 3]}) == 2:
        w, bias = solve(ids[ids % 4 != 3])
    else:
        out = ids
        w, bias = solve(ids)
    held = Model(w * ratios, bias, 1.0, 0.0)
    margins = np.array([held.margin(rows[i]) for i in out])
    slope, shift = logistic_curve(margins, y[out], weight[out] / weight.mean())
    w, bias = solve(ids)
    return Model((w * ratios).astype(np.float64), bias, max(slope, 1e-3), shift)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (doc_id, text, y): label 1 or 0, ids outside the held-out fold."""
    y = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("__most"))
        .where((F.col("y") == F.col("__most")) & ~held_out(F.col("doc_id")))
        .select("doc_id", "y")
    )
    if labels.count() <= BROADCAST_LABELS:
        y = F.broadcast(y)
    return docs.select("doc_id", "text").join(y, "doc_id")


def held_out(doc_id):
    """Whether crc32 of the id as text leaves no remainder by FOLDS; false for a null id."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % F.lit(FOLDS)
    return F.coalesce(rest == 0, F.lit(False))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, DIMS), dtype=np.int64)
    docs = [0, 0]
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"], strict=True):
            counts[int(y), indicators(text)] += 1
            docs[int(y)] += 1
    ids = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"id": ids, "neg": counts[0, ids], "pos": counts[1, ids]})
    yield pd.DataFrame({"id": [-1], "neg": [docs[0]], "pos": [docs[1]]})


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            {"doc_id": batch["doc_id"], "y": batch["y"], "ids": [indicators(t).tobytes() for t in batch["text"]]}
        )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn a model from the labelled rows of ``docs``.

    The log-count ratios come from one distributed count over all labelled
    rows, summed by indicator (DIMS rows at most reach the driver). The
    hinge-loss fit takes at most TRAIN_ROWS_PER_CLASS rows of each class, those
    with the smallest hash of the id.
    """
    text_batches(docs.sparkSession)
    known = labelled(docs, labels)
    counts = (
        known.select("text", "y")
        .mapInPandas(_count, "id int, neg long, pos long")
        .groupBy("id")
        .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        .toPandas()
    )
    totals = counts[counts["id"] == -1]
    n_neg, n_pos = int(totals["neg"].sum()), int(totals["pos"].sum())
    if not n_neg or not n_pos:
        rate = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.5
        return Model(np.zeros(DIMS), 0.0, 1.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    counts = counts[counts["id"] >= 0]
    pos, neg = np.zeros(DIMS), np.zeros(DIMS)
    pos[counts["id"]], neg[counts["id"]] = counts["pos"], counts["neg"]
    picked = []
    for y, n in enumerate((n_neg, n_pos)):
        few = drawn(known.where(F.col("y") == y), "doc_id", TRAIN_ROWS_PER_CLASS, n)
        picked.append([r[0] for r in few.collect()])
    chosen = docs.sparkSession.createDataFrame(
        [(i, y) for y, ids in enumerate(picked) for i in ids], "doc_id long, y int"
    )
    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .mapInPandas(_features, "doc_id long, y int, ids binary")
        .groupBy("doc_id", "y")
        .agg(F.min("ids").alias("ids"))
        .toPandas()
        .sort_values("doc_id")
    )
    mixed = sample["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sample = sample.iloc[np.argsort(mixed, kind="stable")]
    rows = [np.frombuffer(x, dtype=np.int32) for x in sample["ids"]]
    y = np.where(sample["y"].to_numpy() == 1, 1, -1)
    model = fit(rows, y, log_count_ratios(pos, neg, n_pos, n_neg), n_pos, n_neg)
    del rows, sample, counts
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, held_out, score and predicted of every row of ``docs``.

    Only the texts go through Python, in Arrow batches; the model (DIMS doubles)
    is broadcast.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in texts:
            yield pd.Series([own.probability(indicators(t)) for t in batch], dtype="float64")

    scored = docs.select(*keep, held_out(F.col("doc_id")).alias("held_out"), probability("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in texts:
            yield pd.Series([own.probability(indicators(t)) >= THRESHOLD for t in batch], dtype=bool)

    return docs.where(good("text"))
