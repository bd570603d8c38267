"""Quality classifier: learning, held-out accuracy, defined results."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strataspark.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def world(spark, n=400):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "river", "stone"]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["###", "$$$"])) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_fold(spark):
    docs, labels = world(spark)
    out = {r["doc_id"]: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(out) == 400
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out.values())
    held = [i for i, r in out.items() if r["held_out"]]
    assert np.mean([out[i]["predicted"] == int(i % 4 != 0) for i in held]) > 0.97


def test_held_out_labels_are_never_read(spark):
    docs, labels = world(spark, 200)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, quality.train(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_nulls_ties_empty_tables_and_clashing_columns(spark):
    docs, labels = world(spark, 120)
    odd = spark.createDataFrame([(None, "alpha", None, None, None), (900, None, None, None, None), (901, "", "", "", 0), (901, "", "", "", 0)], DOCS)
    messy = labels.union(spark.createDataFrame([(None, 1, 0), (900, None, None), (1, 0, 0), (1, 1, 0), (5, 7, 0)], labels.schema))
    more = docs.union(odd).withColumns({"score": F.lit("x"), "y": F.lit(1), "held_out": F.lit(3), "id": F.lit(0)})
    model = quality.train(more, messy)
    out = quality.score(more, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 124
    rows = {r["doc_id"]: r for r in out.where("doc_id IS NULL OR doc_id >= 900").collect()}
    assert rows[900]["score"] == rows[901]["score"] and rows[None]["held_out"] is False
    kept = quality.accepted(more, model)
    assert kept.columns == more.columns and kept.count() == out.where("predicted = 1").count()
    none = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(0), none).count() == 0
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.train(docs, labels.where("quality = 1"))
    assert quality.score(docs, one).first()["score"] > 0.9


def test_indicators_are_the_set_of_byte_grams():
    ids = quality.indicators("abab")
    assert list(ids) == sorted(set(ids)) and set(quality.indicators("ab")) - {i for i in ids if i >= quality.HASHED} <= set(ids)
    assert len(quality.indicators(None)) == len(quality.indicators("")) == 0
    assert set(quality.indicators("x" * 100_000)) == set(quality.indicators("x" * 50))


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3]), np.array([3, 1])]
    y = np.array([1, 1, -1, -1])
    w, b = quality.dual_coordinate_descent(rows, np.ones(4), y, np.full(4, 10.0), epochs=200, tolerance=1e-6)
    margins = [w[r].sum() / np.sqrt(len(r)) + b for r in rows]
    assert all(m * s > 0.99 for m, s in zip(margins, y, strict=True))


def plain_indicators(text):
    """The same set, gram by gram."""
    raw, out = (text or "").encode(), set()
    for n in range(1, quality.ORDERS + 1):
        for i in range(len(raw) - n + 1):
            h = 0
            for k, byte in enumerate(raw[i : i + n], 1):
                h = (h * 0x01000193 + byte + k) & 0xFFFFFFFF
            out.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.DIMS_BITS))
    words = raw.split()
    if len(words) > 1:
        same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / (len(words) - 1)
        out.add(quality.HASHED + sum(same > x for x in quality.REPEATS))
    return out


def test_training_and_scores_equal_a_plain_refit(spark):
    docs, labels = world(spark, 150)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    grams = {i: plain_indicators(t) for i, t in texts.items()}
    assert all(set(quality.indicators(t).tolist()) == grams[i] for i, t in texts.items())
    counts = np.zeros((2, quality.DIMS))
    for i, v in y.items():
        counts[v, list(grams[i])] += 1
    n = [sum(v == c for v in y.values()) for c in (0, 1)]
    ratios = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    assert np.allclose(quality.log_count_ratios(counts[1], counts[0], n[1], n[0]), ratios)
    order = sorted(y, key=lambda i: i * 0x9E3779B97F4A7C15 % 2**64)
    rows = [np.array(sorted(grams[i])) for i in order]
    signs = np.array([1 if y[i] else -1 for i in order])
    want = quality.fit(rows, signs, ratios, n[1], n[0])
    got = quality.train(docs, labels)
    assert np.allclose(got.weights, want.weights) and np.allclose([got.bias, got.slope, got.shift], [want.bias, want.slope, want.shift])
    out = {r["doc_id"]: r["score"] for r in quality.score(docs, got).collect()}
    for i, g in grams.items():
        margin = sum(want.weights[k] for k in g) / max(1, len(g) ** 0.5) + want.bias
        assert abs(out[i] - 1 / (1 + np.exp(-(want.slope * margin + want.shift)))) < 1e-9


def test_the_descent_reaches_the_optimum():
    """The gap between the hinge problem and its dual closes."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(60, 12, replace=False)) for _ in range(80)]
    ratios, y, cost = rng.normal(size=60), np.where(rng.random(80) < 0.5, 1, -1), np.full(80, 0.7)
    w, b = quality.dual_coordinate_descent(rows, ratios, y, cost, epochs=3000, tolerance=1e-9)
    x = np.zeros((80, 61))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.sqrt(len(r))
    x[:, 60] = 1.0
    whole = np.append(w, b)
    primal = lambda v: 0.5 * v @ v + cost @ np.maximum(0, 1 - y * (x @ v))
    best = primal(whole)
    for _ in range(300):  # no small step in any direction is better
        assert primal(whole + rng.normal(size=61) * 10.0 ** rng.uniform(-4, -1)) >= best - 1e-9
