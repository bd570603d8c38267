"""Nearest neighbours: recall against brute force, ties, unusable vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], SCHEMA)


def exact_of(x):
    return nn.exact(pd.DataFrame({"vec_id": np.arange(len(x)), "v": [v.astype(np.float32).astype(np.float64) for v in x]}))


def norms(rng, kind):
    """Factors of unit vectors: inner products, not angles."""
    if kind == "one long":
        return np.where(np.arange(3000) == 77, 5.0, 1.0)[:, None]
    if kind == "lognormal":
        return rng.lognormal(0, 0.5, size=(3000, 1))
    return rng.uniform(0.5, 2.0, size=(3000, 1)) if kind == "uniform" else np.ones((3000, 1))


@pytest.mark.parametrize("kind", ["unit", "uniform", "one long", "lognormal"])
def test_recall_and_scores(spark, monkeypatch, kind):
    monkeypatch.setattr(nn, "BUCKET_ROWS", 24)
    monkeypatch.setattr(nn, "SAMPLE", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= norms(rng, kind)
    found, true = nn.search(table(spark, x)).toPandas(), exact_of(x)
    assert nn.recall(found, true) >= 0.95
    joined = found.merge(true, on=["query_id", "vec_id"])
    assert (joined["score_x"] == joined["score_y"]).all()
    assert (found.groupby("query_id").size() == 20).all() and found["query_id"].nunique() == 150
    one = found[found["query_id"] == 40].sort_values("rank")
    assert one["score"].is_monotonic_decreasing and list(one["rank"]) == list(range(1, 21)) and 40 not in set(one["vec_id"])


def test_copies_tie_by_id_over_slices(spark, monkeypatch):
    monkeypatch.setattr(nn, "CELL_ROWS", 16)
    monkeypatch.setattr(nn, "CELL_QUERIES", 4)
    monkeypatch.setattr(nn, "BUCKET_ROWS", 50)
    x = np.vstack([np.tile(np.eye(8)[0], (300, 1)), np.random.default_rng(1).normal(size=(100, 8))])
    found = nn.search(table(spark, x)).toPandas()
    for q in (0, 20, 280):
        own = found[found["query_id"] == q].sort_values("rank")
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-float(np.float32(x[i]).astype(float) @ np.float32(x[q]).astype(float)), i))[:20]
        assert list(own["vec_id"]) == best


def test_unusable_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (20, [nan, 1.0]), (5, [inf, 0.0]), (6, [1.0]), (None, [1.0, 1.0]), (40, [-1.0, 0.25]), (1, [0.5, 0.5]), (1, [0.25, 0.5])]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "table": F.lit("x"), "norm": F.lit(0)})
    got = sorted(tuple(r) for r in nn.search(vectors).collect())
    first = [(0, 1, None, 1.0), (0, 2, 1, 0.5), (0, 3, 1, 0.5), (0, 4, 1, 0.25), (0, 5, 40, -1.0)]
    assert got == [*first, (40, 1, 1, -0.125), (40, 2, 1, -0.375), (40, 3, 1, -0.375), (40, 4, None, -0.75), (40, 5, 0, -1.0)]
    assert nn.search(vectors.limit(0)).count() == 0 and nn.search(vectors.where("vec_id = 2")).count() == 0


def test_huge_and_tiny_vectors_take_part(spark):
    rows = [(0, [1e200] * 4), (1, [1e200, 1e200, 0.0, 0.0]), (2, [1e-200] * 4), (20, [1e-170, 0.0, 0.0, 0.0]), (3, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in nn.search(vectors).collect()}
    assert got == {(0, 1): np.inf, (0, 20): 1e200 * 1e-170, (0, 2): 4.0, (20, 0): 1e200 * 1e-170, (20, 1): 1e200 * 1e-170, (20, 2): 0.0}


def test_rotation_codes_and_plans():
    x = np.random.default_rng(2).normal(size=(50, 64))
    r = nn.rotated(x, 3)
    assert np.allclose(r @ r.T, x @ x.T) and not np.allclose(r, nn.rotated(x, 4))
    assert np.allclose(nn.hadamard(nn.hadamard(x)), x)
    unit = nn.units(x * 1e200)
    assert np.allclose(unit, nn.units(x)) and np.allclose(np.linalg.norm(unit, axis=1), 1)
    for axes in ((64,), (16, 8), (1,)):
        d = nn.distances(unit, axes, 0)
        assert d.shape == (50, nn.codes_of(axes)) and (d.min(axis=1) == 0).all()
    first = nn.rotated(unit, 0)[:, :16]
    axis = np.abs(first).argmax(axis=1)
    own = nn.distances(unit, (16, 8), 0).argmin(axis=1) // 16
    assert (own == 2 * axis + (first[np.arange(50), axis] < 0)).all()
    sizes = [nn.codes_of(nn.polytopes(n, 64)) for n in (0, 600, 5000, 60_000, 10**6, 10**9, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 2 and sizes[-1] <= nn.MOST_CODES and nn.polytopes(10**9, 2) == (2, 2)


def test_few_or_far_candidates_are_all_found(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(15, 64))
    found, true = nn.search(table(spark, x)).toPandas(), exact_of(x)
    assert len(found) == 14 and nn.recall(found, true) == 1.0
    far = np.vstack([np.ones(64), np.tile(-np.ones(64), (40, 1))])  # nothing near the first query
    got = nn.search(table(spark, far)).toPandas()
    assert list(got[got["query_id"] == 0].sort_values("rank")["vec_id"]) == list(range(1, 21))
