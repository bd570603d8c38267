"""Licence scans against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from strataspark.llm import licenses

WORDS = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "gnu", "mit", "Über", "x1", "under", "the"]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_base_results_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", "-", "\n"]).join(rng.choice([" ", "-", "\n", ", "]) + rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "...", "CC-BY CC BY cc by", "Ünder É cc by", "all rights reserved " * 3000, "\x00cc\x7fby"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
def test_each_template_is_found_in_place(spark, k):
    if k:  # all at once
        return
    lead = "some words before it "
    rows = [(i, lead + t.notice.upper() + " and after") for i, t in enumerate(licenses.TEMPLATES)]
    rows += [(100 + i, lead + " zz ".join(t.notice.split())) for i, t in enumerate(licenses.TEMPLATES)]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(licenses.TEMPLATES):
        assert t.label in out[i]["labels"].split(",") and out[i]["score"] == 1.0
        assert any(m["template"] == i and m["start"] == 4 for m in out[i]["matches"])
        assert out[100 + i]["labels"] == "" and out[100 + i]["score"] == 0.0 and out[100 + i]["matches"] == []


def test_frequencies_cover_all_texts_and_steer_the_index(spark):
    rows = spark.createDataFrame([(i, "mit license") for i in range(50)] + [(99, None)], "doc_id long, text string")
    idf = licenses.inverse_frequencies(rows)
    assert idf["mit"] == pytest.approx(0.0194, abs=1e-3) and idf["gnu"] == pytest.approx(3.951, abs=1e-3)
    posted = {w for w, k, _ in licenses.index(idf) if licenses.TEMPLATES[k].label == "mit" and k == 0}
    assert posted == {"released", "under", "the", "license"} or "mit" not in posted


def test_no_python_in_the_plan_and_columns(spark):
    rows = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, None)], "doc_id long, text string")
    rows = rows.withColumns({"score": F.lit("a"), "labels": F.lit(1), "word": F.lit(2)})
    out = licenses.scan(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in out.collect()) == [(0, 0), (1, 1), (1, 1)]
    assert licenses.scan(rows.limit(0)).count() == 0
