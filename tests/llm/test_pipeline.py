"""The corpus pipeline's stages and contract; queries and their SQL."""

from __future__ import annotations

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_and_their_columns(spark):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"t-{name}")
        assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} <= ids
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0 and counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(packed) >= counts[4] and max(r["offset"] + r["length"] for r in packed) <= 1024


def test_rejected_documents_are_the_junk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in corpus_pipeline.drop_rejected(spark, docs, SF).select("doc_id").collect()}
    good, bad = ([i for i, q in labels.items() if q == v] for v in (1, 0))
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.4 * len(bad)


def test_empty_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_entry_has_one_query_of_each_operator():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_odd_rows_pass_all_stages(spark):
    """Nulls in every column, repeated rows and ids, ties, very long texts, further columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    long = "every word stands here " + " ".join(f"word{i}" for i in range(60_000))
    odd = [
        (None, None, None, None, None), (None, "a text without an id, but with words", None, None, 36), (1, "", "", "", 0),
        (7, "the same row stands twice in this table", "en", "web", 39), (7, "the same row stands twice in this table", "en", "web", 39),
        (7, "another text under the same id", None, "web", 30), (8, long, "en", "web", len(long)), (9, long, "en", None, len(long)),
    ]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = rows.selectExpr("*", "doc_id AS uid", "'x' AS row", "1 AS __uid", "2 AS node", "3 AS size", "4 AS source_size", "'y' AS slots")
    columns = rows.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.materialize(stage(spark, rows, SF), f"o-{name}")
        assert rows.columns == columns, name
        if name == "jaccard_join":
            texts = [r["text"] for r in rows.select("text").collect()]
            assert texts.count(long) <= 1 and len([t for t in texts if t == odd[3][1]]) <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert packed and max(r["offset"] + r["length"] for r in packed) <= 1024


def test_tables_of_a_stage_go_when_the_next_begins(spark):
    from strataspark.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    common.drop_materialized(spark)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {p.rpartition("/")[2].rpartition("-")[0] for p in common.written(0)} == {"pipeline-mixing", "pack-pieces"}
    assert docs.count() > 0


def test_executors_shrink_in_the_pipeline_alone(spark, monkeypatch):
    from strataspark.llm import common

    calls: list[int] = []
    monkeypatch.setattr(common, "shrink_executors", lambda spark: calls.append(1))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    common.settle(spark, common.mark())
    assert not calls
    corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert len(calls) > 1  # when it begins, and where its own tables are settled
    n = len(calls)
    common.settle(spark, common.mark())
    assert len(calls) == n
