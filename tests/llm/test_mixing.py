"""Mixing: targets by water filling, exact quotas, caps, the schedule's spread."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataspark.llm import mixing

DOCS = "doc_id long, text string, source string"


def targets(sizes: dict, share=1.5):
    """Repeated resharing, as it is told: nothing above twice the size."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if weight[k] * level >= 2 * sizes[k]}
        if not full:
            out |= {k: weight[k] * level for k in open_}
            break
        out |= {k: 2.0 * sizes[k] for k in full}
        left -= sum(2 * sizes[k] for k in full)
        open_ -= full
    return out


def corpus(spark, spec, block=None):
    rows, i = [], 0
    for source, sizes in spec.items():
        for n in sizes:
            rows.append((i, None if n is None else "\t".join(["w"] * n), source))
            i += 1
    return spark.createDataFrame(rows, DOCS)


SPECS = [
    {"a": [3000] * 40, "b": [10] * 50, "c": [500] * 90, None: [7, None, 0], "é": [1], "Z": [2500]},
    {"only": [5]}, {"x": [0, None]}, {"a": [1] * 3, "b": [1] * 300},
]


@pytest.mark.parametrize("spec", SPECS)
def test_targets_and_quotas(spark, spec):
    out = mixing.mix(corpus(spark, spec)).collect()
    sizes = {k: sum(n or 0 for n in v) for k, v in spec.items()}
    want = targets(sizes)
    taken = defaultdict(int)
    assert len(out) == sum(map(len, spec.values()))
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for k in sizes:
        assert taken[k] == int(want[k] + 1e-9)


def test_reruns_agree_over_other_partitions(spark):
    docs = corpus(spark, SPECS[0])
    one = mixing.mix(docs).drop("uid").collect()
    two = mixing.mix(docs.repartition(7, "doc_id")).drop("uid").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_schedule_is_spread_and_exact(spark):
    sources = mixing.materialize(mixing.targets(mixing.sized(corpus(spark, {"a": [4096] * 60, "b": [4096] * 30, "c": [4096] * 30}))), "t")
    slots = mixing.schedule(sources, 3).orderBy("slot").collect()
    want = {r["src"]: r["slots"] for r in sources.collect()}
    total = sum(want.values())
    assert {k: sum(s["src"] == k for s in slots) for k in want} == want and len({s["slot"] for s in slots}) == total
    for k, n in want.items():  # every prefix holds nearly the source's share
        seen = 0
        for i, s in enumerate(slots, 1):
            seen += s["src"] == k
            assert abs(seen - i * n / total) < 4
        ranks = [(s["pass"], s["block"]) for s in slots if s["src"] == k]
        assert ranks == sorted(ranks)


def test_words_rows_and_columns(spark):
    rows = [(1, "a b c\x1fd\x0be", "s", 9), (1, "a b c\x1fd\x0be", "s", 9), (None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", size int").withColumns({"src": F.lit(1), "taken": F.lit(2), "block": F.lit(3)})
    out = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out) == [(0, 0), (1, 3), (1, 3)]
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == {1}


def test_documents_stand_as_often_as_taken(spark):
    docs = corpus(spark, SPECS[0])
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    got = defaultdict(int)
    for r in mixing.mix_documents(docs).collect():
        got[r["doc_id"]] += 1
    assert all(got[i] == int(t + 0.5) for i, t in taken.items())


def test_places_of_documents_are_their_blocks_slots(spark):
    """Against a walk over the schedule's slots, block by block."""
    docs = corpus(spark, SPECS[0])
    rows = mixing.mix(docs).collect()
    sources = mixing.materialize(mixing.targets(mixing.sized(docs)), "t")
    of = {r["source"]: r for r in sources.collect()}
    slots = defaultdict(list)
    for r in mixing.schedule(sources, len(of)).orderBy("slot").collect():
        slots[r["src"], r["block"]].append((r["pass"], r["slot"]))
    assert all(len(r["slots"]) >= int(r["taken"] / r["size"] + 0.5) for r in rows if r["size"])
    assert all(list(r["slots"]) == sorted(r["slots"]) and bool(r["slots"]) == (r["taken"] > 0) for r in rows)
    of_block = {slot: (src, block, turn) for (src, block), own in slots.items() for turn, slot in own}
    for source, r in of.items():  # a source's words by slot are those of the schedule
        own = [x for x in rows if x["source"] == source and x["taken"]]
        held = {of_block[s][1] for x in own for s in x["slots"]}
        assert all(of_block[s][0] == r["src"] for x in own for s in x["slots"])
        assert held <= {b for s, b in slots if s == r["src"]}
        turns = [[of_block[s][2] for s in x["slots"]] for x in own]
        assert all(t == list(range(len(t))) for t in turns)


def test_mixed_documents_stand_in_the_schedule_s_order(spark):
    docs = corpus(spark, SPECS[0])
    first = {r["doc_id"]: list(r["slots"]) for r in mixing.mix(docs).collect()}
    seen, last = defaultdict(int), defaultdict(lambda: -1)
    mixed = mixing.mix_documents(docs.repartition(3, "doc_id")).withColumn("__p", F.spark_partition_id())
    for r in mixed.collect():
        slot = first[r["doc_id"]][seen[r["doc_id"]]]
        seen[r["doc_id"]] += 1
        assert slot >= last[r["__p"]]
        last[r["__p"]] = slot
