"""Fingerprints: boundaries, resistance to shifts, likeness, the edit query."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspark.llm import fingerprints as fp


def text(rng, n):
    return "".join(rng.choice("abcdefghij klmnopé") for _ in range(n))


@given(st.binary(max_size=3000))
def test_chunks_cover_the_text_within_limits(data):
    ends = fp.boundaries(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert sum(sizes) == len(data) and all(0 < s <= fp.LONGEST for s in sizes) and all(s >= fp.SHORTEST for s in sizes[:-1])


def test_boundaries_are_those_of_a_rolling_loop():
    rng = random.Random(4)
    data = text(rng, 4000).encode()
    ends, start = [], 0
    for i in range(len(data)):
        size = i + 1 - start
        h = sum(int(fp._GEAR[data[i - k]]) << k for k in range(min(fp.WINDOW, i + 1))) & 0xFFFFFFFF
        h = h * 0x9E3779B1 & 0xFFFFFFFF
        strict, loose = h < 1 << (32 - fp.STRICT), h < 1 << (32 - fp.LOOSE)
        if size >= fp.LONGEST or size >= fp.SHORTEST and (strict or size > fp.WANTED and loose):
            ends.append(i + 1)
            start = i + 1
    assert fp.boundaries(data) == ends + ([len(data)] if start < len(data) else [])


def test_shifts_change_few_chunks():
    rng = random.Random(1)
    a = text(rng, 20_000)
    b = "inserted " + a[:9000] + "more" + a[9000:]
    assert fp.likeness(fp.chunks(a), fp.chunks(b)) > 0.97
    assert fp.likeness(fp.chunks(a), fp.chunks(text(rng, 20_000))) < 0.02
    assert fp.likeness(fp.chunks(a[:10_000]), fp.chunks(a)) > 0.97  # containment


def test_likeness_of_empty_and_round_trip():
    a = fp.chunks("some text that is longer than a chunk, a little longer at least, or so I hope")
    assert fp.likeness({}, {}) == 1.0 and fp.likeness(a, {}) == fp.likeness({}, a) == 0.0 and fp.likeness(a, a) == 1.0
    assert fp.parse(fp.fingerprint(a)) == a and fp.fingerprint({}) == "" and fp.parse("") == {}
    assert fp.edited("abcdefg", "xyz") == "abcdexy" and fp.edited("abcdefg", "x") == "abcdex" and fp.edited("ab", "x") == "ab"


@pytest.mark.parametrize("rows_per_bucket", [3, 4000])
def test_query_equals_a_plain_walk(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(fp, "BUCKET_ROWS", rows_per_bucket)
    rng = random.Random(7)
    rows = [(i * 7 % 101, text(rng, rng.choice([0, 1, 5, 300, 2000])) + ("é🙂" if i % 3 else "")) for i in range(40)] + [(500, None), (-3, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"key": F.lit("x"), "bucket": F.lit(1), "tie": F.lit(2)})
    got = {r["doc_id"]: r for r in fp.with_edits(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for i, (doc_id, own) in enumerate(order):
        own, after = own or "", order[(i + 1) % len(order)][1] or ""
        new = fp.edited(own, after)
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert fp.parse(r["fingerprint"]) == fp.chunks(own) and fp.parse(r["edited_fingerprint"]) == fp.chunks(new)
        assert r["near_edited"] == fp.likeness(fp.chunks(own), fp.chunks(new)) and r["near_next"] == fp.likeness(fp.chunks(own), fp.chunks(after))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "abc" * 99)], "doc_id long, text string")
    assert fp.with_edits(docs).first()["near_next"] == 1.0
    assert fp.with_edits(docs.limit(0)).count() == 0
    rows = [(1, "a" * 500), (1, "a" * 500), (1, "b" * 500), (None, None), (None, "c")]
    out = fp.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in out) == [(0, 0), (0, 1), (1, 500), (1, 500), (1, 500)]
    plain = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["fingerprint"] for r in plain if r["n_chars"] == 500}) == 2 and [r["n_chars"] for r in plain] == [500, 500, 500, 0, 1]


def test_an_id_of_many_rows_is_parted_by_hash_of_text(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 5)
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text(rng, 30) + str(i)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ties = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).collect()
    order = sorted(ties, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["t"]), reverse=True)
    want = sorted(hashlib.sha256(fp.edited(r["text"], order[(i + 1) % 90]["text"]).encode()).hexdigest() for i, r in enumerate(order))
    out = fp.with_edits(docs).collect()
    assert sorted(r["edited_sha256"] for r in out) == want and sum(r["doc_id"] is None for r in out) == 30
