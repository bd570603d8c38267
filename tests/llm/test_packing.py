"""Packing: token ids, cuts, exact fill of sequences, the squares' rule."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspark.llm import packing

TEXTS = ["", None, "Hello world", " two  spaces\n\nand lines ", "a <|endoftext|> b", "<|endoftext|><|endoftext|>日", "<|endoftext", "é ß ñ Ünïcode", "日本語 テキスト 🙂", "x" * 5000, "word " * 3000, "don't we'll", "  　x"]


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizer_s(exact):
    for t in TEXTS:
        assert packing.encode(t, packing.default_tokenizer()).tolist() == exact(t or "")


def test_special_strings_are_tokens_by_default_and_text_if_plain():
    path = packing.default_tokenizer()
    assert packing.encode("a <|endoftext|> b", path).tolist() == [64, 220, 50256, 275]
    assert packing.encode("a <|endoftext|> b", path, plain=True).tolist() == [64, 1279, 91, 437, 1659, 5239, 91, 29, 275]
    ids, lengths = packing.encode_words(["a", "<|endoftext|>", "日"], path)
    assert 50256 not in ids.tolist() and len(lengths) == 3
    assert set(packing._specials(path)) == {t.content for t in packing._exact(path).get_added_tokens_decoder().values()} == {"<|endoftext|>"}


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=40))
def test_fast_ids_are_the_tokenizer_s(exact, text):
    assert packing.encode(text, packing.default_tokenizer()).tolist() == exact(text)


@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Zs", "Zl", "Zp", "Cc"]), min_size=1, max_size=8), max_size=8))
def test_words_at_once_are_words_alone(words):
    path = packing.default_tokenizer()
    ids, lengths = packing.encode_words(words, path)
    each = [packing.encode(" " + w, path).tolist() for w in words]
    assert ids.tolist() == [i for e in each for i in e] and lengths.tolist() == list(map(len, each))


@given(st.integers(0, 5000), st.integers(1, 1024))
def test_cuts(n, most):
    parts = packing.cut(n, most)
    assert sum(k for _, k in parts) == n and all(k == most for _, k in parts[1:]) and all(0 < k <= most for _, k in parts)
    assert all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:], strict=False)) and (not parts or parts[0][0] == 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_bins_are_filled_without_gaps_by_the_rule(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    bins, offsets = packing.sum_of_squares(lengths, 32)
    held = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        held[b].append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 32
    # the rule again, told plainly
    gaps, sums = [], []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        best = None
        for g in sorted({g for g in gaps if g >= n}):
            left = gaps.copy()
            left.remove(g)
            left += [g - n] if g > n else []
            squares = sum(left.count(x) ** 2 for x in set(left))
            if best is None or squares < best[0]:
                best = (squares, g)
        g = best[1] if best else 32
        if best:
            gaps.remove(g)
        gaps += [g - n] if g > n else []
        sums.append(32 - g)
    assert [int(offsets[i]) for i in np.argsort(-lengths, kind="stable")] == sums


def test_rows(spark, exact):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "Hello world"), (None, "no id")] + [(50 + i, "w " * (37 * i % 900)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("x"), "length": F.lit(0), "offset": F.lit(1)})
    out = packing.pack(docs).collect()
    want = defaultdict(int)
    for i, t in rows:
        ids = np.array([*exact(t or ""), 2], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in out:
        got[tuple(r)[:5]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in out) // 1024) + 1
    assert packing.pack(docs.limit(0)).count() == 0
