"""Jaccard join and paragraph dedup against brute force; components; shingles."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataspark.llm import jaccard_join, minhash, paragraphs
from strataspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a) and 5 * len(a & b) >= 4 * len(a | b)


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))


def variant(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = word(rng)
    return out


def corpus(seed=5):
    """Groups of near copies of different sizes, exact copies, loners and odd texts."""
    rng = random.Random(seed)
    texts = []
    for size, edits in ((12, 1), (5, 2), (4, 3), (3, 5), (2, 8)):
        for _ in range(4):
            base = [word(rng) for _ in range(rng.randint(40, 160))]
            texts += [" ".join(variant(rng, base, rng.randint(0, edits))) for _ in range(size)]
    texts += [" ".join(word(rng) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += [texts[0].upper().replace(" ", "\n"), texts[0], "", None, " \t", "one two", "One  TWO", "a b c d e", "x " * 30_000]
    rng.shuffle(texts)
    return [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def brute_classes(rows):
    """doc_id -> (class id, links, copies)"""
    by_key = defaultdict(list)
    for i, t, *_ in rows:
        by_key[b" ".join((t or "").encode().lower().split())].append(i)
    keys = list(by_key)
    sets = [grams(k.decode()) for k in keys]
    links, parent = Counter(), list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if similar(sets[a], sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for a, k in enumerate(keys):
        least[root(a)] += by_key[k]
    return {i: (min(least[root(a)]), links[a], len(by_key[k])) for a, k in enumerate(keys) for i in by_key[k]}


@pytest.mark.parametrize("block", [3, 1000])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", block)
    rows = corpus()
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute_classes(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(got) == len(rows) and not wrong


def test_one_of_each_class_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"node": F.lit(1), "class_id": F.lit("x"), "__k": F.lit(0)})
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for c, _, _ in brute_classes(rows).values()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_repeated_ids_nulls_and_empty_tables(spark):
    rows = [(1, "a b c d e f g", None, None, None)] * 3 + [(1, "other words altogether here", None, None, None), (None, "a b c d e f g", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter((r["doc_id"], r["class_id"], r["n_copies"]) for r in jaccard_join.join(docs).collect())
    assert got == {(1, 1, 4): 3, (1, 1, 1): 1, (None, 1, 4): 1, (None, None, 1): 1}
    assert jaccard_join.join(docs.limit(0)).count() == 0 and jaccard_join.keep_one(docs.limit(0)).count() == 0
    kept = sorted(str((r["doc_id"], r["text"])) for r in jaccard_join.keep_one(docs).collect())
    assert kept == ["(1, 'a b c d e f g')", "(1, 'other words altogether here')", "(None, None)"]


def test_rows_without_an_id_are_texts_of_their_own(spark):
    rng = random.Random(8)
    texts = [" ".join(word(rng) for _ in range(50)) for _ in range(30)]
    near = [t + " end" for t in texts[:5]]
    rows = [(None, t, None, None, None) for t in texts + near + texts[:3]]
    docs = spark.createDataFrame(rows, DOCS)
    kept = [r["text"] for r in jaccard_join.keep_one(docs).collect()]
    assert len(kept) == 30 and {t.removesuffix(" end") for t in kept} == set(texts)
    links = Counter(r["n_links"] for r in jaccard_join.join(docs).collect())
    assert links == {1: 13, 0: 25}


def test_prefixes_are_shortened_by_the_links_found():
    depth, least = jaccard_join.DEPTH, jaccard_join.LEAST_DEPTH
    assert jaccard_join.shortened({}, depth) == jaccard_join.shortened({0.99: 50}, depth) == least
    assert jaccard_join.shortened({0.99: 5000}, depth) == depth
    assert jaccard_join.shortened({0.8: 5000}, depth) == least
    assert least < jaccard_join.shortened({0.8: 1500, 0.95: 5000}, depth) < depth
    for d in range(least, depth + 1):
        mix = {0.8: 300, 0.85: 500, 0.95: 2000}
        wanted = jaccard_join.shortened({s: n * jaccard_join.meeting(s, d) for s, n in mix.items()}, d)
        reached = sum(n * jaccard_join.meeting(s, wanted) for s, n in mix.items()) / sum(mix.values())
        assert wanted == least or reached >= jaccard_join.TARGET_RECALL


def test_labels_meet_as_their_depth_says():
    rng = np.random.default_rng(3)
    met = np.zeros(jaccard_join.DEPTH + 1)
    for _ in range(150):
        h = rng.integers(0, 1 << 63, 450, dtype=np.uint64)
        a, b = jaccard_join.labels(h[:400]), jaccard_join.labels(h[50:])  # similarity 7/9
        for d in range(1, jaccard_join.DEPTH + 1):
            cut = jaccard_join.LEVEL_BITS * (jaccard_join.DEPTH - d)
            met[d] += (a >> cut == b >> cut).mean() / 150
    assert all(abs(met[d] - (7 / 9) ** d) < 0.04 for d in range(1, jaccard_join.DEPTH + 1))
    assert list(a) == sorted(a) and not len(jaccard_join.labels(h[:0]))


def test_forest_shortens_prefixes_on_data(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ENOUGH_LINKS", 10)
    rows = corpus(11)
    depths = []
    whole = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda r, n, d: depths.append(d) or whole(r, n, d))
    got = {r["doc_id"]: r["class_id"] for r in jaccard_join.join(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute_classes(rows)
    assert depths[0] == jaccard_join.DEPTH and depths == sorted(set(depths), reverse=True)
    assert sum(got[i] == want[i][0] for i in want) >= 0.99 * len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "c", "é"]), max_size=14))
def test_shingles_count_as_sets_of_word_runs(words):
    text = minhash.normal("  ".join(words))
    assert len(minhash.shingles(text)) == len(grams(text.decode()))


def test_similar_pairs_and_signatures():
    rng = np.random.default_rng(1)
    sets = [np.setdiff1d(np.arange(40), rng.integers(0, 40, 6)).astype(np.uint64) for _ in range(30)] + [np.empty(0, dtype=np.uint64)] * 2
    plain = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(32) for j in range(i + 1, 32) if similar(plain[i], plain[j])}
    i, j, s = minhash.similar_pairs(sets)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want
    assert all(abs(x - len(plain[a] & plain[b]) / len(plain[a] | plain[b])) < 1e-6 for a, b, x in zip(i, j, s, strict=True))
    cross = {(i, j) for i in range(10) for j in range(22) if similar(plain[i], plain[10 + j])}
    assert set(zip(*map(np.ndarray.tolist, minhash.similar_pairs(sets[:10], sets[10:])[:2]), strict=True)) == cross
    assert 0 < len(want) < 435 and not len(minhash.similar_pairs(sets[:3], [])[0]) and not len(minhash.similar_pairs([], sets[:3])[0])
    a = minhash._mixed(np.arange(1000, dtype=np.uint64))
    agree = (minhash.signature(a[:900], 2000) == minhash.signature(a[100:], 2000)).mean()
    assert abs(agree - 0.8) < 0.04
    assert minhash.forest(4, np.array([0, 0, 1]), np.array([1, 2, 2])) == [0, 1]


def test_recall_at_the_threshold_is_reached():
    assert jaccard_join.meeting(0.8, jaccard_join.LEAST_DEPTH) >= jaccard_join.TARGET_RECALL
    bands, rows = paragraphs.tuned_bands()
    assert bands * rows <= paragraphs.VALUES and 1 - (1 - 0.8**rows) ** bands >= 0.995


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7), (None, 3), (5, 4), (200, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Paragraphs


def paragraph_corpus():
    rng = random.Random(9)
    para = lambda n: [word(rng) for _ in range(n)]
    shared, near, short = para(60), para(80), para(20)
    rows = []
    for i in range(40):
        lines = [" ".join(para(rng.randint(51, 70))), " ".join(short)]
        if i % 4 == 0:
            lines.insert(1, " ".join(shared))
        if i % 5 == 0:
            lines.append(" ".join(variant(rng, near, rng.randint(0, 1))))
        rows.append((i, "\n".join(lines), "en", "s", len("\n".join(lines))))
    rows += [(100, "\n".join([" ".join(shared).upper()] * 2), "en", "s", 9), (101, None, None, None, None), (102, "", "", "", 0)]
    return rows


def brute_paragraphs(rows):
    places = [(i, k, len(line.split()), grams(line)) for i, t, *_ in rows for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= 50]
    parent = list(range(len(places)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(places)):
        for b in range(a):
            if similar(places[a][3], places[b][3]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for a, p in enumerate(places):
        groups[root(a)].append(p)
    out = set()
    for g in groups.values():
        first = min((p[0], p[1]) for p in g)
        out |= {(p[0], p[1], p[2], (p[0], p[1]) == first, *first, len(g)) for p in g if len(g) > 1}
    return out


def test_repeats_equal_brute_force(spark):
    rows = paragraph_corpus()
    got = {tuple(r) for r in paragraphs.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute_paragraphs(rows)
    assert got == want and len(want) > 15


def test_removal_keeps_first_places_and_other_lines(spark):
    rows = paragraph_corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"line": F.lit(1), "first": F.lit("x"), "root": F.lit(2)})
    out = paragraphs.remove_repeats(docs)
    assert out.columns == docs.columns
    gone = defaultdict(set)
    for i, k, _, kept, *_ in brute_paragraphs(rows):
        if not kept:
            gone[i].add(k)
    for r in out.collect():
        before = dict((x[0], x) for x in rows)[r["doc_id"]]
        if r["doc_id"] in gone:
            lines = [x for k, x in enumerate(before[1].split("\n")) if k not in gone[r["doc_id"]]]
            assert r["text"] == "\n".join(lines) and r["n_chars"] == len(r["text"])
        else:
            assert (r["text"], r["n_chars"]) == (before[1], before[4])
    assert out.count() == len(rows)


def test_paragraphs_of_odd_tables(spark):
    docs = spark.createDataFrame(paragraph_corpus(), DOCS)
    assert paragraphs.repeats(docs.limit(0)).count() == 0 and paragraphs.remove_repeats(docs.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, long, None, None, None), (5, long, None, None, None), (5, long, None, None, None)]
    got = sorted(((r["doc_id"] is None, r["kept"], r["n_places"]) for r in paragraphs.repeats(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == [(False, False, 3), (False, False, 3), (True, True, 3)]


def test_passages_over_short_lines_and_within_long_ones_go(spark):
    rng = random.Random(4)
    para = lambda n: [word(rng) for _ in range(n)]
    run = para(60)
    wrapped = "\n".join(" ".join(run[k : k + 12]) for k in range(0, 60, 12))
    inside = " ".join(para(200) + run + para(200))
    own = [" ".join(para(20)) for _ in range(2)]
    rows = [(1, own[0] + "\n" + wrapped), (2, inside), (3, wrapped + "\n" + own[1]), (4, " ".join(run[:49]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = {r["doc_id"]: r for r in paragraphs.remove_repeats(docs).collect()}
    words = inside.split()
    assert out[1]["text"] == rows[0][1] and out[2]["text"].split() == words[:200] + words[260:]
    assert out[3]["text"] == own[1] and out[3]["n_chars"] == len(own[1]) and out[4]["text"] == rows[3][1]
    found = {tuple(r) for r in paragraphs.all_repeats(docs).collect()}
    assert {x[:6] for x in found} == {(1, 1, 60, True, 1, 1), (2, 0, 60, False, 1, 1), (3, 0, 60, False, 1, 1)}


def test_rows_without_an_id_or_of_one_id_lose_their_own_lines_only(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(word(rng) for _ in range(n))
    same, others = line(60), [line(55) for _ in range(4)]
    texts = [(None, same), (None, others[0]), (None, "short\n" + same), (7, others[1]), (7, same), (None, others[2]), (7, others[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOCS)
    out = [r["text"] for r in paragraphs.remove_repeats(docs).collect()]
    assert set(others) <= set(out) and len(out) == 7
    assert sum(same in t for t in out) == 1


def windows_of(text):
    w = (text or "").lower().split()
    return [tuple(w[i : i + 50]) for i in range(len(w) - 49)]


def covered(texts):
    """Of each text, the words in a run of 50 words that stands in more than one place."""
    n = Counter(x for t in texts for x in windows_of(t))
    out = []
    for t in texts:
        hit = np.zeros(len((t or "").split()), dtype=bool)
        for i, x in enumerate(windows_of(t)):
            if n[x] > 1:
                hit[i : i + 50] = True
        out.append(hit)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_no_run_of_fifty_words_is_left_twice_and_nothing_else_goes(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(rng.randint(50, 130)) for _ in range(8)] + [fresh(49)]
    texts = []
    for _ in range(40):
        words = fresh(rng.randint(0, 60))
        for run in rng.sample(shared, rng.randint(0, 3)):
            a = rng.randint(0, max(0, len(run) - 50)) if rng.random() < 0.3 else 0
            words += run[a:] + fresh(rng.randint(0, 40))
        at, lines = 0, []
        while at < len(words):  # lines short and long, with blank ones between
            n = rng.choice([3, 12, 30, 200])
            lines += [" ".join(words[at : at + n])] + [""] * rng.choice([0, 0, 1, 300])
            at += n
        texts.append("\n".join(lines))
    rows = [(None if i % 9 == 0 else i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = [r["text"] for r in paragraphs.remove_repeats(docs).collect()]
    assert max(Counter(x for t in kept for x in windows_of(t)).values()) == 1
    hit = covered([r[1] for r in rows])
    left = Counter(w for t in kept for w in (t or "").split())
    for (_, text, *_), h in zip(rows, hit, strict=True):
        for w, x in zip((text or "").split(), h, strict=True):
            assert left[w] >= 1 and (x or left[w] == sum((t or "").split().count(w) for _, t, *_ in rows)), w
    places = paragraphs.all_repeats(docs).where("NOT kept").collect()
    lines = {i: (t or "").split("\n") for i, t, *_ in rows}
    assert places and all(r["n_words"] >= 50 and 0 <= r["line"] < len(lines[r["doc_id"]]) for r in places if r["doc_id"] is not None)
    assert all(lines[r["doc_id"]][r["line"]] for r in places if r["doc_id"] is not None)


def brute_anchors(words):
    h = minhash.runs(b" ".join(words), paragraphs.ANCHOR_WORDS)
    n = paragraphs.REACH + 1
    at = sorted({i + int(np.argmin(h[i : i + n])) for i in range(len(h) - n + 1)}) if len(words) >= paragraphs.LEAST_WORDS else []
    return at, h[at].view(np.int64).tolist()


def test_many_texts_are_hashed_at_once_as_each_alone():
    rng = np.random.default_rng(11)
    texts = [b" ".join(rng.choice([b"a", b"bb", "é".encode(), b"c"], int(n))) for n in [0, 1, 4, 5, 6, 49, 50, 51, 300, 0, *rng.integers(0, 200, 30)]]
    texts += [b" ".join([b"a"] * 120), b""]
    for words in (1, 5, 16):
        h, n = minhash.runs_of(texts, words)
        assert n.tolist() == [len(minhash.runs(t, words)) for t in texts]
        assert np.array_equal(h, np.concatenate([minhash.runs(t, words) for t in texts]))
    some = [t for t in texts if t]
    got = minhash.signatures(*minhash.runs_of(some, 5), 70)
    assert np.array_equal(got, [minhash.signature(minhash.shingles(t), 70) for t in some])
    pos, h, n = paragraphs.anchors_of(texts)
    want = [brute_anchors(t.split()) for t in texts]
    assert n.tolist() == [len(w[0]) for w in want] and sum(n) > 30
    assert pos.tolist() == [p for w in want for p in w[0]] and h.tolist() == [x for w in want for x in w[1]]
    assert [len(x) for x in paragraphs.anchors_of([b"a", b""])] == [0, 0, 2] and len(minhash.runs_of([], 5)[0]) == 0
    parts = list(paragraphs._chunks([b"x" * 50_000] * 7))
    assert [len(p) for p in parts] == [3, 3, 1] and not list(paragraphs._chunks([]))


def test_words_left_stand_in_their_lines():
    text = "Aa  b\n\n c\x0bd\n \nE"
    for gone in (None, [0], [2, 4], [0, 2, 4]):
        left = [(w, k) for k, line in enumerate(text.split("\n")) if k not in (gone or []) for w in minhash.normal(line).split()]
        words, lines = paragraphs._stream(text, gone)
        assert words.split() == [w for w, _ in left] and lines.tolist() == [k for _, k in left]
        assert paragraphs._words_left(text, gone) == words
    assert paragraphs._stream(None, None)[0] == paragraphs._words_left(None, None) == b""
