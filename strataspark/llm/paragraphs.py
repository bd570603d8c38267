"""Substring dedup: paragraphs by MinHash banding.

Paragraphs are the lines of a text with at least LEAST_WORDS words. Equal ones
(by their lower-cased words) are one node. Bands of MinHash values are tuned so
that nodes of similarity 0.8 share a band with the target recall; nodes that
collide are joined, their shingle sets compared exactly, and the verified links
clustered by components. Of each cluster the first place (least doc_id, then
line) stays, the other places go.

Passages cover every word that is left then, whatever the lines: of a text's words
(without the lines that went) each window of ANCHOR_WORDS words has a hash, and the
least hash of any REACH + 1 windows in a row is an anchor (winnowing), so that texts
that share LEAST_WORDS words in a row share an anchor. Words around a place of an anchor
are compared with those around its first place; equal runs of at least LEAST_WORDS
words go, but for the first place.

Defined results: a null text is an empty one; texts without such a line are left
alone by the first step; rows of one id, or of none, are rows of their own; null ids
come first. Result: one row per place of a cluster with at least two. Other
columns are ignored by ``repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from strataspark.llm.common import broadcast_if_small, mark, materialize, settle, text_batches
from strataspark.llm.components import components
from strataspark.llm.jaccard_join import BLOCK_NODES, links_of
from strataspark.llm.minhash import SHINGLE_WORDS, SIMILAR, key_of, normal, runs, runs_of, shingles, signatures

LEAST_WORDS = 50
VALUES = 72
#: Words as ``normal`` parts them.
SPACED = re.compile(r"[^ \t\n\r\x0b\x0c]+")
COLUMNS = ["doc_id", "line", "n_words", "kept", "first_doc_id", "first_line", "n_places"]
TARGET_RECALL = 0.995
#: Words of an anchor's window; windows, beside its own, among which it is the least: every
#: run of LEAST_WORDS words holds REACH + 1 windows. Two of REACH + 2 words are anchors.
ANCHOR_WORDS = 16
REACH = LEAST_WORDS - ANCHOR_WORDS
#: Bytes of words that are hashed at once: their arrays stay in the processor's cache.
CHUNK_BYTES = 1 << 17


def tuned_bands(values: int = VALUES, target: float = TARGET_RECALL) -> tuple[int, int]:
    """(bands, rows): the most rows per band, from ``values`` MinHash values at most,
    with which pairs of similarity SIMILAR share a band with the target recall."""
    s = SIMILAR[0] / SIMILAR[1]
    for rows in range(values, 1, -1):
        bands = values // rows
        if 1 - (1 - s**rows) ** bands >= target:
            return bands, rows
    return values, 1


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of the bands (a row of ``bands`` each) of signatures of bands x rows values."""
    values = values.reshape(-1, bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = (key ^ values[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in parts of about CHUNK_BYTES: their hashes are made at once."""
    part: list[bytes] = []
    held = 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= CHUNK_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def _with_ids(docs: DataFrame, more: str) -> StructType:
    """Columns uid and doc_id as in ``docs``, and some more."""
    own = [StructField(c, docs.schema[c].dataType) for c in ("uid", "doc_id")]
    return StructType([*own, *StructType.fromDDL(more).fields])


def _rows(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text and the whole row of every row of ``docs``, written once."""
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    return materialize(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", others.alias("row")), "paragraph-rows")


def places(docs: DataFrame) -> DataFrame:
    """uid, doc_id, line, n_words, node, keys of every paragraph, written once."""
    text_batches(docs.sparkSession)
    bands, rows = tuned_bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, lines, n_words, words = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    own = normal(line)
                    n = own.count(b" ") + 1
                    if n >= LEAST_WORDS:
                        of.append(i)
                        lines.append(k)
                        n_words.append(n)
                        words.append(own)
            keys = [np.empty(0, dtype=np.int64)]
            for part in _chunks(words):
                keys.append(band_keys(signatures(*runs_of(part, SHINGLE_WORDS), bands * rows), bands, rows).ravel())
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("uid").take(at), batch.column("doc_id").take(at), pa.array(lines, pa.int32()), pa.array(n_words, pa.int32()),
                pa.array(map(key_of, words), pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, bands * len(words) + 1, bands, dtype=np.int32), np.concatenate(keys)),
            ], ["uid", "doc_id", "line", "n_words", "node", "keys"])

    form = _with_ids(docs, "line int, n_words int, node binary, keys array<long>")
    return materialize(docs.select("uid", "doc_id", "text").mapInArrow(run, form), "paragraphs")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, line, n_words, kept, first_doc_id, first_line, n_places of every place of
    a cluster of alike paragraphs."""
    return _repeats(_rows(docs)).select(*COLUMNS)


def _repeats(docs: DataFrame) -> DataFrame:
    """``repeats`` of a table of ``_rows``, with the uid."""
    found = places(docs)
    n_found = found.count()
    nodes = found.groupBy("node").agg(
        F.min(F.struct("doc_id", "line", "uid")).alias("first"),
        F.count("*").alias("n"),
        F.any_value("keys").alias("keys"),
    )
    nodes = materialize(nodes.withColumn("short", F.xxhash64("node")), "paragraph-nodes")
    # candidates go by a 64-bit hash of the node: one that two nodes share only adds a candidate
    keys = nodes.select("short", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("short").alias("least"), F.max("short").alias("most")).where("least <> most")
    most = tuned_bands()[0] * n_found
    shared = materialize(shared.select(F.col("key").alias("k"), "least"), "paragraph-bands", most // 2)
    shared = broadcast_if_small(shared, shared.count())
    candidates = keys.join(shared, F.col("key") == F.col("k")).select(F.col("short").alias("a"), F.col("least").alias("b"))
    groups = components(candidates, most)
    n_grouped = groups.count()

    sizes = groups.groupBy(F.col("root").alias("r")).agg(F.ceil(F.count("*") / BLOCK_NODES).alias("blocks"))
    bins = max(1, n_grouped // BLOCK_NODES)
    wanted = groups.withColumnRenamed("node", "g").join(broadcast_if_small(sizes, n_grouped), F.col("root") == F.col("r"))
    wanted = wanted.join(nodes, F.col("g") == F.col("short")).select(
        "node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        F.col("first.uid").alias("first_uid"), F.col("first.line").alias("line"),
    )
    # two nodes of one hash double a row, hardly ever
    wanted = broadcast_if_small(wanted, n_grouped)

    @F.pandas_udf("binary")
    def line_set(texts: pd.Series, lines: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for text, k, node in zip(texts, lines, keys, strict=True):
            parts = (text or "").split("\n")
            words = normal(parts[k]) if k < len(parts) else b""
            out.append(shingles(words).tobytes() if key_of(words) == node else None)
        return pd.Series(out, dtype=object)

    texts = docs.select("uid", "text")
    sets = texts.join(wanted, texts["uid"] == wanted["first_uid"]).select(
        "node", "root", "blocks", "block", line_set("text", "line", "node").alias("shingles")
    )
    links = links_of(sets, bins, "binary")
    classes = components(links.where("b IS NOT NULL").select("a", "b"))
    of_node = nodes.select("node", "first", "n").join(
        classes.select(F.col("node").alias("c"), "root"), F.col("node") == F.col("c"), "left"
    )
    of_node = of_node.withColumn("root", F.coalesce("root", "node")).where("c IS NOT NULL OR n > 1")
    clusters = of_node.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("kept"), F.sum("n").alias("n_places"))
    of_node = of_node.join(clusters, F.col("root") == F.col("r")).select(F.col("node").alias("m"), "kept", "n_places")
    return found.join(of_node, F.col("node") == F.col("m")).select(
        "uid", "doc_id", "line", "n_words",
        F.struct("doc_id", "line", "uid").eqNullSafe(F.col("kept")).alias("kept"),
        F.col("kept.doc_id").alias("first_doc_id"), F.col("kept.line").alias("first_line"), "n_places",
    )


def _stream(text: str | None, gone: list[int] | None) -> tuple[bytes, np.ndarray]:
    """Words of the lines that didn't go, one space between, and the line of each."""
    skip = () if gone is None else set(gone)
    lines = [b"" if k in skip else normal(line) for k, line in enumerate((text or "").split("\n"))]
    counts = [line.count(b" ") + 1 if line else 0 for line in lines]
    return b" ".join([line for line in lines if line]), np.repeat(np.arange(len(lines)), counts)


def _words_left(text: str | None, gone: list[int] | None) -> bytes:
    """The words of ``_stream`` alone."""
    if not gone:
        return normal(text)
    skip = set(gone)
    return normal("\n".join([line for k, line in enumerate((text or "").split("\n")) if k not in skip]))


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of some texts' words, one text after another,
    and how many each text has."""
    long = np.array([t.count(b" ") + 1 >= LEAST_WORDS for t in texts], dtype=bool)
    n_anchors = np.zeros(len(texts), dtype=np.int64)
    h, n = runs_of([t for t, x in zip(texts, long, strict=True) if x], ANCHOR_WORDS)
    if not len(h):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), n_anchors
    # the first least one of REACH + 1 in a row: of 2, 4, 8 .., as far as these overlap
    least, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width <= REACH:
        step = min(width, REACH + 1 - width)
        left, right = slice(None, len(least) - step), slice(step, None)
        later = least[right] < least[left]
        least, at = np.where(later, least[right], least[left]), np.where(later, at[right], at[left])
        width += step
    # rows of hashes that begin in one text and end in another don't count
    starts = np.cumsum(n) - n
    windows = n - REACH
    at = at[np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    of = np.searchsorted(starts, at, side="right") - 1
    n_anchors[long] = np.bincount(of, minlength=len(n))
    return at - starts[of], h[at].view(np.int64), n_anchors


def passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """uid, doc_id, kept, start, end, line, first_doc_id, first_line, n_places of the places
    of repeated runs of words. ``docs``: uid, doc_id, text; ``gone``: __uid, __lines."""
    spark = docs.sparkSession
    text_batches(spark)
    whole = docs.select("uid", "doc_id", "text").join(gone, F.col("uid") == F.col("__uid"), "left")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = map(_words_left, batch.column("text").to_pylist(), batch.column("__lines").to_pylist())
            made = [anchors_of(part) for part in _chunks(list(texts))]
            if not made:
                continue
            pos, h, n = (np.concatenate(x) for x in zip(*made, strict=True))
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(at), batch.column("doc_id").take(at), pa.array(pos.astype(np.int32)), pa.array(h)],
                ["uid", "doc_id", "pos", "h"],
            )

    since = mark()
    found = whole.select("uid", "doc_id", "text", "__lines").mapInArrow(anchors, _with_ids(docs, "pos int, h long"))
    found = materialize(found, "passage-anchors")
    shared = found.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("n")).where("n > 1")
    # written, so that a very common anchor's rows can be split among tasks in the join
    shared = materialize(shared, "passage-counts", found.count())
    shared = broadcast_if_small(shared, shared.count())
    # the first places are sought among the anchors that are shared alone
    some = materialize(found.join(shared, F.col("h") == F.col("g")).drop("g"), "passage-shared")
    settle(spark, since, some)
    first = some.groupBy(F.col("h").alias("g")).agg(F.min(F.struct("doc_id", "uid", "pos")).alias("first"))
    first = materialize(first, "passage-first")
    wanted = some.join(broadcast_if_small(first, first.count()), F.col("h") == F.col("g")).groupBy(F.col("uid").alias("u")).agg(F.collect_list(F.struct("pos", "h", "n", "first")).alias("at"))

    @F.pandas_udf("array<struct<line: int, before: binary, after: binary, above: binary>>")
    def around(texts: pd.Series, lines: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, k, at in zip(texts, lines, places, strict=True):
            words, line = _stream(text, k)
            h = runs(words, 1).astype("<u4")
            n, forth, back = len(h), h.tobytes(), h[::-1].tobytes()
            # how many lines above the anchor's each word before it stands
            at = np.asarray(at, dtype=np.int64)
            above = line[at, None] - line[np.maximum(at[:, None] - np.arange(REACH + 1), 0)]
            small, wide = above.astype(np.uint8), above.max(axis=1) > 255
            own = []
            for i, p in enumerate(at.tolist()):
                m, end = min(p, REACH), 4 * (p + ANCHOR_WORDS)
                row = above[i, : m + 1].astype("<u4") if wide[i] else small[i, : m + 1]
                own.append({
                    "line": int(line[p]), "before": back[4 * (n - p) : 4 * (n - p + m)], "after": forth[end : end + 4 * REACH],
                    "above": row.tobytes(),
                })
            out.append(own)
        return pd.Series(out, dtype=object)

    places = whole.join(wanted, F.col("uid") == F.col("u"))
    places = places.select("uid", "doc_id", "at", around("text", "__lines", F.transform("at", lambda a: a["pos"])).alias("context"))
    places = places.select("uid", "doc_id", F.explode(F.arrays_zip("at", "context")).alias("a"))
    places = materialize(places.select("uid", "doc_id", "a.at.*", "a.context.*"), "passage-places")
    settle(spark, since, places)
    is_first = (F.col("uid") == F.col("first.uid")) & (F.col("pos") == F.col("first.pos"))
    first = places.where(is_first).select(F.col("h").alias("g"), *[F.col(c).alias(f"f_{c}") for c in ("line", "before", "after", "above")])

    @F.pandas_udf("struct<b: int, f: int, line: int, first_line: int>")
    def extent(
        before: pd.Series, f_before: pd.Series, after: pd.Series, f_after: pd.Series, line: pd.Series, above: pd.Series,
        f_line: pd.Series, f_above: pd.Series,
    ) -> pd.DataFrame:
        def same(x: bytes, y: bytes) -> int:
            if x == y:
                return len(x) // 4
            n = min(len(x), len(y))
            other = int.from_bytes(x[:n], "little") ^ int.from_bytes(y[:n], "little")
            return ((other & -other).bit_length() - 1) // 32 if other else n // 4

        b = [same(x, y) for x, y in zip(before, f_before, strict=True)]
        f = [same(x, y) for x, y in zip(after, f_after, strict=True)]
        def start(n: int, above: bytes, words: bytes, k: int) -> int:
            """Line of the word k places before the anchor in line n."""
            one = len(above) == len(words) // 4 + 1  # a byte for each
            return n - (above[k] if one else int.from_bytes(above[4 * k : 4 * k + 4], "little"))

        return pd.DataFrame({
            "b": b, "f": f, "line": list(map(start, line, above, before, b)), "first_line": list(map(start, f_line, f_above, f_before, b)),
        })

    met = places.where(~is_first).join(first, F.col("h") == F.col("g"))
    met = met.withColumn("e", extent("before", "f_before", "after", "f_after", "line", "above", "f_line", "f_above")).select(
        "uid", "doc_id", "pos", F.col("first.uid").alias("fu"), F.col("first.doc_id").alias("fd"), F.col("first.pos").alias("fp"), "n", "e.*"
    )
    met = materialize(met, "passage-met")
    settle(spark, since, met)
    met = met.where(F.col("b") + F.col("f") + ANCHOR_WORDS >= LEAST_WORDS)
    start, end = (lambda p: F.col(p) - F.col("b")), (lambda p: F.col(p) + ANCHOR_WORDS + F.col("f"))
    more = lambda kept, uid, doc, pos, line: met.select(
        F.col(uid).alias("uid"), F.col(doc).alias("doc_id"), F.lit(kept).alias("kept"), start(pos).alias("start"),
        end(pos).alias("end"), F.col(line).alias("line"), F.col("fd").alias("first_doc_id"), "first_line", F.col("n").alias("n_places"),
    )
    both = more(False, "uid", "doc_id", "pos", "line").unionAll(more(True, "fu", "fd", "fp", "first_line")).distinct()
    # runs that overlap are one: a run starts where all before it in the text have ended
    order = Window.partitionBy("uid", "kept").orderBy("start", "end")
    ended = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("new", F.coalesce(F.col("start") > ended, F.lit(True)).cast("int"))
    both = both.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.min(F.struct("start", "line", "first_doc_id", "first_line"))
    merged = both.groupBy("uid", "kept", "run").agg(
        F.any_value("doc_id").alias("doc_id"), head.alias("s"), F.max("end").alias("end"), F.max("n_places").alias("n_places")
    )
    merged = materialize(
        merged.select("uid", "doc_id", "kept", F.col("s.start"), "end", F.col("s.line"), F.col("s.first_doc_id"), F.col("s.first_line"), "n_places"),
        "passage-runs",
    )
    settle(spark, since, merged)
    # the first place of one anchor may go for another anchor's sake: then it isn't kept
    lost = merged.where(~F.col("kept")).groupBy(F.col("uid").alias("l")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    within = F.exists("spans", lambda x: (x["start"] <= F.col("start")) & (x["end"] >= F.col("end")))
    stays = merged.where("kept").join(lost, F.col("uid") == F.col("l"), "left").where(~F.coalesce(within, F.lit(False)))
    return merged.where(~F.col("kept")).unionByName(stays.drop("l", "spans"))


def _gone(lines: DataFrame) -> DataFrame:
    """__uid, __lines: the lines that go."""
    gone = lines.where(~F.col("kept")).groupBy(F.col("uid").alias("__uid")).agg(F.collect_set("line").alias("__lines"))
    gone = materialize(gone, "paragraph-gone")
    return broadcast_if_small(gone, gone.count())


def all_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``repeats``: its places, and those of repeated passages in what is
    left, with the line in which they start."""
    rows = _rows(docs)
    since = mark()
    lines = materialize(_repeats(rows), "paragraph-repeats")
    settle(docs.sparkSession, since, lines)
    runs_ = passages(rows, _gone(lines)).withColumn("n_words", F.col("end") - F.col("start"))
    return lines.select(*COLUMNS).unionByName(runs_.select(*COLUMNS))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the places that go: lines that lose all their words leave the text,
    lines that lose some keep the others, one space between; n_chars follows."""
    columns = docs.columns
    rows = _rows(docs)
    since = mark()
    gone = _gone(_repeats(rows))
    settle(docs.sparkSession, since, gone)
    spans = passages(rows, gone).where(~F.col("kept")).groupBy(F.col("uid").alias("__of")).agg(
        F.collect_list(F.struct("start", "end")).alias("__spans")
    )
    spans = materialize(spans, "passage-gone")
    settle(docs.sparkSession, since, gone, spans)

    @F.pandas_udf("string")
    def left(texts: pd.Series, lines: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, k, own in zip(texts, lines, cuts, strict=True):
            if text is None or (k is None and own is None):
                out.append(text)
                continue
            skip, at, kept = set() if k is None else set(k), 0, []
            cut = np.zeros(len(_stream(text, k)[1]), dtype=bool)
            for c in own if own is not None else ():
                cut[c["start"] : c["end"]] = True
            for i, line in enumerate(text.split("\n")):
                if i in skip:
                    continue
                n = len(normal(line).split())
                lost = cut[at : at + n]
                at += n
                if not lost.any():
                    kept.append(line)
                elif not lost.all():
                    kept.append(" ".join(w for w, x in zip(SPACED.findall(line), lost, strict=True) if not x))
            out.append("\n".join(kept))
        return pd.Series(out, dtype=object)

    cut = rows.join(gone, F.col("uid") == F.col("__uid"), "left")
    cut = cut.join(broadcast_if_small(spans, spans.count()), F.col("uid") == F.col("__of"), "left")
    cut = cut.select("uid", "__lines", "__spans", left("text", "__lines", "__spans").alias("__text"), F.col("row"))
    whole = F.col("__lines").isNull() & F.col("__spans").isNull()
    made = [F.col(f"row.`{c}`").alias(c) for c in columns]
    for i, c in enumerate(columns):
        if c == "text":
            made[i] = F.col("__text").alias(c)
        elif c == "n_chars":
            made[i] = F.when(whole, F.col("row.n_chars")).otherwise(F.char_length("__text").cast("long")).alias(c)
    return cut.select(*made)
