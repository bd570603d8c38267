"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's bytes; normalised chunking sets a chunk's end at
the first place behind its shortest length where the hash has STRICT zero bits,
or, beyond the wanted length, LOOSE zero bits, or at the longest length. The
fingerprint is the set of chunk digests with the chunks' lengths in bytes, in
order of digest. Two fingerprints are alike by weighted containment: bytes in
shared digests over the bytes of the fingerprint with fewer.

Boundaries depend on the last WINDOW bytes only, so an edit shifts no chunk
beyond the next boundaries.

Defined results: a null text is an empty one; an empty text's fingerprint is the
empty string, like another empty one (1.0) and unlike any other (0.0); equal
texts have equal fingerprints. In the edit query rows stand in descending doc_id,
null ids last, rows of one id by hash of the text; a table of one row is its own
next document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import text_batches

SHORTEST, WANTED, LONGEST = 12, 40, 160
STRICT, LOOSE = 6, 4
WINDOW = 8
#: Rows of a neighbour bucket, and how many ranges of ids there are at most: what the
#: driver holds is a row of each. Ids of more rows are buckets of their own, cut by hash of
#: the text. Buckets are sorted and streamed, never held.
BUCKET_ROWS = 4_000
MOST_BUCKETS = 20_000
#: Parts of one id's rows at most.
_PARTS = 1 << 20
_GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < WINDOW:  # sums of the last 2, 4, 8 bytes, each byte shifted by its age
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    h = h * np.uint32(0x9E3779B1)  # mixed, as low bits hang on the newest bytes alone
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE))) + 1
    strict = (h[loose - 1] < np.uint32(1 << (32 - STRICT))).tolist()
    ends, start, at = [], 0, 0
    places = loose.tolist()
    m = len(places)
    while start < n:
        low, mid, high = start + SHORTEST, start + WANTED, min(start + LONGEST, n)
        while at < m and places[at] < low:
            at += 1
        k = at
        while k < m and places[k] <= mid and not strict[k]:
            k += 1
        end = places[k] if k < m and places[k] < high else high
        ends.append(end)
        start = end
    return ends


def chunks(text: str) -> dict[int, int]:
    """Digest -> length of the text's chunks."""
    data = text.encode("utf-8", "replace")
    start, out, digest = 0, {}, xxhash.xxh64_intdigest
    for end in boundaries(data):
        out[digest(data[start:end])] = end - start
        start = end
    return out


def fingerprint(found: dict[int, int]) -> str:
    return " ".join([f"{d:016x}:{found[d]}" for d in sorted(found)])


def parse(text: str) -> dict[int, int]:
    """A fingerprint's digests and lengths."""
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in text.split())}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes in shared chunks over the bytes of the lighter fingerprint."""
    if not a or not b:
        return float(len(a) == len(b))
    if len(b) < len(a):
        a, b = b, a
    shared = sum(n for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """``text``, its last third replaced by as many code points of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_chars and fingerprint of every text: a scan without a shuffle."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("struct<n_chars: long, fingerprint: string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        whole = texts.fillna("")
        return pd.DataFrame(
            {"n_chars": whole.str.len(), "fingerprint": [fingerprint(chunks(t)) for t in whole]}
        )

    return docs.select(*keep, run("text").alias("f")).select(*keep, "f.*")


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of bucket and place; a bucket's last row is the next bucket's first."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    before = None  # (bucket, doc_id, text, chunks) of the row before
    for batch in batches:
        rows = []
        for bucket, ghost, doc_id, text in zip(
            batch["bucket"], batch["ghost"], batch["doc_id"], batch["text"], strict=True
        ):
            text = text or ""
            found = chunks(text)
            if before is not None and before[0] == bucket:
                _, own_id, own, own_chunks = before
                new = edited(own, text)
                new_chunks = chunks(new)
                rows.append(
                    (
                        own_id, len(own), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(),
                        fingerprint(own_chunks), fingerprint(new_chunks),
                        likeness(own_chunks, new_chunks), likeness(own_chunks, found),
                    )
                )
            before = None if ghost else (bucket, doc_id, text, found)
        if rows:
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edit and their likenesses.

    Buckets are ranges of the order, found by one pass over the ids; a row goes
    to its bucket, and a bucket's first row also to the bucket before, so that
    neighbours meet without a global sort. Texts are shuffled once. Rows of one id that
    fill more than a bucket are parted by the hash of their text, which orders them.
    """
    spark = docs.sparkSession
    text_batches(spark)
    lowest = -(1 << 63)
    keyed = docs.select("doc_id", "text").withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    rows = docs.count()
    n = min(MOST_BUCKETS, max(1, -(-rows // BUCKET_ROWS)))
    edges = np.array([], dtype=np.int64)
    if n > 1:
        shares = [i / n for i in range(1, n)]
        found = keyed.select(F.percentile_approx("key", shares, max(10_000, 4 * n)).alias("q")).first()[0]
        edges = np.unique(np.array(found, dtype=np.int64))
    often = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).collect() if n > 1 else []
    hot = {r["key"]: min(_PARTS, -(-r["n"] // BUCKET_ROWS)) for r in often}
    # a bucket ends with its edge's id, so a hot one is alone between two edges
    alone = [e for k in hot for e in (k, max(k, lowest + 1) - 1)]
    shared = spark.sparkContext.broadcast((np.unique(np.concatenate([edges, np.array(alone, dtype=np.int64)])), hot))

    @F.pandas_udf("long")
    def bucket_of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        ends, parts = shared.value
        key = keys.to_numpy()
        # descending: the highest keys are bucket 0, the highest hashes a hot key's part 0
        bucket = (len(ends) - np.searchsorted(ends, key, side="left")).astype(np.int64) * _PARTS
        for k, n in parts.items():
            own = np.flatnonzero(key == k)
            if len(own):
                from_top = 0.5 - ties.to_numpy()[own] / 2.0**64
                bucket[own] += np.minimum((from_top * n).astype(np.int64), n - 1)
        return pd.Series(bucket)

    placed = keyed.withColumn("tie", F.xxhash64("text")).withColumn("bucket", bucket_of("key", "tie"))
    # the first row of each bucket that has rows, and the bucket before it in the circle
    firsts = (
        keyed.select("key", F.xxhash64("text").alias("tie"))
        .withColumn("bucket", bucket_of("key", "tie"))
        .groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("first"))
        .collect()
    )
    firsts.sort(key=lambda r: r["bucket"])
    ghosts = [
        (r["first"]["key"], r["first"]["tie"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)
    ]
    before = spark.createDataFrame(ghosts, "g_key long, g_tie long, g_bucket long")
    sent = (
        placed.join(F.broadcast(before), (F.col("key") == F.col("g_key")) & (F.col("tie") == F.col("g_tie")))
        .groupBy("g_bucket").agg(F.max(F.struct("key", "tie", "doc_id", "text")).alias("r"))
        .select(F.col("g_bucket").alias("bucket"), "r.doc_id", "r.text", "r.key", "r.tie", F.lit(True).alias("ghost"))
    )
    whole = placed.withColumn("ghost", F.lit(False)).select("bucket", "doc_id", "text", "key", "tie", "ghost")
    ordered = (
        whole.unionByName(sent)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "ghost", F.desc("key"), F.desc("tie"))
    )
    return ordered.select("bucket", "ghost", "doc_id", "text").mapInPandas(_walk, RESULT)
