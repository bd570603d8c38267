"""Mixing sources to target weights by a low-discrepancy source schedule.

All DataFrame operations. Each source's documents are shuffled (by hash of id
and size) into one stream of words and cut into blocks of BLOCK_WORDS. A slot i
of the mix takes the source in whose share of the cumulative weights the
golden-ratio point frac((i + 1) * phi) falls; the k-th slot of a source takes its
k-th block, starting anew at its stream's end. A source stops at its target
(its last block may be cut); what the points still owe it follows at the end. A
document's place in the mix is the slot of its first block, one for each time that it is taken.

Defined results: a null text has size 0; documents and sources of size 0 take
part with target and taken 0; null is a source of its own, last in order; rows
of one id and size stand next to each other in the stream; repeated rows are
rows of their own; an empty table gives an empty mix. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataspark.llm.common import broadcast_if_small, mark, materialize, running_sum, settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 1024
#: Rows of a bucket of the two-level sums.
BUCKET_ROWS = 2_000
#: Up to so many sources (about 100 bytes each, counted first) are broadcast.
BROADCAST_SOURCES = 100_000
PHI = 0.6180339887498949
_STEP = 1 << 20


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def sized(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, size of each row, written once."""
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: src (index from 0), source, source_size, weight, target.

    Targets share SHARE of all sizes by weight under the cap MOST_REPEATS *
    source_size: with the sources in order of cap over weight, those whose cap
    lies under their share of what is left are full, the others share the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("src") % len(WEIGHTS) + 1))
    s = s.withColumn("cap", MOST_REPEATS * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / weights)
    s = s.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.min_by(
        F.when(~F.col("full"), F.col("level")),
        F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("src"))),
    ).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    s = s.withColumn("target", target)
    # quota in words, whole passes over the stream, words of the last pass, blocks, slots
    s = s.withColumn("quota", F.least(F.floor("target"), F.col("cap")))
    some = F.col("source_size") > 0
    s = s.withColumn("passes", F.when(some, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0))
    s = s.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS))
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK_WORDS))
    return s.select(
        "src", "source", "source_size", "weight", "target", "passes", "rest", "blocks", "slots"
    )


def schedule(sources: DataFrame, n_sources: int) -> DataFrame:
    """Slots of the mix: slot, src, pass, block; each source gets exactly its slots."""
    spark = sources.sparkSession
    total = int(sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    cells = 1 << max(6, (4 * n_sources - 1).bit_length())
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.where("slots > 0").withColumn("hi", F.sum("slots").over(upto) / F.lit(float(max(1, total))))
    shares = shares.withColumn("lo", F.lag("hi", 1, 0.0).over(Window.orderBy("src")))
    # the interval of each source, by grid cell: points meet it through an equal cell
    grid = shares.select(
        "src", "lo", "hi", "blocks", "slots",
        F.explode(
            F.sequence(
                F.floor(F.col("lo") * cells),
                F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("long")),
            )
        ).alias("cell"),
    )
    high, low = F.floor((F.col("id") + 1) / _STEP), (F.col("id") + 1) % _STEP
    turn = high * F.lit((_STEP * PHI) % 1.0) + low * F.lit(PHI)
    points = spark.range(total).withColumn("x", turn - F.floor(turn))
    points = points.withColumn("cell", F.floor(F.col("x") * cells))
    drawn = points.join(_small(grid, n_sources + cells), "cell").where("x >= lo AND x < hi")
    drawn = drawn.select(
        F.col("id").alias("slot"), "src", "blocks", "slots",
        F.floor(F.col("id") / BUCKET_ROWS).alias("bucket"), F.lit(1).cast("long").alias("one"),
    )
    ranked = running_sum(drawn, ["src"], ["slot"], "bucket", "one", "rank")
    ranked = ranked.where(F.col("rank") < F.col("slots")).select("slot", "src", "rank", "blocks")
    drawn_count = drawn.groupBy("src").agg(F.count("*").alias("drawn"))
    owed = sources.where("slots > 0").join(drawn_count.withColumnRenamed("src", "__src"), F.col("src") == F.col("__src"), "left")
    owed = owed.where(F.coalesce("drawn", F.lit(0)) < F.col("slots")).select(
        "src", "blocks", F.explode(F.sequence(F.coalesce("drawn", F.lit(0)), F.col("slots") - 1)).alias("rank")
    )
    owed = owed.select((F.lit(total) + F.col("rank") * n_sources + F.col("src")).alias("slot"), "src", "rank", "blocks")
    return ranked.unionByName(owed).select(
        "slot", "src",
        F.floor(F.col("rank") / F.col("blocks")).alias("pass"),
        (F.col("rank") % F.col("blocks")).alias("block"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, taken and slots of each row of ``docs``;
    slots: its places in the mix, empty if it isn't taken."""
    return _mix(sized(docs))


def _mix(sizes: DataFrame) -> DataFrame:
    rows = sizes.count()
    sources = materialize(targets(sizes), "mix-sources")
    n_sources = sources.count()
    small = _small(
        sources.select("src", F.col("source").alias("__source"), "passes", "rest"), n_sources
    )
    placed = sizes.join(small, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    buckets = max(1, -(-rows // BUCKET_ROWS))
    placed = placed.withColumn("h", F.xxhash64("doc_id", "size"))
    placed = placed.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets))
    # written, as are the slots: the whole as one plan would be planned anew at each of its many stages
    placed = materialize(running_sum(placed, ["src"], ["h", "doc_id", "size", "uid"], "bucket", "size", "start"), "mix-placed")
    end = F.col("start") + F.col("size")
    pieces = placed.withColumn(
        "block",
        F.explode(
            F.when(
                F.col("size") > 0,
                F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS)),
            ).otherwise(F.array(F.lit(None).cast("long")))
        ),
    )
    first = F.greatest("start", F.col("block") * BLOCK_WORDS)
    last = F.least(end, (F.col("block") + 1) * BLOCK_WORDS)
    pieces = pieces.withColumns({"first": first, "last": last})
    # of each block: how many whole passes take it, and whether the cut pass does
    slots = schedule(sources, n_sources).join(
        _small(sources.select(F.col("src").alias("__src"), F.col("passes").alias("__passes")), n_sources),
        F.col("src") == F.col("__src"),
    )
    slots = slots.groupBy(F.col("src").alias("__s"), F.col("block").alias("__b")).agg(
        F.count_if(F.col("pass") < F.col("__passes")).alias("whole"),
        F.count_if(F.col("pass") == F.col("__passes")).alias("cut"),
        # one for each pass, MOST_REPEATS + 1 at most
        F.array_sort(F.collect_list("slot")).alias("slots"),
    )
    slots = materialize(slots, "mix-slots")
    cut = F.greatest(F.least("last", "rest") - F.col("first"), F.lit(0))
    words = F.coalesce(F.col("whole") * (F.col("last") - F.col("first")) + F.col("cut") * cut, F.lit(0))
    # without a word of the cut pass its slot isn't the document's
    own = F.slice("slots", F.lit(1), (F.col("whole") + F.when(cut > 0, F.col("cut")).otherwise(0)).cast("int"))
    taken = (
        pieces.join(slots, (F.col("src") == F.col("__s")) & (F.col("block") == F.col("__b")), "left")
        .groupBy("uid", "doc_id", "src", "size")
        .agg(F.sum(words).cast("long").alias("taken"), F.min_by(F.when(words > 0, own), F.when(words > 0, F.col("block"))).alias("slots"))
        .withColumn("slots", F.coalesce("slots", F.array().cast("array<long>")))
    )
    named = sources.select(F.col("src").alias("__src"), "source", "source_size", "target")
    return taken.join(_small(named, n_sources), F.col("src") == F.col("__src")).select(
        "uid", "doc_id", "source", "size", "source_size", "target", "taken", "slots"
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it, with the columns of ``docs``;
    the rows of each partition stand in the order of the mix's slots. (An order over all
    partitions would shuffle every text once more.)

    A row's copies are its taken words over its size, rounded to whole texts
    (half up), so only the one document at the cut of each source is off, by
    less than its size. Rows that the mix doesn't take go.
    """
    whole = materialize(
        docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "mix-docs"
    )
    sizes = whole.select(
        "uid", "row.doc_id", "row.source",
        F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    since = mark()
    sizes = materialize(sizes, "mix-sizes")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    places = _mix(sizes).where("taken > 0").select(F.col("uid").alias("of"), F.explode(F.slice("slots", F.lit(1), copies)).alias("slot"))
    places = materialize(places, "mix-places")
    settle(docs.sparkSession, since, places)
    taken = whole.join(broadcast_if_small(places, places.count()), F.col("uid") == F.col("of"))
    ordered = taken.sortWithinPartitions("slot", "uid")
    return ordered.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
