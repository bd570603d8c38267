"""Heuristics for unreleased content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.text import like

# Categories, name patterns in scan order, and types of the id heuristic.
SHOP, CUT, HIGH, QUESTS = "Atomic Shop (ATX_)", "Cut/Test Content", "High FormIDs (likely new)", "Disabled Quests"
SHOP_PATTERN = "ATX_%"
CUT_PATTERNS = ("zzz_%", "CUT_%", "TEST_%", "test_%", "DEBUG_%", "DVLP_%")
HIGH_TYPES = ("WEAP", "ARMO", "ALCH", "MISC", "NPC_", "QUST", "BOOK", "COBJ", "OMOD")
HIGH_SHARE = 0.995


def shop(records: DataFrame) -> DataFrame:
    return records.where(like(F.col("editor_id"), SHOP_PATTERN))


def cut(records: DataFrame, patterns: tuple[str, ...] = CUT_PATTERNS) -> DataFrame:
    """Records of each pattern, pattern after pattern (column ``pattern``): a record
    that two patterns match stands twice."""
    tagged = records.withColumn(
        "pattern", F.explode(F.array(*[F.when(like(F.col("editor_id"), p), F.lit(i)) for i, p in enumerate(patterns)]))
    )
    return tagged.where(F.col("pattern").isNotNull())


def high(records: DataFrame, types: tuple[str, ...] = HIGH_TYPES) -> DataFrame:
    """Records of the types whose id is above HIGH_SHARE of the largest id of all."""
    most = records.agg(F.floor(F.max("form_id").cast("double") * F.lit(HIGH_SHARE)).alias("__least"))
    wanted = records.where(F.col("record_type").isin(*types))
    return wanted.join(F.broadcast(most), F.col("form_id") > F.col("__least")).drop("__least")


def quests(records: DataFrame, quest_type: str = "QUST") -> DataFrame:
    return shop(records).where(F.col("record_type") == quest_type)


def find_unreleased(records: DataFrame) -> DataFrame:
    """category, pattern, place (order within the category's listing) and the record's columns.

    One pass over the records, beside the one for the largest id: a record gives a row for
    each category and pattern that it matches.
    """
    key, name, kind = F.col("form_id"), F.col("editor_id"), F.col("record_type")
    most = records.agg(F.floor(F.max("form_id").cast("double") * F.lit(HIGH_SHARE)).alias("__least"))
    in_shop = like(name, SHOP_PATTERN)

    def match(test: Column, category: str, place: Column, pattern: int = 0) -> Column:
        return F.when(test, F.struct(F.lit(category).alias("category"), F.lit(pattern).alias("pattern"), place.alias("place")))

    found = F.array(
        match(in_shop, SHOP, -key), *[match(like(name, p), CUT, key, i) for i, p in enumerate(CUT_PATTERNS)],
        match(kind.isin(*HIGH_TYPES) & (key > F.col("__least")), HIGH, -key), match(in_shop & (kind == "QUST"), QUESTS, -key),
    )
    tagged = records.join(F.broadcast(most)).withColumn("__found", F.explode(F.array_compact(found)))
    return tagged.select("__found.*", *records.columns)


def heuristic_counts(records: DataFrame) -> DataFrame:
    """Rows of each category; a record that two categories have counts in both."""
    return find_unreleased(records).groupBy("category").agg(F.count("*").alias("n"))
