"""Connected components of an edge table, by alternating star contractions.

Each round hangs every node's larger neighbours to its least neighbour (large
star), then every node and its smaller neighbours to the least of them (small
star), until nothing changes: rounds grow with the logarithm of the longest path.
All steps are joins and aggregates; a round is written once. Nodes may be of any
ordered type. Edges with a null end and loops are ignored; repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import BROADCAST_ROWS, broadcast_if_small, mark, materialize, settle


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root (its component's least node) of every node of the edges (a, b), ``rows`` at most.

    The result reads a written table: reading it more than once is cheap.
    """
    since = mark()
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges", rows)
    before = None
    while (now := _mark(e)) != before:
        before, rows = now, 2 * now[0]
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        if rows > BROADCAST_ROWS:  # written, so that a node of very many edges can be split among tasks
            least = materialize(least, "edges-least", rows)
        large = both.join(broadcast_if_small(least, rows), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = materialize(small.select("e.*").where("a <> b").distinct(), "edges", rows)
        settle(e.sparkSession, since, e, release=False)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
