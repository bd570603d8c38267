"""N-gram Jaccard join: MinHash LSH forest and exact verification.

Texts are sets of five-word shingles. Equal texts (by their lower-cased words)
are one node, so copies never meet each other. Every node stands in TREES prefix trees
under a label of DEPTH MinHash values, LEVEL_BITS bits each. A label with its tree's
number before it is one whole number: sorted, these are the tries, and the number
without its last levels is the trie's node at a lesser depth.

Matching starts with whole labels. Nodes of an equal prefix are candidates, linked to the
prefix's least node, which gives groups; a group's pairs are verified by exact
Jaccard of the whole shingle sets, large groups in pairs of blocks of
BLOCK_NODES. What leaves a block are counts and a spanning forest of its links, both linear
in its nodes, with the links' similarities. Each stands for 1 / (its chance to be met at
this depth) links, which gives the recall of this and of lesser depths on this table;
prefixes are shortened to the greatest depth that reaches TARGET_RECALL, down to
LEAST_DEPTH (recall 0.9993 at similarity 0.8), and matched again. Under
ENOUGH_LINKS links the estimate isn't trusted, and LEAST_DEPTH is taken.

Defined results: a null text is an empty one; empty texts are copies of each
other; texts of fewer than five words are one shingle; rows with a null id take
part and their class id is that of the least id, or null. One row per input row:
doc_id, class_id (least doc_id of the class), n_links (other, different texts
with similarity of at least 0.8), n_copies (rows with the same words). Rows are told apart by
a number of their own, so a repeated or missing id joins nothing. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import broadcast_if_small, mark, materialize, settle, text_batches
from strataspark.llm.components import components
from strataspark.llm.minhash import forest, key_of, normal, shingles, signature, similar_pairs

TREES, DEPTH, LEAST_DEPTH = 24, 8, 6
LEVEL_BITS = 7
TARGET_RECALL = 0.998
#: Links below which the recall isn't estimated.
ENOUGH_LINKS = 200
BLOCK_NODES = 1000


def meeting(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Chance that two nodes of this similarity share a prefix of ``depth`` levels in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def shortened(similarities: dict[float, int], depth: int) -> int:
    """The greatest depth, ``depth`` at most, with the target recall by the links found at
    ``depth`` (number by similarity)."""
    if sum(similarities.values()) < ENOUGH_LINKS:
        return LEAST_DEPTH
    s = np.array(list(similarities))
    weight = np.array(list(similarities.values())) / meeting(s, depth)
    for d in range(depth, LEAST_DEPTH, -1):
        if weight @ meeting(s, d) >= TARGET_RECALL * weight.sum():
            return d
    return LEAST_DEPTH


def labels(hashes: np.ndarray) -> np.ndarray:
    """The label in each tree, behind the tree's number; none for an empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    values = (signature(hashes, TREES * DEPTH) * np.uint32(0x9E3779B1)) >> np.uint32(32 - LEVEL_BITS)
    out = np.arange(TREES, dtype=np.int64)
    for level in values.astype(np.int64).reshape(TREES, DEPTH).T:
        out = (out << LEVEL_BITS) | level
    return out


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """uid, doc_id, text, node (key of the text), labels of every row, written once; with
    the other columns as ``row`` if ``whole``."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("struct<node: string, labels: array<long>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        words = [normal(t) for t in texts]
        return pd.DataFrame(
            {
                "node": pd.Series([key_of(t).hex() for t in words], dtype=object),
                "labels": pd.Series([labels(shingles(t)) for t in words], dtype=object),
            }
        )

    others = [F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")] if whole else []
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", *others, run("text").alias("k"))
    return materialize(rows.select("uid", "doc_id", "text", *(["row"] if whole else []), "k.*"), "join-rows")


def _verify(batch: pd.DataFrame) -> pd.DataFrame:
    """Links within the candidate groups or block pairs of a bin: counts and forests."""
    left, right, count, alike = [], [], [], []
    for _, part in batch.groupby(["root", "i", "j"], sort=False):
        part = part[part["shingles"].notna()].drop_duplicates("node")
        if not len(part):
            continue
        sets = [np.frombuffer(s, dtype=np.uint64) for s in part["shingles"]]
        nodes = part["node"].to_numpy()
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        if i == j:
            a, b, s = similar_pairs(sets)
        else:
            first = (part["block"] == i).to_numpy()
            own, other = np.flatnonzero(first), np.flatnonzero(~first)
            a, b, s = similar_pairs([sets[k] for k in own], [sets[k] for k in other])
            a, b = own[a], other[b]
        links = np.bincount(np.concatenate([a, b]), minlength=len(nodes))
        some = np.flatnonzero(links)
        kept = forest(len(nodes), a, b)
        left += [*nodes[some], *nodes[a[kept]]]
        right += [*[None] * len(some), *nodes[b[kept]]]
        count += [*links[some], *[0] * len(kept)]
        alike += [*[0.0] * len(some), *s[kept]]
    return pd.DataFrame(
        {
            "a": pd.Series(left, dtype=object), "b": pd.Series(right, dtype=object), "n": np.array(count, dtype=np.int64),
            "similarity": np.round(np.array(alike, dtype=np.float64), 2),
        }
    )


def links_of(sets: DataFrame, bins: int, node_type: str) -> DataFrame:
    """Verified links of candidate groups (node, root, blocks, block, shingles), written
    once: rows (a, null, n, 0) with a node's number of links, rows (a, b, 0, similarity) of a
    spanning forest. Small groups share ``bins`` tasks, others are pairs of blocks."""
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    pairs = pairs.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    where = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", "i", "j"))
    return materialize(
        pairs.withColumn("bin", where)
        .select("bin", "node", "root", "block", "i", "j", "shingles")
        .groupBy("bin")
        .applyInPandas(_verify, f"a {node_type}, b {node_type}, n long, similarity double"),
        "join-links",
    )


def _verified(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``links_of`` the groups of nodes that share prefixes of ``depth`` levels.

    Candidates go by a 64-bit hash of the node: one that two nodes share only adds a candidate.
    """
    since, cut, most = mark(), LEVEL_BITS * (DEPTH - depth), TREES * nodes.count()
    keys = nodes.select("short", F.explode("labels").alias("label")).select("short", F.shiftright("label", cut).alias("key"))
    shared = keys.groupBy("key").agg(F.min("short").alias("least"), F.max("short").alias("most")).where("least <> most")
    shared = materialize(shared.select(F.col("key").alias("k"), "least"), "join-prefixes", most // 2)
    shared = broadcast_if_small(shared, shared.count())
    candidates = keys.join(shared, F.col("key") == F.col("k")).select(F.col("short").alias("a"), F.col("least").alias("b"))
    groups = components(candidates, most)
    n_grouped = groups.count()

    sizes = groups.groupBy(F.col("root").alias("r")).agg(F.ceil(F.count("*") / BLOCK_NODES).alias("blocks"))
    bins = max(1, n_grouped // BLOCK_NODES)
    placed = groups.withColumnRenamed("node", "g").join(broadcast_if_small(sizes, n_grouped), F.col("root") == F.col("r"))
    placed = placed.join(nodes.select("short", "node", "first"), F.col("g") == F.col("short")).select(
        "node", "root", "blocks", F.col("first.uid").alias("of"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    )
    # two nodes of one hash double a row, hardly ever
    placed = broadcast_if_small(placed, n_grouped)

    @F.pandas_udf("binary")
    def whole_set(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(normal(t)).tobytes() for t in texts], dtype=object)

    sets = rows.select("uid", "text").join(placed, F.col("uid") == F.col("of")).select(
        "node", "root", "blocks", "block", whole_set("text").alias("shingles")
    )
    found = links_of(sets, bins, "string")
    settle(rows.sparkSession, since, found)
    return found


def links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links_of`` the table of ``keyed`` and its nodes, prefixes shortened to the target recall."""
    since, depth = mark(), DEPTH
    while True:
        found = _verified(rows, nodes, depth)
        alike = found.where("b IS NOT NULL").groupBy("similarity").agg(F.sum(F.lit(1)).alias("n")).collect()
        wanted = shortened({r["similarity"]: r["n"] for r in alike}, depth)
        if wanted >= depth:
            return found
        settle(rows.sparkSession, since)
        depth = wanted


def join(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, n_links, n_copies of every row of ``docs``."""
    return _join(keyed(docs)).select("doc_id", "node", "class_id", "n_links", "n_copies")


def _join(rows: DataFrame) -> DataFrame:
    """The result of ``join`` for a table of ``keyed``, with the uid, and the class's least node as root."""
    nodes = rows.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"),
        F.count("*").alias("n_copies"), F.any_value("labels").alias("labels"),
    )
    nodes = materialize(nodes.withColumn("short", F.xxhash64("node")), "join-nodes")
    found = links(rows, nodes)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("n_links"))
    classes = components(found.where("b IS NOT NULL").select("a", "b"))
    n_linked = classes.count()
    ids = nodes.select(F.col("node").alias("i"), F.col("first.doc_id").alias("least_id"))
    linked = classes.join(ids, F.col("node") == F.col("i"))
    least = linked.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("class_least"))
    linked = classes.join(broadcast_if_small(least, n_linked), F.col("root") == F.col("r"))
    linked = linked.join(counts, F.col("node") == F.col("l"), "left").select(
        F.col("node").alias("c"), "root", "class_least", "n_links"
    )
    of_node = nodes.select("node", "first", "n_copies").join(
        broadcast_if_small(linked, n_linked), F.col("node") == F.col("c"), "left"
    )
    of_node = of_node.select(
        F.col("node").alias("m"),
        F.coalesce("root", "node").alias("root"),
        F.when(F.col("c").isNull(), F.col("first.doc_id")).otherwise(F.col("class_least")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "n_copies",
    )
    return rows.select("uid", "doc_id", "node").join(of_node, F.col("node") == F.col("m")).drop("m")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id (rows without one
    last; of the rows of one id any, but one)."""
    rows = keyed(docs, whole=True)
    since = mark()
    classes = materialize(_join(rows).select("uid", "doc_id", "root"), "join-classes")
    settle(docs.sparkSession, since, classes)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    several = classes.groupBy(F.col("root").alias("r")).agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    several = materialize(several.select("r", F.col("first.uid").alias("stays")), "join-kept")
    gone = classes.join(broadcast_if_small(several, several.count()), F.col("root") == F.col("r"))
    gone = materialize(gone.where("uid <> stays").select(F.col("uid").alias("goes")), "join-gone")
    settle(docs.sparkSession, since, gone)
    kept = rows.join(broadcast_if_small(gone, gone.count()), F.col("uid") == F.col("goes"), "left_anti")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
