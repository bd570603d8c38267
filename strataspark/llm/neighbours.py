"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and a fast Hadamard
transform, and takes the nearest signed axis among the first coordinates, in large tables
also the nearest among the next ones (a second polytope), as the bucket's code: about
BUCKET_ROWS rows have a code, whatever the number of rows. Largest inner product is searched in
bands of the candidates' norms, each a factor of BAND_RATIO wide: within a band it
is nearest angle, nearly. A query probes, in each table and band, the codes whose axes lie
nearest to it; rows of probed buckets are reranked exactly, in double precision.

How many codes of a band to probe, and in how many tables, is fitted: the true neighbours
of at most SAMPLE queries (by least hash) are found by brute force, and the probes
are those that meet FOUND of them in every band. Under LEAST_SAMPLE sampled queries of
a length, all codes are probed, which is exact.

Rows whose vectors are equal stand in the index as often as they can be asked for, k + 1
times (least vec_id first), and equal queries are searched once. Buckets are gathered to
cells of about CELL_ROWS rows or cut into such, and a cell meets its queries in
parts of CELL_QUERIES; so no task grows with a bucket.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, neither as queries nor as candidates; vectors of different lengths never meet.
Every other row is a candidate of its own, also one of a repeated or null vec_id (null
stands last among ties); rows with a null id are no queries. Queries that meet fewer rows than
asked for are searched exactly; with fewer candidates than asked for, all are
returned. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strataspark.llm.common import broadcast_if_small, drawn, mark, materialize, settle

#: Tables to choose from, rows per code wanted, codes at most (buckets beyond are cut into cells).
TABLES = (1, 2, 4)
BUCKET_ROWS, MOST_CODES = 512, 1 << 15
BAND_RATIO, BANDS = 1.25, 16
CELL_ROWS, CELL_QUERIES = 4096, 16_384
SAMPLE, LEAST_SAMPLE = 256, 16
#: Share of the sample's true neighbours that the fitted probes meet.
FOUND = 0.96
NEAREST = 20
QUERY_EVERY = 20
SEED = 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, scaled to keep their length."""
    n, width = x.shape
    h = 1
    while h < width:
        pairs = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def width_of(dim: int) -> int:
    return 1 << max(0, int(dim - 1).bit_length())


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """The rows under the table's pseudo-rotation."""
    width = width_of(x.shape[1])
    signs = np.random.default_rng([SEED, table, width]).choice([-1.0, 1.0], size=(3, width))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for s in signs:
        x = hadamard(x * s)
    return x


def polytopes(rows: int, dim: int) -> tuple[int, ...]:
    """Axes of each polytope of a code, so that about BUCKET_ROWS rows have a code."""
    bits = max(1, min(MOST_CODES, max(2, rows // BUCKET_ROWS)).bit_length() - 1)
    most = width_of(dim).bit_length()  # bits of a signed axis
    if bits <= most:
        return (1 << (bits - 1),)
    first = min(most, -(-bits // 2))
    return tuple(1 << (b - 1) for b in (first, min(most, bits - first)))


def codes_of(axes: tuple[int, ...]) -> int:
    return math.prod(2 * a for a in axes)


def distances(unit: np.ndarray, axes: tuple[int, ...], table: int) -> np.ndarray:
    """Of each row and code: how far the code's signed axes lie behind the row's nearest, by
    squared coordinates; 0 for the row's own code."""
    r, out, at = rotated(unit, table), None, 0
    for a in axes:
        own = r[:, at % r.shape[1] : at % r.shape[1] + a]
        both = np.stack([own, -own], axis=2).reshape(len(r), -1)  # 2 * axis + (1 if negative)
        behind = (both.max(axis=1, keepdims=True) - both) ** 2
        out = behind if out is None else (out[:, :, None] + behind[:, None, :]).reshape(len(r), -1)
        at += a
    return out


@dataclass
class Plan:
    """How vectors of one length are searched."""

    rows: int
    top: float  # greatest log norm
    axes: tuple[int, ...]
    tables: int
    probes: tuple[int, ...]  # by band of norms

    @property
    def codes(self) -> int:
        return codes_of(self.axes)

    @property
    def per_cell(self) -> int:
        """Buckets of a cell."""
        return max(1, self.codes * CELL_ROWS // max(1, self.rows))

    def bands(self, ln: np.ndarray) -> np.ndarray:
        return np.clip((self.top - ln) / math.log(BAND_RATIO), 0, len(self.probes) - 1).astype(np.int64)

    @property
    def whole(self) -> bool:
        return min(self.probes) >= self.codes


Plans = dict[int, Plan]


def whole_plan(rows: int, top: float, bands: int, dim: int) -> Plan:
    """The exact one: all codes of one table."""
    axes = polytopes(rows, dim)
    return Plan(rows, top, axes, 1, (codes_of(axes),) * bands)


def matrix(column: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), -1).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; no square leaves the range of doubles."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def prepared(vectors: DataFrame) -> tuple[DataFrame, str]:
    """uid, vec_id (0 for null), none (whether it is null), key, dim, ln (log norm), v (bytes)
    of the rows that take part, written once, and the type of the bytes."""
    kind = vectors.schema["embedding"].dataType.elementType
    single = isinstance(kind, (T.FloatType, T.ShortType, T.ByteType))
    dtype, v = ("<f4", "array<float>") if single else ("<f8", "array<double>")

    @F.pandas_udf("struct<dim: int, ln: double, v: binary>")
    def pack(batch: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for x in batch:
            x = None if x is None else np.asarray(x, dtype=dtype)
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                out.append((None, None, None))
                continue
            d = x.astype(np.float64)
            most = np.abs(d).max()
            out.append((len(x), math.log(most) + 0.5 * math.log(float(((d / most) ** 2).sum())), (x + x.dtype.type(0)).tobytes()))
        return pd.DataFrame(out, columns=["dim", "ln", "v"])

    vec_id = F.col("vec_id").cast("long")
    rows = vectors.select(
        F.monotonically_increasing_id().alias("uid"), F.coalesce(vec_id, F.lit(0)).alias("vec_id"), vec_id.isNull().alias("none"),
        pack(F.col("embedding").cast(v)).alias("p"),
    )
    rows = rows.select("uid", "vec_id", "none", F.md5("p.v").alias("key"), "p.*")
    # written before the filter, which would run the function twice
    return materialize(rows, "nn-rows").where("v IS NOT NULL"), dtype


def indexed(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with at most k + 1 of each vector: those of the least vec_id."""
    often = rows.groupBy(F.col("key").alias("o")).agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("o")
    often = materialize(often, "nn-copies")
    n = often.count()
    if not n:
        return rows
    often = broadcast_if_small(often, n)
    first = Window.partitionBy("key").orderBy("none", "vec_id", "uid")
    some = rows.join(often, F.col("key") == F.col("o"), "left_semi").withColumn("copy", F.row_number().over(first))
    alone = rows.join(often, F.col("key") == F.col("o"), "left_anti")
    return materialize(alone.unionByName(some.where(F.col("copy") <= k + 1).drop("copy")), "nn-index")


def fitted(index: DataFrame, asked: DataFrame, dtype: str, k: int) -> Plans:
    """The plan of each length, from the sample's true neighbours."""
    sizes = index.groupBy("dim").agg(F.count("*").alias("n"), F.max("ln").alias("top"), F.min("ln").alias("low")).collect()
    plans = {}
    for r in sizes:
        bands = min(BANDS, 1 + int((r["top"] - r["low"]) / math.log(BAND_RATIO)))
        plans[r["dim"]] = whole_plan(r["n"], r["top"], bands, r["dim"])
    spark = index.sparkSession
    chosen = spark.createDataFrame([(r[0],) for r in drawn(asked, "key", SAMPLE, asked.count()).collect()], "c string")
    some = asked.join(F.broadcast(chosen), F.col("key") == F.col("c")).groupBy("key").agg(F.min("v").alias("v"), F.min("dim").alias("dim"))
    sample = {d: part["v"].to_list() for d, part in some.orderBy("key").toPandas().groupby("dim")}
    sample = {d: v for d, v in sample.items() if len(v) >= LEAST_SAMPLE and d in plans and plans[d].codes > 2}
    if not sample:
        return plans
    shared = spark.sparkContext.broadcast(sample)

    def truth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], list[tuple[float, float, bytes]]] = {}
        for batch in batches:
            for d, part in batch.groupby("dim"):
                if d not in shared.value:
                    continue
                own, ln = part["v"].to_list(), part["ln"].to_numpy()
                score = matrix(pd.Series(shared.value[d]), dtype) @ matrix(part["v"], dtype).T
                for i, row in enumerate(score):
                    near = np.argsort(-row, kind="stable")[: k + 1]
                    found = [(float(row[j]), float(ln[j]), own[j]) for j in near if own[j] != shared.value[d][i]]
                    best[d, i] = sorted(best.get((d, i), []) + found, reverse=True)[:k]
        rows = [(d, i, s, ln, v) for (d, i), found in best.items() for s, ln, v in found]
        yield pd.DataFrame(rows, columns=["dim", "i", "score", "ln", "v"])

    near = index.select("dim", "ln", "v").mapInPandas(truth, "dim int, i int, score double, ln double, v binary")
    order = Window.partitionBy("dim", "i").orderBy(F.desc("score"), "v")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).toPandas()
    for d, part in near.groupby("dim"):
        plans[d] = _fit(plans[d], units(matrix(pd.Series(sample[d]), dtype)), units(matrix(part["v"], dtype)), part["i"].to_numpy(), part["ln"].to_numpy())
    return plans


def _fit(plan: Plan, queries: np.ndarray, near: np.ndarray, of: np.ndarray, ln: np.ndarray) -> Plan:
    """``plan`` with the tables and probes that meet FOUND of the neighbours ``near`` (of the
    queries ``of``) in each band, and cost least."""
    bands, rank, best = plan.bands(ln), np.full(len(near), plan.codes), None
    for tables in range(1, max(TABLES) + 1):
        behind = distances(queries, plan.axes, tables - 1)
        own = distances(near, plan.axes, tables - 1).argmin(axis=1)
        before = (behind[of] < behind[of, own][:, None]).sum(axis=1)
        rank = np.minimum(rank, before)
        if tables not in TABLES:
            continue
        probes = []
        for b in range(len(plan.probes)):
            ranks = np.sort(rank[bands == b])
            probes.append(int(ranks[math.ceil(FOUND * len(ranks)) - 1]) + 1 if len(ranks) else 1)
        # vectors moved: each table has the rows, and a query for each bucket that it probes
        cost = tables * (QUERY_EVERY + sum(probes))
        if best is None or cost < best[0]:
            best = cost, Plan(plan.rows, plan.top, plan.axes, tables, tuple(probes))
    return best[1]


def _placing(plans: Plans, dtype: str) -> Callable:
    """Function of (v, dim, ln): the cell and bucket of a row in each table."""

    @F.pandas_udf("array<struct<table: int, cell: int, bucket: int>>")
    def place(v: pd.Series, dim: pd.Series, ln: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        for d, at in dim.groupby(dim).groups.items():
            plan, unit = plans[d], units(matrix(v[at], dtype))
            band = plan.bands(ln[at].to_numpy())
            own = np.stack([distances(unit, plan.axes, t).argmin(axis=1) + band * plan.codes for t in range(plan.tables)], axis=1)
            for i, b in zip(at, own.tolist(), strict=True):
                out[i] = [{"table": t, "cell": x // plan.per_cell, "bucket": x} for t, x in enumerate(b)]
        return out

    return place


def _probing(plans: Plans, dtype: str) -> Callable:
    """Function of (v, dim): the cells that a query visits, and the buckets that it probes there."""

    @F.pandas_udf("array<struct<table: int, cell: int, probed: array<int>>>")
    def probe(v: pd.Series, dim: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        for d, at in dim.groupby(dim).groups.items():
            if (plan := plans.get(d)) is None:
                continue
            step = max(1, (1 << 20) // plan.codes)
            for low in range(0, len(at), step):
                part = at[low : low + step]
                unit = units(matrix(v[part], dtype))
                visits: list[list] = [[] for _ in part]
                for t in range(plan.tables):
                    order = np.argsort(distances(unit, plan.axes, t), axis=1, kind="stable")
                    for own, codes in zip(visits, order, strict=True):
                        buckets = np.sort(np.concatenate([codes[:p] + b * plan.codes for b, p in enumerate(plan.probes)]))
                        cells = buckets // plan.per_cell
                        starts = np.flatnonzero(np.diff(cells, prepend=-1))
                        for c, probed in zip(cells[starts].tolist(), np.split(buckets, starts[1:]), strict=True):
                            own.append({"table": t, "cell": c, "probed": probed.tolist()})
                for i, own in zip(part, visits, strict=True):
                    out[i] = own
        return out

    return probe


def _reranked(dtype: str, k: int) -> Callable:
    """Function of a cell's visits and rows: the k + 1 nearest probed rows of each query."""

    def rerank(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(mine) and len(theirs):
            x, bucket = matrix(theirs["v"], dtype), theirs["bucket"].to_numpy()
            uid, ids, none = (theirs[c].to_numpy() for c in ("uid", "vec_id", "none"))
            low = int(bucket.min())
            for at in range(0, len(mine), 1024):
                part = mine.iloc[at : at + 1024]
                q, keys = matrix(part["q"], dtype), part["key"].to_numpy()
                probed = np.zeros((len(part), int(bucket.max()) - low + 1), dtype=bool)
                for i, own in enumerate(part["probed"]):
                    own = np.asarray(own) - low
                    probed[i, own[(own >= 0) & (own < probed.shape[1])]] = True
                met = probed[:, bucket - low]
                with np.errstate(over="ignore", invalid="ignore"):
                    rough = np.where(met, np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf), -np.inf)
                    if len(ids) > k + 1:
                        # all within rounding of the last one wanted: ties are settled on the exact score
                        least = np.partition(rough, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
                        slack = np.where(np.isfinite(least), 1e-9 * (1.0 + np.abs(least)), 0.0)
                        met &= rough >= (least - slack)[:, None]
                    i, j = np.nonzero(met)
                    score = (q[i] * x[j]).sum(axis=1)
                order = np.lexsort((uid[j], ids[j], none[j], -np.nan_to_num(score, nan=-np.inf), i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
                j = j[keep]
                out.append(pd.DataFrame({"key": keys[i[keep]], "uid": uid[j], "vec_id": ids[j], "none": none[j], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in ("key", "uid", "vec_id", "none", "score")})

    return rerank


def _nearest(index: DataFrame, wanted: DataFrame, plans: Plans, dtype: str, k: int) -> DataFrame:
    """key, uid, vec_id, none, score, r of the k + 1 nearest probed rows of each wanted vector (key, q, dim)."""
    since = mark()
    placed = index.select("uid", "vec_id", "none", "v", "dim", F.explode(_placing(plans, dtype)("v", "dim", "ln")).alias("p"))
    placed = materialize(placed.select("uid", "vec_id", "none", "v", "dim", "p.*"), "nn-placed")
    visits = wanted.select("key", "q", "dim", F.explode(_probing(plans, dtype)("q", "dim")).alias("p"))
    visits = materialize(visits.select("key", "q", "dim", "p.*"), "nn-visits")
    cell = ["dim", "table", "cell"]
    slices = placed.groupBy(*cell).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("slices"))
    parts = visits.groupBy(*cell).agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("parts"))
    cells = materialize(slices.join(parts, cell), "nn-cells")
    cells = broadcast_if_small(cells, cells.count())
    left = visits.join(cells, cell).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    left = left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    right = placed.join(cells, cell).withColumn("slice", F.pmod(F.xxhash64("uid"), F.col("slices")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = [*cell, "slice", "part"]
    found = (
        left.select(*own, "key", "q", "probed").groupBy(*own)
        .cogroup(right.select(*own, "uid", "vec_id", "none", "bucket", "v").groupBy(*own))
        .applyInPandas(_reranked(dtype, k), "key string, uid long, vec_id long, none boolean, score double")
    )
    if any(p.tables > 1 for p in plans.values()):
        found = found.dropDuplicates(["key", "uid"])
    order = Window.partitionBy("key").orderBy(F.desc("score"), "none", "vec_id", "uid")
    found = materialize(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1), "nn-found")
    settle(index.sparkSession, since, found)
    return found


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    ``queries`` has the columns of ``vectors``, and none of its rows is a candidate; by default
    the queries are the rows whose vec_id is divisible by QUERY_EVERY, and a row isn't its own.
    """
    rows, dtype = prepared(vectors)
    if queries is None:
        asked = rows.where(~F.col("none") & (F.col("vec_id") % QUERY_EVERY == 0))
    else:
        asked = prepared(queries.withColumn("embedding", F.col("embedding").cast(vectors.schema["embedding"].dataType)))[0]
        asked = asked.where("NOT none").withColumn("uid", F.lit(-1))
    index = indexed(rows, k)
    plans = fitted(index, asked, dtype, k)
    wanted = asked.groupBy("key").agg(F.min("v").alias("q"), F.min("dim").alias("dim"))
    found = _nearest(index, wanted, plans, dtype, k)
    partly = [d for d, p in plans.items() if not p.whole]
    full = found.where(F.col("r") == k + 1).select(F.col("key").alias("f"))
    short = wanted.where(F.col("dim").isin(partly)).join(full, F.col("key") == F.col("f"), "left_anti")
    short = materialize(short, "nn-short")
    dims = [r[0] for r in short.select("dim").distinct().collect()]
    if dims:
        # the exact way for queries whose buckets had too few rows
        exactly = {d: whole_plan(plans[d].rows, plans[d].top, len(plans[d].probes), d) for d in dims}
        again = _nearest(index.where(F.col("dim").isin(dims)), short, exactly, dtype, k)
        found = found.join(short.select(F.col("key").alias("f")), F.col("key") == F.col("f"), "left_anti").unionByName(again)
    each = asked.select(
        F.col("uid").alias("query"), F.col("vec_id").alias("query_id"), F.col("key").alias("of"), F.monotonically_increasing_id().alias("n")
    )
    each = each.join(found, F.col("of") == F.col("key")).where("uid <> query")
    order = Window.partitionBy("query", "n").orderBy(F.desc("score"), "none", "vec_id", "uid")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score")


def exact(vectors: pd.DataFrame, k: int = NEAREST) -> pd.DataFrame:
    """Brute force over a small table of usable vectors, for tests and recall."""
    x, ids = np.array(vectors["v"].tolist(), dtype=np.float64), vectors["vec_id"].to_numpy()
    out = []
    for i in np.flatnonzero(ids % QUERY_EVERY == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out += [(ids[i], r, ids[j], score[j]) for r, j in enumerate(order, 1)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])


def recall(found: pd.DataFrame, true: pd.DataFrame) -> float:
    """Share of the true neighbours that were found."""
    pairs = set(zip(found["query_id"], found["vec_id"], strict=True))
    return sum(p in pairs for p in zip(true["query_id"], true["vec_id"], strict=True)) / max(1, len(true))
