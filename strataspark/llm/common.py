"""Shared helpers of the training-data operators.

Nothing here collects rows: the helpers cut lineage in the cluster's shared
folder, set Arrow batch sizes and build two-level (bucketed) running sums.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataspark.shared import drop, shared_dir

#: Rows and bytes of an Arrow batch that holds whole texts; very long texts then stay
#: within a Python worker's memory.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 512, 32 << 20


#: Rows of a file of a materialized table whose size is known beforehand.
FILE_ROWS = 200_000

#: Hadoop's settings while a table is written. Its local file system starts a chmod for each folder, file and
#: sum of a file, and a started process for a moment shows the whole memory of its executor a second time:
#: there are no sums. The cache would hand on the file system of before; other stores take no notice.
WRITING = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a reread and not a recompute,
    and freezes values such as ``monotonically_increasing_id``. ``rows``, a bound of
    the number of narrow rows where it is known, keeps small tables in few files: each costs the
    executors two processes for permissions, and the driver its listing. It is for tables
    behind a hash aggregate alone: sorts hold memory for all partitions that a task merges.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.options(**WRITING).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def mark() -> int:
    """Where the list of written tables ends now."""
    return len(_written)


def written(since: int) -> list[str]:
    """The tables written since a ``mark``."""
    return _written[since:]


def _bare(path: str) -> str:
    return re.sub("^file:/*", "/", path)


def drop_tables(spark: SparkSession, paths: Iterable[str], *keep: DataFrame) -> None:
    """Delete written tables, but for those that the frames to ``keep`` read."""
    own = [p for p in paths if p in _written]
    if own:
        still = {_bare(unquote(f)).rpartition("/")[0] for df in keep for f in df.inputFiles()}
        for path in own:
            if _bare(path) not in still:
                drop(spark, path)
                _written.remove(path)


def settle(spark: SparkSession, since: int, *keep: DataFrame, release: bool = True) -> None:
    """Delete the tables written since a ``mark``, but for those that the frames to ``keep``
    read: for when these have been written from them."""
    drop_tables(spark, written(since), *keep)
    if release:
        release_shuffles(spark)
    else:
        trim(spark)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of plans that are through: it does so when
    the driver's garbage is collected, which a driver with little to do puts off."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)
    if _shrinks:
        shrink_executors(spark)


_shrinks = False


@contextmanager
def shrinking() -> Iterator[None]:
    """Within it executors shrink wherever shuffles are released: for several operators one after
    another, whose heaps add up. One operator alone needs none of it, and growing again costs time."""
    global _shrinks
    before, _shrinks = _shrinks, True
    try:
        yield
    finally:
        _shrinks = before


def shrink_executors(spark: SparkSession) -> None:
    """Let the executors collect their garbage in full: only then does the heap of an executor, which
    grows with every burst, give the system back what it no longer needs. One task per core;
    where tasks are busy an executor may be left out."""
    sc = spark.sparkContext
    if not sc._jsc.sc().isLocal():
        tasks = sc.defaultParallelism
        spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def trim(spark: SparkSession) -> bool:
    """Give the system back what the driver's processes have freed: the allocator keeps in its many
    arenas what compilers and planning threads took for a moment. False where the JVM can't."""
    pa.default_memory_pool().release_unused()
    jvm = spark._jvm
    call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
    call = next(m for m in call if m.getName() == "invoke")  # by the interface: the server's own class isn't open
    given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # not glibc, or a JVM without the command
        return False
    return True


def drop_materialized(spark: SparkSession) -> int:
    """Delete the tables that this process has materialized; for when their results are
    written. Returns how many there were."""
    n = len(_written)
    settle(spark, 0)
    return n


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small (never raises a lower setting)."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(rows))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(rows, str(TEXT_BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > TEXT_BATCH_BYTES:
        spark.conf.set(size, str(TEXT_BATCH_BYTES))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str, value: str, out: str
) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the same ``keys`` that stand
    before the row in (``bucket``, ``order``).

    Two levels: totals by bucket get a running sum first, then each bucket is
    summed on its own. A key with a third of all rows is thus spread over its
    buckets; ``bucket`` must grow with ``order``.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__in_bucket"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in (*keys, bucket)],
        F.coalesce(F.sum("__in_bucket").over(before), F.lit(0)).alias("__before"),
    )
    inner = (
        Window.partitionBy(*keys, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in (*keys, bucket)]
    cond: Column = same[0]
    for c in same[1:]:
        cond = cond & c
    return (
        df.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(totals, cond, "left")
        .withColumn(out, F.col("__before") + F.col("__inner"))
        .drop("__inner", "__before", *[f"__k_{k}" for k in (*keys, bucket)])
    )


def drawn(df: DataFrame, key: str, wanted: int, rows: int) -> DataFrame:
    """The ``wanted`` distinct values of ``key`` with the least hash (fewer if there are fewer).

    Of ``rows`` known rows only those whose hash lies below a matching bound compete,
    so what tasks send to the driver doesn't grow with their number.
    """
    share = min(1.0, 2.0 * wanted / max(1, rows))
    ids = df.select(key).where(F.xxhash64(key) / F.lit(2.0**64) + 0.5 <= share)
    return ids.distinct().orderBy(F.xxhash64(key) / F.lit(2.0**64), key).limit(wanted)


#: Rows (some 100 bytes each) up to which a counted side of a join is broadcast.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a side for broadcast if its counted (or bounded) rows are few; else it shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
