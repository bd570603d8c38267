"""Shared helpers: written tables, two-level sums, draws."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataspark.llm import common


def test_materialized_tables_are_frozen_and_dropped(spark):
    df = common.materialize(spark.range(1000).withColumn("x", F.rand()), "frozen", rows=1000)
    assert sorted(df.collect()) == sorted(df.collect()) and len(df.inputFiles()) == 1
    folder = Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists() and common.drop_materialized(spark) >= 1 and not folder.exists()


def test_settled_tables_go_but_those_that_are_read(spark):
    since = common.mark()
    one = common.materialize(spark.range(10), "one")
    two = common.materialize(one.where("id > 3"), "two")
    three = common.materialize(two.where("id > 5"), "three")
    lazy = two.unionByName(three).distinct()
    common.settle(spark, since, lazy)
    assert len(common.written(since)) == 2 and lazy.count() == 6
    common.settle(spark, since, three)
    assert three.count() == 4 and [p.rpartition("/")[2].split("-")[0] for p in common.written(since)] == ["three"]
    common.settle(spark, since)
    assert common.mark() == since


def test_running_sum_by_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long").withColumn("bucket", F.floor(F.col("i") / 37))
    got = {r["i"]: r["before"] for r in common.running_sum(df, ["k"], ["i"], "bucket", "v", "before").collect()}
    sums: dict = defaultdict(int)
    for k, i, v in rows:
        assert got[i] == sums[k]
        sums[k] += v


def test_draws_take_the_least_hashes(spark):
    ids = spark.range(5000)
    some = {r[0] for r in common.drawn(ids, "id", 50, 5000).collect()}
    all_ = ids.orderBy(F.xxhash64("id")).limit(50)
    assert some == {r[0] for r in all_.collect()} and len(common.drawn(ids.limit(20), "id", 50, 20).collect()) == 20


def test_small_batches_are_never_enlarged(spark):
    key, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    common.text_batches(spark)
    assert spark.conf.get(key) == "100"
    spark.conf.set(key, "10000")
    common.text_batches(spark)
    assert spark.conf.get(key) == str(common.TEXT_BATCH_ROWS)
    assert int(spark.conf.get(size).rstrip("b")) == common.TEXT_BATCH_BYTES
    spark.conf.set(key, before)


def test_settling_returns_freed_memory_of_the_driver(spark):
    jvm = spark._jvm
    if not common.trim(spark):
        pytest.skip("this JVM can't trim its heap of native memory")
    resident = lambda: int(Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm").read_text().split()[1]) * 4096
    held = [jvm.java.util.zip.Deflater() for _ in range(401)]
    for one in held[:-1]:  # the last keeps the allocator from shrinking on its own
        one.end()
    before = resident()
    common.settle(spark, common.mark(), release=False)
    held[-1].end()
    assert before - resident() > 20e6


EXECUTOR_SETTLES = """
import re, time
from pathlib import Path
import psutil
from pyspark.sql import SparkSession, functions as F
from strataspark.llm import common

spark = (
    SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.executor.memory", "1200m").config("spark.ui.enabled", "false")
    .config("spark.executor.extraJavaOptions", "-XX:+UseG1GC").config("spark.driver.host", "127.0.0.1").getOrCreate()
)
rows = spark.range(0, 3_000_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("s"), "id").repartition(4, "s")
rows.groupBy("s").agg(F.collect_list("id")).write.format("noop").mode("overwrite").save()
executor = next(p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()))
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", Path(f"/proc/{executor.pid}/smaps_rollup").read_text())[1]) // 1024
time.sleep(2)
before = held()
with common.shrinking():
    common.settle(spark, common.mark())
end = time.time() + 15
while held() > before / 2 and time.time() < end:
    time.sleep(0.5)
print("MB", before, held())
spark.stop()
"""


def test_settling_between_stages_returns_freed_memory_of_the_executors():
    pytest.importorskip("psutil")
    env = {**os.environ, "PYTHONPATH": str(Path(common.__file__).parents[2])}
    run = subprocess.run([sys.executable, "-c", EXECUTOR_SETTLES], env=env, capture_output=True, text=True, timeout=180, check=True)
    before, after = map(int, run.stdout.split("MB")[-1].split())
    assert before > 500 and after <= before / 2


CHMODS = """
import os, sys
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from strataspark.llm import common

log = Path(sys.argv[1], "log")
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.checkpoint.dir", f"{sys.argv[1]}/shared").getOrCreate()
)
rows = common.materialize(spark.range(0, 1000, 1, 3), "whole")
folder = "/" + rows.inputFiles()[0].rpartition("/")[0].removeprefix("file:").lstrip("/")
print("GOT", rows.count(), rows.agg(F.sum("id")).first()[0], len(rows.inputFiles()), len(os.listdir(folder)))
spark.stop()
print("STARTED", sum("/attempt_" in x for x in log.read_text().splitlines()))
"""


def test_written_tables_have_no_sums_and_start_fewer_processes(tmp_path):
    chmod = tmp_path / "bin" / "chmod"
    chmod.parent.mkdir()
    chmod.write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/log\nexec /bin/chmod "$@"\n')
    chmod.chmod(0o755)
    (tmp_path / "log").touch()
    env = {**os.environ, "PYTHONPATH": str(Path(common.__file__).parents[2]), "PATH": f"{chmod.parent}:{os.environ['PATH']}"}
    run = subprocess.run([sys.executable, "-c", CHMODS, str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    # no sums beside the files and no marker
    assert list(map(int, run.stdout.split("GOT")[1].split("\n")[0].split())) == [1000, 499_500, 3, 3]
    assert int(run.stdout.split("STARTED")[1]) == 3 + 3  # each file and its task's folder
