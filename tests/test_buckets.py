"""Joins and look-ups over stored buckets: no shuffle, few row groups."""

import hashlib

from pyspark.sql import functions as F

from metricloom.session import work_dir
from metricloom.sources import buckets as B
from metricloom.streaming.jobs import settings


def family(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def rows(spark, n=40_000):
    """A third of the rows are of one family."""
    ids = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit("0")).otherwise((F.col("id") % 500).cast("string")).alias("f"))
    return ids.select(F.sha1("f").alias("family_id"), "id", (F.col("id") * 0.5).alias("value"))


def test_join_without_exchange(spark):
    points = B.store(B.sliced(rows(spark), "id"), work_dir(spark, "p"), 8)
    means = rows(spark).groupBy("family_id").agg(F.avg("value").alias("mean"))
    families = B.store(B.for_every_slice(means), work_dir(spark, "f"), 8)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        joined = B.join(spark, points, families)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 40_000
        off = joined.groupBy("family_id").agg(F.abs(F.avg("value") - F.first("mean")).alias("d")).agg(F.max("d")).first()[0]
        assert off < 1e-6
    sizes = [r["count"] for r in spark.table(points).groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 40_000 / 8
    B.drop(spark, points)
    B.drop(spark, families)


def test_look_up_reads_few_row_groups(spark):
    path = work_dir(spark, "groups")
    wide = B.sliced(rows(spark, 120_000).withColumn("pad", F.sha2(F.col("id").cast("string"), 256)), "id")
    name = B.store(wide, path, 4, 64 << 10)
    one = spark.table(name).where(F.col("family_id") == family(7))
    found = one.select("id", "pad")
    assert found.count() == sum(1 for i in range(120_000) if i % 3 and i % 500 == 7)
    done = one.select("id", "pad")._jdf.queryExecution()
    done.executedPlan().executeCollect()
    read = 0

    def walk(plan):
        nonlocal read
        if "FileScan" in plan.nodeName() or "Scan parquet" in plan.nodeName():
            read += plan.metrics().apply("numOutputRows").value()
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    final = done.executedPlan()
    walk(final.executedPlan() if "Adaptive" in final.nodeName() else final)
    assert 0 < read < 120_000 / 3
    B.drop(spark, name)
