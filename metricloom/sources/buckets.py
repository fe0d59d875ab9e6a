"""Points stored so that joins and look-ups by family need no shuffle.

Tables are bucketed by (family_id, slice) and sorted inside their files; ``slice`` deals the rows of
one family over several buckets, so a hot family is no hot bucket. What is joined by family is
stored once for every slice. Files carry Parquet bloom filters and small row groups, so a look-up
of one family reads the row groups that hold it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILY, SLICE = "family_id", "slice"
KEYS = [FAMILY, SLICE]
BUCKETS, WAYS = 64, 8
ROW_GROUP_BYTES = 16 << 20
FAMILIES = 100_000  # expected per file, sets the size of the bloom filter


def sliced(rows: DataFrame, *spread: str, ways: int = WAYS) -> DataFrame:
    """Rows with their slice, dealt by the columns ``spread`` that tell rows of a family apart."""
    return rows.withColumn(SLICE, F.pmod(F.xxhash64(*spread), F.lit(ways)).cast("int"))


def for_every_slice(families: DataFrame, ways: int = WAYS) -> DataFrame:
    """One row per family to one row per (family, slice)."""
    return families.withColumn(SLICE, F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))


def store(rows: DataFrame, path: str, buckets: int = BUCKETS, row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    """Write rows with family_id and slice as a bucketed table at ``path``; returns its name.

    The one shuffle is here, when rows are written: every bucket is one sorted file.
    """
    name = f"metricloom_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", path)
    writer = writer.option("parquet.block.size", row_group_bytes)
    writer = writer.option(f"parquet.bloom.filter.enabled#{FAMILY}", "true").option(f"parquet.bloom.filter.expected.ndv#{FAMILY}", FAMILIES)
    writer.saveAsTable(name)
    return name


def drop(spark: SparkSession, name: str) -> None:
    """Forget the table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def join(spark: SparkSession, points: str, families: str) -> DataFrame:
    """Stored points with the stored row of their family: both sides are read bucket by bucket.

    Both sides are sorted already and of one bucketing, so the sort-merge join shuffles nothing.
    """
    return spark.table(points).hint("merge").join(spark.table(families), KEYS).drop(SLICE)
