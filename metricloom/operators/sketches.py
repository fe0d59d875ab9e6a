"""Summaries that merge: quantile and distinct-count sketches per day, checksums of file spans.

Each is made where the rows are, stored as one small value per key and day, and merged later
without the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 800  # of the quantile sketch; 0.55 % of rank
LOG2_CELLS = 12  # of the distinct-count sketch; 1.6 % of the count
CRC_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected


def rank_error(k: int = K) -> float:
    """Error of a rank, as a share of all rows, that 99 in 100 quantiles stay within."""
    return 2.296 / k**0.9021


def count_error(log2_cells: int = LOG2_CELLS) -> float:
    """Standard error of a distinct count, as a share of the count."""
    return 1.04 / 2 ** (log2_cells / 2)


def quantile_sketches(rows: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys, sketch): one quantile sketch per key; nulls are left out. Sketches are combined before the shuffle."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merge_quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of ``keys``, from those of finer keys."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: Column, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(p))


def size(sketch: Column) -> Column:
    return F.kll_sketch_get_n_double(sketch)


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, log2_cells: int = LOG2_CELLS) -> DataFrame:
    """(keys, sketch): one distinct-count sketch per key."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.hll_sketch_agg(value, log2_cells).alias("sketch"))


def merge_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


# --- checksums --------------------------------------------------------------------------------


def _apply(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Product of a bit matrix (a 32-bit column for each bit) and checksums."""
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@cache
def _step(power: int) -> np.ndarray:
    """Matrix that carries a checksum over 2**power zero bytes."""
    if power == -3:  # one zero bit: a shift, and the polynomial where a one falls out
        return np.array([CRC_POLYNOMIAL, *(1 << k for k in range(31))], np.uint32)
    half = _step(power - 1)
    return _apply(half, half)


def carried(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What checksums of pieces add to the whole when ``length`` bytes follow each piece."""
    out, rest = crc.astype(np.uint32), length.astype(np.int64).copy()
    power = 0
    while rest.any():
        odd = rest & 1 == 1
        if odd.any():
            out[odd] = _apply(_step(power), out[odd])
        rest >>= 1
        power += 1
    return out


def span_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_path, block_start, crc, bytes) of the text of each file span, every line with its line feed."""
    at, crc, size, out = None, 0, 0, []
    for batch in batches:
        for line, file, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (file, start) != at:
                if at:
                    out.append((*at, crc, size))
                at, crc, size = (file, start), 0, 0
            data = line.encode() + b"\n"
            crc, size = zlib.crc32(data, crc), size + len(data)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["file_path", "block_start", "crc", "bytes"])
            out = []
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, crc, size)], ["file_path", "block_start", "crc", "bytes"])


def combine_checksums(pieces: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, crc32, bytes) of wholes, from (keys, order, crc, bytes) of their pieces.

    A checksum is linear over bits: each piece adds its own, carried over the bytes behind it. Those
    are a running sum over pieces, and the rest is an exclusive or that combines before the shuffle.
    """
    behind = F.coalesce(F.sum("bytes").over(W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    @F.arrow_udf("bigint")
    def carry(crc: pa.Array, length: pa.Array) -> pa.Array:
        return pa.array(carried(crc.to_numpy(zero_copy_only=False), length.to_numpy(zero_copy_only=False)).astype(np.int64))

    placed = pieces.withColumn("_behind", behind).withColumn("_part", carry(F.col("crc"), F.col("_behind")))
    return placed.groupBy(*keys).agg(F.bit_xor("_part").alias("crc32"), F.sum("bytes").alias("bytes"))


def text_checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_path, crc32, bytes) of the text of every file, packed ones unpacked, large plain ones in parallel spans.

    Lines end in one line feed each, as this library writes them. Empty files have no row.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start")
    )
    spans = lines.mapInArrow(span_checksums, "file_path string, block_start bigint, crc bigint, bytes bigint")
    return combine_checksums(spans, ["file_path"], "block_start")


# --- frequent items ---------------------------------------------------------------------------

HELD = 1 << 14  # different items a task holds at one time


def frequent_candidates(rows: DataFrame, keys: list[str], item: str, held: int = HELD) -> DataFrame:
    """(keys, item, low, error) from each task: items it may not rule out, with counts too low by ``error`` at most.

    A task holds ``held`` different (keys, item). When they run over, it subtracts the middle count
    from all and drops what is left without a count (Misra and Gries, many at a time). ``error`` is
    all a task has subtracted; an item it does not return has ``error`` rows there at most.
    """
    names = [*keys, item]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields) + ", low bigint, error bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, error = None, 0
        for batch in batches:
            new = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")]).rename_columns([*names, "low"])
            both = new if total is None else pa.concat_tables([total, new]).group_by(names, use_threads=False).aggregate([("low", "sum")]).rename_columns([*names, "low"])
            if both.num_rows > held:
                low = both.column("low").to_numpy()
                off = int(np.partition(low, len(low) - held // 2)[len(low) - held // 2])
                error += off
                both = both.set_column(len(names), "low", pa.array(low - off)).filter(pa.array(low > off))
            total = both
        if total is not None:
            out = total.append_column("error", pa.array(np.full(total.num_rows, error, np.int64)))
            # one more row carries the error of a task that dropped everything
            yield from out.to_batches()
            if not total.num_rows and error:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, out.schema.field(k).type) for k in range(len(names))], pa.array([0]), pa.array([error])], [*names, "low", "error"])

    return rows.select(*names).mapInArrow(run, schema)


def frequent_items(rows: DataFrame, keys: list[str], item: str, k: int, held: int = HELD) -> DataFrame:
    """(keys, item, n, rank): exactly the ``k`` commonest items of each key, ties by item.

    The first pass sends candidates only to the shuffle, whatever the number of different items. Their
    counts are then taken again exactly, in a join with the candidates. A key whose last rank is not
    above what an item that was ruled out could have is counted in full, so the result is exact for
    every key; for others no more than the candidates are shuffled. Null items are left out.
    """
    from metricloom.operators.counts import top_k, value_counts
    from metricloom.session import materialize

    some = rows.where(F.col(item).isNotNull()).select(*keys, item)
    # errors are those of tasks: each task's once, over all keys
    tagged = frequent_candidates(some, keys, item, held).withColumn("task", F.spark_partition_id())
    first = materialize(tagged, "frequent-candidates")
    ruled_out = first.groupBy("task").agg(F.max("error").alias("error")).agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]
    candidates = first.where(F.col(item).isNotNull()).select(*keys, item).distinct()
    counted = materialize(value_counts(some.join(candidates, [*keys, item], "left_semi"), keys, item), "frequent-counts")
    best = top_k(counted, keys, item, k)
    if not ruled_out:
        return best
    sure = best.groupBy(*keys).agg(F.min("n").alias("least"), F.count("*").alias("ranks")).where((F.col("least") > ruled_out) & (F.col("ranks") == k)).select(*keys)
    sure = materialize(sure, "frequent-sure")
    rest = top_k(value_counts(some.join(sure, keys, "left_anti"), keys, item), keys, item, k)
    return best.join(sure, keys, "left_semi").unionByName(rest)
