"""Capture files: compressed line objects under ``dt=/mig=/instance``, and their manifest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.schemas import MANIFEST

CAPTURE_GLOB = "*.{wf,wf.zst,wf.gz,txt,txt.gz,txt.zst}"


def scan_lines(spark: SparkSession, path: str, glob: str = CAPTURE_GLOB) -> DataFrame:
    """Lines of all capture files below ``path`` with file path, block start and order.

    ``line_no`` rises within a file block; it is not dense.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_no"),
        )
    )


def path_part(path: Column, name: str) -> Column:
    return F.regexp_extract(path, f"/{name}=([^/]+)/", 1)


def instance_of(path: Column) -> Column:
    """Instance folder: the one that holds the part file."""
    return F.regexp_extract(path, r"/(?:instance=)?([^/]+)/[^/]+$", 1)


def scan_layout(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``dt``, ``mig`` and ``instance`` from the object path.

    ``dt`` and ``mig`` come from partition discovery, so a filter on them prunes folders.
    """
    return (
        spark.read.option("basePath", path)
        .text(f"{path}/dt=*/mig=*/*")
        .select(
            "value", "dt", "mig",
            instance_of(F.col("_metadata.file_path")).alias("instance"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )


LINES_PER_FILE = 4_000_000  # about 512 MB of text at 128 bytes a line
PLACE = ["dt", "mig", "instance"]


def by_place(lines: DataFrame) -> DataFrame:
    """Lines of one place together, as far as a task can hold them.

    Adaptive execution splits a large place over as many tasks as its bytes ask for and joins small
    ones, so neither the number of places nor a hot one decides the parallelism.
    """
    return lines.select("value", *PLACE).hint("rebalance", *PLACE)


def sink_capture(lines: DataFrame, path: str, codec: str = "gzip", lines_per_file: int = LINES_PER_FILE) -> None:
    """Land lines as text under ``dt=/mig=/instance=``; columns dt, mig, instance, value."""
    by_place(lines).write.mode("append").option("compression", codec).option("maxRecordsPerFile", lines_per_file).partitionBy(
        *PLACE
    ).text(path)


def sink_lines_text(lines: DataFrame, path: str, codec: str = "gzip") -> None:
    lines.select("value").write.mode("append").option("compression", codec).text(path)


def file_manifest(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    """Size, ratio and checksums per landed file.

    ``binaryFile`` reads one file per row, which suits capture objects: their size is bounded by
    the rotation limit. Text sizes come from the lines, so compressed files are handled too.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
        .select(
            F.col("path").alias("object_name"),
            F.col("length").alias("compressed_size"),
            F.col("modificationTime").alias("timestamp"),
            F.crc32("content").alias("crc32"),
            F.sha2("content", 256).alias("sha256"),
        )
    )
    sizes = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path)
        .groupBy(F.col("_metadata.file_path").alias("_p"))
        .agg(F.sum(F.octet_length("value") + 1).alias("original_size"))
    )
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.join(sizes, bare(F.col("object_name")) == bare(F.col("_p")), "left").select(
        "object_name",
        F.coalesce("original_size", F.lit(0).cast("bigint")).alias("original_size"),
        "compressed_size",
        (F.col("original_size") / F.col("compressed_size")).alias("compression_ratio"),
        "timestamp",
        instance_of(F.col("object_name")).alias("instance_id"),
        path_part(F.col("object_name"), "mig").alias("zone"),
        "crc32",
        "sha256",
        path_part(F.col("object_name"), "dt").try_cast("date").alias("dt"),
    )


def append_manifest(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def volume(manifest: DataFrame) -> DataFrame:
    """Files, bytes, ratio and mean upload rate per instance and day."""
    seconds = F.greatest(F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp")), F.lit(1))
    return manifest.groupBy("dt", "instance_id").agg(
        F.count("*").alias("files"),
        F.sum("original_size").alias("original_bytes"),
        F.sum("compressed_size").alias("compressed_bytes"),
        (F.sum("original_size") / F.sum("compressed_size")).alias("compression_ratio"),
        (F.sum("compressed_size") / seconds).alias("bytes_per_second"),
    )


# A histogram header without an owner; a line whose second field is no tag, so it is no owner line.
HEADER = r"^\s*![MHD](\s+\d+)?\s+#\d+(\s+[^#\s]+\s+[^#\s]+)+\s*$"
NUMBERED = r"^\s*\S+\s+[^\s=]+(\s|$)"
NO_OWNER = r"^\s*($|[#!])|" + NUMBERED
PACKED = r"\.(gz|zst|bz2|deflate|lz4|snappy)$"  # such files are read by one task from end to end


def pair_in_span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order with headers joined to owners inside each file span.

    ``edge`` is 0 for finished lines, 1 for the first line of a later span, 2 for a header that ends
    a span, 3 for a line that is both. The last line of a batch waits for the next one.
    """
    names = ["value", "file_path", "block_start", "whole", "edge"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_()]
    held, before = None, None  # a line that may still find its owner; the span of the last line seen

    def work(value: pa.Array, file: pa.Array, block: np.ndarray, first: np.ndarray, more: bool):
        n = len(value)
        code = np.unique(file.to_numpy(zero_copy_only=False), return_inverse=True)[1] if n else np.empty(0, np.int64)
        same = np.append((code[1:] == code[:-1]) & (block[1:] == block[:-1]), False)  # as the next line
        header = pc.fill_null(pc.match_substring_regex(value, HEADER), False).to_numpy(zero_copy_only=False)
        owner = ~pc.fill_null(pc.match_substring_regex(value, NO_OWNER), True).to_numpy(zero_copy_only=False)
        takes = header & same & np.append(owner[1:], False)
        taken = np.append(False, takes[:-1])
        last = ~same & header & ~takes
        if more and n:
            last[-1] = False
        edge = (first & ~taken & (block > 0)) + 2 * last.astype(np.int8)
        if takes.any():
            at = np.flatnonzero(takes)
            both = pc.binary_join_element_wise(value.take(pa.array(at)), value.take(pa.array(at + 1)), "\n")
            value = pc.replace_with_mask(value, pa.array(takes), both)
        return value, edge.astype(np.int8), ~taken

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).cast(t) for k, t in enumerate(kinds)]
        block = rows[2].to_numpy()
        files = rows[1].to_numpy(zero_copy_only=False)
        first = np.append((files[0], block[0]) != before, (files[1:] != files[:-1]) | (block[1:] != block[:-1]))
        before = (files[-1], block[-1])
        if held is not None:
            rows = [pa.concat_arrays([a, b]) for a, b in zip(held[0], rows)]
            first = np.append(held[1], first)
        value, edge, keep = work(rows[0], rows[1], rows[2].to_numpy(), first, True)
        held = ([r.slice(len(r) - 1) for r in rows], first[-1:]) if keep[-1] else None
        keep[-1] = False
        out = pa.RecordBatch.from_arrays([value, *rows[1:], pa.array(edge)], names)
        yield out.filter(pa.array(keep))
    if held is not None:
        value, edge, _ = work(*held[0][:2], held[0][2].to_numpy(), held[1], False)
        yield pa.RecordBatch.from_arrays([value, *held[0][1:], pa.array(edge)], names)


def scan_paired_lines(spark: SparkSession, path: str, glob: str = CAPTURE_GLOB) -> DataFrame:
    """Lines of capture files with two-line histograms joined while they are read.

    Plain, gzip and zstd files alike. A task pairs the lines of the file spans it reads, so no raw
    line is shuffled. Only where a plain file is large enough to be read in several spans, the
    spans' first lines and closing headers, two lines a span at most, are set against each other.
    """
    sql = spark._jsparkSession.sessionState().conf()
    least = min(sql.filesMaxPartitionBytes(), sql.filesOpenCostInBytes())  # smaller files have one span
    whole = (F.col("_metadata.file_size") <= least) | F.col("_metadata.file_path").rlike(PACKED)
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)

    def paired(rows: DataFrame) -> DataFrame:
        spans = rows.select(
            "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), whole.alias("whole")
        )
        return spans.mapInArrow(pair_in_span, "value string, file_path string, block_start bigint, whole boolean, edge tinyint")

    body = paired(text).where("edge = 0 OR whole").select("value", "file_path", "block_start")
    edges = paired(text.where(~whole)).where("edge > 0")
    order = W.partitionBy("file_path").orderBy("block_start", F.expr("edge & 2"))
    firsts, ends = F.expr("edge & 1") == 1, F.expr("edge & 2") == 2
    owner = ~F.coalesce(F.col("_next").rlike(NO_OWNER), F.lit(True))
    around = edges.withColumns({
        "_next": F.first(F.when(firsts, F.col("value")), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)),
        "_prev": F.lag(F.when(ends, F.col("value"))).over(order),
    })
    taken = firsts & F.col("_prev").isNotNull() & ~F.coalesce(F.col("value").rlike(NO_OWNER), F.lit(True))
    joined = around.where(~taken).withColumn("value", F.when(ends & owner, F.concat_ws("\n", "value", "_next")).otherwise(F.col("value")))
    return body.union(joined.select(*body.columns))


def pair_two_line_histograms(lines: DataFrame, file: str = "file_path", block: str = "block_start", order: str = "line_no") -> DataFrame:
    """Join a histogram header with the owner line after it; other lines pass through.

    Order is only known inside a file. Rows are windowed per file block; where a block ends, the
    next block's first line comes from a summary with one row per block.
    """
    inside = W.partitionBy(file, block).orderBy(order)
    edges = (
        lines.groupBy(file, block)
        .agg(F.min_by("value", order).alias("_first"), F.max_by("value", order).alias("_last"))
        .withColumn("_after", F.lead("_first").over(W.partitionBy(file).orderBy(block)))
        .withColumn("_before", F.lag("_last").over(W.partitionBy(file).orderBy(block)))
        .select(file, block, "_before", "_after")
    )
    def is_header(c: str) -> Column:
        return F.coalesce(F.col(c).rlike(HEADER), F.lit(False))

    def is_owner(c: str) -> Column:
        return F.coalesce(
            (F.trim(c) != "") & ~F.trim(c).startswith("#") & ~F.trim(c).startswith("!") & ~F.col(c).rlike(NUMBERED), F.lit(False)
        )

    around = (
        lines.withColumn("_in_next", F.lead("value").over(inside))
        .withColumn("_in_prev", F.lag("value").over(inside))
        .join(edges, [file, block])
        .withColumn("_next", F.coalesce("_in_next", "_after"))
        .withColumn("_prev", F.coalesce("_in_prev", "_before"))
    )
    takes = is_header("value") & is_owner("_next")
    taken = is_owner("value") & is_header("_prev")
    return (
        around.filter(~taken)
        .withColumn("value", F.when(takes, F.concat_ws("\n", "value", "_next")).otherwise(F.col("value")))
        .drop("_in_next", "_in_prev", "_next", "_prev", "_before", "_after")
    )


def parse_point_strings(lines: DataFrame, column: str = "value") -> DataFrame:
    """Plain ``name value timestamp tag…`` points, fields split on single blanks."""
    parts = F.split(column, " ")
    return lines.select(
        *[c for c in lines.columns if c != column],
        parts[0].alias("name"),
        F.try_element_at(parts, F.lit(2)).try_cast("double").alias("point_value"),
        F.try_element_at(parts, F.lit(3)).try_cast("bigint").alias("timestamp"),
        F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))).alias("tag_list"),
    )
