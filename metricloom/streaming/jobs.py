"""Structured Streaming forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from metricloom.functions.lines import parse_lines
from metricloom.operators import divergence as V
from metricloom.operators.counts import exact_quantiles
from metricloom.operators.dims import SOURCE, long_form, split_long
from metricloom.session import materialize, work_dir


def stream_lines(spark: SparkSession, path: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """Lines of files as they land, whatever moved them there."""
    return (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .text(path)
    )


def stream_parse(lines: DataFrame) -> DataFrame:
    """The batch parser's column expressions on a stream."""
    return parse_lines(lines)


def with_time(df: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds(ts)).withWatermark("event_time", late)


def delta_bins(points: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Sum of delta values per series and minute."""
    return (
        with_time(points.filter("is_delta"), late)
        .groupBy(F.window("event_time", "1 minute"), "series_id")
        .agg(F.sum("value").alias("delta_sum"), F.count("*").alias("n"))
        .select("series_id", F.unix_timestamp("window.start").alias("minute"), "delta_sum", "n")
    )


def tumbling_counts(points: DataFrame, size: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Lines and bytes per family and window."""
    return (
        with_time(points, late)
        .groupBy(F.window("event_time", size), "family_id")
        .agg(F.count("*").alias("lines"), F.sum("line_length").alias("bytes"))
        .select("family_id", F.unix_timestamp("window.start").alias("window_start"), "lines", "bytes")
    )


def sliding_counts(points: DataFrame, size: str = "5 minutes", step: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Counts per (window, family, dim, value); a window is emitted whole once it is closed."""
    return (
        long_form(with_time(points, late), "event_time", "family_id")
        .groupBy(F.window("event_time", size, step), "family_id", "dim", "value")
        .agg(F.count("*").alias("n"))
        .select("family_id", F.unix_timestamp("window.start").alias("window_start"), "dim", "value", "n")
    )


def score_windows(reference: dict[str, DataFrame], counts: DataFrame, min_samples: int = V.MIN_SAMPLES) -> DataFrame:
    """Scores of every (family, window) in ``counts`` against the family's reference."""
    keys = ["family_id", "window_start"]
    cur = split_long(counts)
    windows = (
        cur["dims"].filter(F.col("dim") == SOURCE).groupBy(*keys).agg(F.sum("n").alias("_n"))
        .filter(F.col("_n") >= min_samples).select(*keys)
    )
    # one row of quantiles for each window; the reference's values are not copied
    ref = {name: reference[name].join(windows, "family_id") for name in ("value_q", "size_q")}
    kept = {name: frame.join(windows, keys, "left_semi") for name, frame in cur.items()}
    kept["value_q"] = exact_quantiles(kept["values"], keys, "value")
    return V.score(ref, kept, keys, min_samples, js=V.js_windows(reference["dims"], kept["dims"], keys, ["family_id"]))


def start_to_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict[str, Any] | None = None
) -> StreamingQuery:
    """Start a resumable query into a parquet table; the same ``checkpoint`` goes on where it stopped.

    ``trigger`` is any trigger of Spark's writer, all input available now by default.
    """
    return (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def run_to_table(
    stream: DataFrame, name: str, mode: str = "append", state: dict[str, str] | None = None,
    path: str | None = None, checkpoint: str | None = None,
) -> tuple[DataFrame, list[dict[str, Any]]]:
    """Drain the available input into a parquet table; returns it with the query's progress.

    Without ``path`` and ``checkpoint`` a new table is begun. ``state`` holds settings the query
    reads when it starts; the session has its own again afterwards.
    """
    spark = stream.sparkSession
    path, checkpoint = path or work_dir(spark, name), checkpoint or work_dir(spark, name + "-checkpoint")
    with settings(spark, state or {}):
        query = start_to_table(stream, path, checkpoint, mode)
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), [p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a block."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def store_reference(reference: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    return {part: materialize(frame, f"{name}-{part}") for part, frame in reference.items()}


def run_scores(
    counts: DataFrame, reference: dict[str, DataFrame], name: str, min_samples: int = V.MIN_SAMPLES,
    path: str | None = None, checkpoint: str | None = None, trigger: dict[str, Any] | None = None, allow_late: bool = True,
    state: dict[str, str] | None = None, stored: bool = False,
) -> DataFrame:
    """Score closed windows batch by batch; resumes with the same ``path`` and ``checkpoint``.

    ``stored`` says that the reference has been written by :func:`store_reference`, as for runs that
    share one; else it is written here. The micro-batch id is part of the path, so a replayed batch
    overwrites its own rows. No closed window gives an empty table.
    """
    spark = counts.sparkSession
    path, checkpoint = path or work_dir(spark, name), checkpoint or work_dir(spark, name + "-checkpoint")

    fixed = reference if stored else store_reference(reference, name)

    closed = work_dir(spark, name + "-closed")
    # only the columns of the scores are asked for here, nothing is scored
    none = spark.createDataFrame([], score_windows(fixed, spark.createDataFrame([], counts.schema), min_samples).schema)
    none.write.mode("overwrite").parquet(f"{path}/batch=-1")

    def each(batch: DataFrame, batch_id: int) -> None:
        # the batch feeds several aggregations, so its closed windows are written once first
        part = f"{closed}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(part)
        # scored in the caller's session, where adaptive execution is on
        windows = spark.read.schema(batch.schema).parquet(part)
        if not windows.isEmpty():
            score_windows(fixed, windows, min_samples).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = counts.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
    with settings(spark, state or {}):
        query = writer.trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()
    late = dropped_late([p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress])
    if late and not allow_late:
        raise RuntimeError(f"{late} rows came behind the watermark")
    return spark.read.schema(none.schema).parquet(path)


LINES_PER_FILE = 4_000_000  # about 512 MB of text at 128 bytes a line


def land_capture(
    lines: DataFrame, path: str, checkpoint: str, every: str | None = "60 seconds", lines_per_file: int = LINES_PER_FILE
):
    """Land raw lines under dt/mig/instance as zstd parquet; files rotate by time and by size."""
    writer = (
        lines.writeStream.format("parquet").option("compression", "zstd")
        .option("path", path).option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", lines_per_file)
        .partitionBy("dt", "mig", "instance")
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


STREAK_SCHEMA = "family_id string, window_start bigint, status string, red_streak bigint, critical boolean, late boolean"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


class RedStreak(StatefulProcessor):
    """Consecutive red evaluations per family, in window order.

    A window that comes after a later one does not change the streak; it is returned as late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "streak bigint, last bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        streak, last = self.state.get() if self.state.exists() else (0, -1)
        # one row per closed window of this family, a handful per micro-batch
        batch = pd.concat(list(rows)).sort_values("window_start")
        out = []
        for start, status in zip(batch["window_start"], batch["status"]):
            late = start <= last
            if not late:
                streak = streak + 1 if status == "red" else 0
                last = int(start)
            out.append((key[0], int(start), status, int(streak), bool(streak >= V.CRITICAL_STREAK), bool(late)))
        self.state.update((int(streak), int(last)))
        yield pd.DataFrame(out, columns=["family_id", "window_start", "status", "red_streak", "critical", "late"])

    def close(self) -> None:
        pass


def red_streaks(scored: DataFrame) -> DataFrame:
    return scored.groupBy("family_id").transformWithStateInPandas(
        statefulProcessor=RedStreak(), outputStructType=STREAK_SCHEMA, outputMode="Append", timeMode="None"
    )


def dropped_late(progress: list[dict[str, Any]]) -> int:
    """Rows the watermark dropped, over all batches of a query."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", []))
