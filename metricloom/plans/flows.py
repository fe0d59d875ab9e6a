"""Queries: Structured Streaming jobs drained over the given tables; their SQL is the batch form."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators import divergence as V
from metricloom.plans.aggregates import DELTA_SQL
from metricloom.plans.catalog import query
from metricloom.plans.comparison import ALERT_SQL, DAY_SECONDS, RETIRE, SCORED_SQL, STREAK_SQL, ref_profile
from metricloom.session import work_dir
from metricloom.sources import captures
from metricloom.sources import tables as t
from metricloom.streaming import jobs, stateful

c = F.col
FLUSH = 86400 * 400  # seconds past the newest row, enough to close every window


def event_stream(spark, d) -> DataFrame:
    """The events table as a file stream."""
    schema = t.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def read_back(spark, schema, path: str) -> DataFrame:
    """A file stream over all steps of a replay; every run takes what has come since as one batch."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


def replayed(points: DataFrame, name: str, run: Callable[[DataFrame], Any]) -> Any:
    """Run a resumable query over all rows, then again with one far-future row that closes every window.

    The rows are one micro-batch whatever number of files they fill: a watermark moves between
    batches only, so none of them can come behind it. The closing row follows in a second run on
    the same checkpoint.
    """
    spark = points.sparkSession
    path = work_dir(spark, name)
    points.write.parquet(f"{path}/step=1")
    run(read_back(spark, points.schema, path))
    # from the rows as written: the points are not made a second time for one row
    closing(spark.read.schema(points.schema).parquet(f"{path}/step=1")).write.parquet(f"{path}/step=2")
    return run(read_back(spark, points.schema, path))


def closing(points: DataFrame, steps: int = 1) -> DataFrame:
    return (
        points.orderBy(F.desc("ts")).limit(1)
        .withColumn("ts", c("ts") + FLUSH * steps).withColumn("family_id", F.lit("flush")).withColumn("series_id", F.lit("flush"))
        .withColumn("is_delta", F.lit(True))
    )


def replayed_table(points: DataFrame, name: str, build: Callable[[DataFrame], DataFrame], state: dict[str, str] | None = None) -> DataFrame:
    """The table a stateful stream leaves after a replay; fails if the watermark dropped a row."""
    out, checkpoint = work_dir(points.sparkSession, name), work_dir(points.sparkSession, name + "-checkpoint")

    def run(stream: DataFrame) -> DataFrame:
        table, progress = jobs.run_to_table(build(stream), name, state=state, path=out, checkpoint=checkpoint)
        if late := jobs.dropped_late(progress):
            raise RuntimeError(f"{late} rows came behind the watermark")
        return table

    return replayed(points, name + "-in", run)


@query("stream_lines", "SELECT line AS value FROM points")
def _(spark, d):
    path = work_dir(spark, "stream-in")
    captures.sink_lines_text(t.metric_lines(spark, d), path)
    out, _ = jobs.run_to_table(jobs.stream_lines(spark, path, "part-*"), "stream-lines")
    return out


@query("stream_parse", "SELECT family_id, metric, count(*) AS n, round(sum(value), 6) AS total FROM points GROUP BY ALL")
def _(spark, d):
    path = work_dir(spark, "stream-in")
    captures.sink_lines_text(t.metric_lines(spark, d), path)
    parsed = jobs.stream_parse(jobs.stream_lines(spark, path, "part-*")).select("family_id", "metric", "value")
    out, _ = jobs.run_to_table(parsed, "stream-parse")
    return out.groupBy("family_id", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "stream_land_capture",
    "SELECT strftime(to_timestamp(ts), '%Y-%m-%d') AS dt, 'tier-' || (row_id % 2) AS mig, count(*) AS n FROM points GROUP BY ALL",
)
def _(spark, d):
    p = t.points_from_events(event_stream(spark, d))
    lines = p.select(
        t.metric_text().alias("value"),
        F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("dt"),
        F.concat(F.lit("tier-"), (c("row_id") % 2).cast("string")).alias("mig"),
        F.lit("agent-0").alias("instance"),
    )
    path = work_dir(spark, "landed")
    jobs.land_capture(lines, path, work_dir(spark, "landed-checkpoint"), every=None).awaitTermination()
    back = spark.read.schema("value string, dt string, mig string, instance string").parquet(path)
    return back.groupBy("dt", "mig").agg(F.count("*").alias("n"))


@query("stream_delta_bin", DELTA_SQL)
def _(spark, d):
    out = replayed_table(t.with_series(t.points(spark, d)), "delta-bins", jobs.delta_bins)
    return out.filter(c("series_id") != "flush")


@query(
    "stream_tumbling_counts",
    "SELECT family_id, ts // 60 * 60 AS window_start, count(*) AS lines, CAST(sum(line_length) AS BIGINT) AS bytes FROM points GROUP BY ALL",
)
def _(spark, d):
    out = replayed_table(t.with_series(t.points(spark, d)), "tumbling", jobs.tumbling_counts)
    return out.filter(c("family_id") != "flush")


SLIDES = "(SELECT *, unnest(range(ts // 60 - 4, ts // 60 + 1)) * 60 AS window_start FROM dims)"


@query(
    "stream_sliding_dist",
    f"SELECT family_id, window_start, dim, value, count(*) AS n FROM {SLIDES} GROUP BY ALL",
)
def _(spark, d):
    """Five-minute windows every minute, put together from minute panes."""
    out = replayed_table(
        t.points(spark, d), "sliding", lambda p: stateful.pane_counts(p, 300, 60, "1 hour", numbers=False), jobs.ROCKSDB
    )
    return out.filter(c("family_id") != "flush")


SCORED = ["family_id", "ts", "source", "value", "line_length", "tags"]  # what windows are counted from


def scored_days(spark, d) -> DataFrame:
    """Daily windows of the current half, scored as they close."""
    ref, cur = t.reference_and_current(spark, d)
    path, checkpoint = work_dir(spark, "scores"), work_dir(spark, "scores-checkpoint")
    profile = jobs.store_reference(ref_profile(ref), "scores")

    def run(stream: DataFrame) -> DataFrame:
        # no filter on the closing row here: Spark would move it below the watermark, which then stands
        # still; the row's family never reaches the minimum number of samples anyway
        counts = jobs.sliding_counts(stream, "1 day", "1 day", "1 hour")
        return jobs.run_scores(counts, profile, "scores", path=path, checkpoint=checkpoint, allow_late=False, stored=True)

    return replayed(cur.select(*SCORED), "stream-scores", run)


@query(
    "stream_divergence",
    f"WITH {SCORED_SQL} SELECT family_id, window_start, n, round(js_categorical, 6) AS js_categorical, round(wasserstein, 6) AS wasserstein, round(ks_size, 6) AS ks_size, status FROM stat",
)
def _(spark, d):
    return scored_days(spark, d).select("family_id", "window_start", "n", "js_categorical", "wasserstein", "ks_size", "status")


MINUTE_SQL = """
    w AS (SELECT *, unnest(range(ts // 60 - 4, ts // 60 + 1)) * 60 AS window_start FROM curs),
    wd AS (SELECT family_id, window_start, dim, value, count(*) AS n FROM (
        SELECT *, unnest(range(ts // 60 - 4, ts // 60 + 1)) * 60 AS window_start FROM dims WHERE ts >= epoch(TIMESTAMP '2024-01-16')) GROUP BY ALL),
    wn AS (SELECT family_id, window_start, CAST(sum(n) AS BIGINT) AS n FROM wd WHERE dim = 'source' GROUP BY ALL),
    wp AS (SELECT family_id, window_start, dim, value, n / sum(n) OVER (PARTITION BY family_id, window_start, dim) AS q FROM wd),
    al AS (SELECT wp.*, coalesce(p, 0) AS p FROM wp LEFT JOIN rdims USING (family_id, dim, value)),
    rd AS (SELECT DISTINCT family_id, dim FROM rdims),
    jd AS (SELECT al.family_id, window_start, al.dim, any_value(rd.dim) IS NOT NULL AS in_ref, CASE WHEN any_value(rd.dim) IS NULL THEN 1.0 ELSE
        greatest(0.0, (sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + q * ln(q / ((p + q) / 2))) + ln(2) * greatest(0.0, 1 - sum(p))) / (2 * ln(2))) END AS js
        FROM al LEFT JOIN rd ON rd.family_id = al.family_id AND rd.dim = al.dim GROUP BY al.family_id, window_start, al.dim),
    jf AS (SELECT family_id, window_start, max(js) FILTER (dim = 'source') AS js_source,
        coalesce(sum(js) FILTER (dim LIKE 'tag:%' AND in_ref), 0) AS s, count(*) FILTER (dim LIKE 'tag:%' AND in_ref) AS met FROM jd GROUP BY ALL),
    tagged AS (SELECT family_id, count(*) AS tags FROM rd WHERE dim LIKE 'tag:%' GROUP BY family_id),
    jc AS (SELECT jf.family_id, window_start, (js_source + coalesce((s + tags - met) / tags, 0)) / 2 AS js_categorical FROM jf LEFT JOIN tagged USING (family_id)),
    wq AS (SELECT family_id, window_start, quantile_cont(value, [0.01, 0.05, 0.5, 0.95, 0.99]) AS v FROM w GROUP BY ALL),
    ws AS (SELECT wq.family_id, wq.window_start, (abs(rq.v[1] - wq.v[1]) + abs(rq.v[2] - wq.v[2]) + abs(rq.v[3] - wq.v[3]) + abs(rq.v[4] - wq.v[4]) + abs(rq.v[5] - wq.v[5])) / 5
        / CASE WHEN rq.v[5] > rq.v[1] THEN rq.v[5] - rq.v[1] ELSE 1 END AS wasserstein FROM wq JOIN rq ON rq.family_id = wq.family_id),
    wk AS (SELECT family_id, window_start, greatest(0.0, max(greatest(p - f_at, f_below - p))) AS ks_size FROM (
        SELECT w.family_id, w.window_start, p, avg(CASE WHEN line_length <= q THEN 1.0 ELSE 0 END) AS f_at, avg(CASE WHEN line_length < q THEN 1.0 ELSE 0 END) AS f_below
        FROM w JOIN (SELECT family_id, unnest(s) AS q, unnest([0.01, 0.05, 0.5, 0.95, 0.99]) AS p FROM rq) k ON k.family_id = w.family_id GROUP BY w.family_id, w.window_start, p, q) GROUP BY family_id, window_start)
    SELECT wn.family_id, wn.window_start, wn.n, round(js_categorical, 6) AS js_categorical, round(wasserstein, 6) AS wasserstein, round(ks_size, 6) AS ks_size,
        CASE WHEN coalesce(js_categorical > 0.05, false) OR coalesce(wasserstein > 0.1, false) OR coalesce(ks_size > 0.05, false) THEN 'red'
        WHEN coalesce(js_categorical > 0.025, false) OR coalesce(wasserstein > 0.05, false) OR coalesce(ks_size > 0.025, false) THEN 'amber' ELSE 'green' END AS status
    FROM wn LEFT JOIN jc USING (family_id, window_start) LEFT JOIN ws USING (family_id, window_start) LEFT JOIN wk USING (family_id, window_start)"""


@query("stream_divergence_minute", f"WITH {MINUTE_SQL}")
def _(spark, d):
    """Five-minute windows scored every minute; at this table's density a window is scored from one point on."""
    ref, cur = t.reference_and_current(spark, d)
    path, checkpoint = work_dir(spark, "minute-scores"), work_dir(spark, "minute-scores-checkpoint")
    profile = jobs.store_reference(ref_profile(ref), "minute-scores")

    def run(stream: DataFrame) -> DataFrame:
        counts = stateful.pane_counts(stream, 300, 60, "1 hour")
        return jobs.run_scores(counts, profile, "minute-scores", 1, path, checkpoint, allow_late=False, state=jobs.ROCKSDB, stored=True)

    out = replayed(cur.select(*SCORED), "minute-in", run)
    return out.filter(c("family_id") != "flush").select("family_id", "window_start", "n", "js_categorical", "wasserstein", "ks_size", "status")


def evaluated_days(spark, d) -> DataFrame:
    """Evaluations of scored days that arrive as a stream of their own; silent days by timers."""
    scored = scored_days(spark, d).select("family_id", "window_start", "status")
    path, out, checkpoint = (work_dir(spark, x) for x in ("scored", "evaluated", "evaluated-checkpoint"))
    scored.write.parquet(f"{path}/step=1")
    end = scored.agg((F.coalesce(F.max("window_start"), F.lit(0).cast("bigint")) + FLUSH).alias("window_start"))
    end = end.select(F.lit("flush").alias("family_id"), "window_start", F.lit("green").alias("status"))
    for step in (1, 2):
        if step == 2:
            end.write.parquet(f"{path}/step=2")
        stream = read_back(spark, scored.schema, path)
        table, _ = jobs.run_to_table(
            stateful.evaluations(stream, DAY_SECONDS, DAY_SECONDS, retire=RETIRE), "evaluated", state=jobs.ROCKSDB, path=out, checkpoint=checkpoint
        )
    return table.filter((c("family_id") != "flush") & ~c("late"))


@query("stream_red_streak", f"WITH {STREAK_SQL} SELECT family_id, window_start, status, red_streak, red_streak >= {V.CRITICAL_STREAK} AS critical FROM streaks")
def _(spark, d):
    """Streaks of red evaluations; a silent day ends one."""
    return evaluated_days(spark, d).drop("late")


@query("stream_alert_counts", ALERT_SQL)
def _(spark, d):
    return V.alert_counts(evaluated_days(spark, d), "window_start")


STEPS = 4
LATE_SECONDS = 3600


@query(
    "stream_late_rows",
    f"""WITH dealt AS (SELECT *, row_id * 7919 % {STEPS} AS step FROM points),
        mark AS (SELECT step, max(m) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATE_SECONDS} AS mark FROM (SELECT step, max(ts) AS m FROM dealt GROUP BY step))
        SELECT row_id, family_id, value, ts, coalesce(ts < mark, false) AS late, CASE WHEN ts < mark THEN mark - ts ELSE 0 END AS delay FROM dealt JOIN mark USING (step)""",
)
def _(spark, d):
    """Rows in shuffled files, one file set a batch: on-time and late rows together are the input."""
    p = t.points(spark, d).drop("tags")
    path, out, checkpoint = (work_dir(spark, x) for x in ("shuffled", "split", "split-checkpoint"))
    for step in range(STEPS):
        p.filter(c("row_id") * 7919 % STEPS == step).write.parquet(f"{path}/step={step}")
        stream = stateful.split_late(read_back(spark, p.schema, path), f"{LATE_SECONDS} seconds")
        table, progress = jobs.run_to_table(stream, "split", state=jobs.ROCKSDB, path=out, checkpoint=checkpoint)
        if jobs.dropped_late(progress):
            raise RuntimeError("a row was dropped")
    return table.select("row_id", "family_id", "value", "ts", "late", "delay")


@query(
    "stream_last_n_samples",
    "SELECT family_id, row_id, rank FROM (SELECT family_id, row_id, row_number() OVER (PARTITION BY family_id ORDER BY ts DESC, row_id DESC) AS rank FROM points) WHERE rank <= 10000",
)
def _(spark, d):
    """The newest 10,000 points of each family, kept as stream state over restarts."""
    p = t.points(spark, d).select("family_id", "ts", "row_id")
    path, out, checkpoint = (work_dir(spark, x) for x in ("samples", "newest", "newest-checkpoint"))
    order = ["ts", "row_id"]
    for step in range(STEPS):
        p.filter(c("row_id") * 7919 % STEPS == step).write.parquet(f"{path}/step={step}")
        stream = stateful.newest_rows(read_back(spark, p.schema, path), ["family_id"], order)
        table, _ = jobs.run_to_table(stream, "newest", "append", jobs.ROCKSDB, out, checkpoint)
    return stateful.latest_rows(table, ["family_id"], order).select("family_id", "row_id", "rank")


@query("stream_late_data", "SELECT count(*) AS lines_counted, count(*) FILTER (row_id % 10 = 0) AS late_lines, true AS some_dropped FROM points")
def _(spark, d):
    """Rows older than the watermark are dropped and counted.

    The first run holds everything, the second and third a closing row, the fourth a tenth of the
    rows again. A row is late when it is behind the watermark that the batch before last left, hence
    two closing rows.
    """
    p = t.with_series(t.points(spark, d))
    path, out, checkpoint = (work_dir(spark, x) for x in ("stream-late", "late", "late-checkpoint"))
    again = p.filter(c("row_id") % 10 == 0)
    dropped = 0
    for step, rows in enumerate([p, closing(p, 2), closing(p, 3), again]):
        rows.write.parquet(f"{path}/step={step}")
        stream = jobs.tumbling_counts(read_back(spark, p.schema, path), "1 day")
        table, progress = jobs.run_to_table(stream, "late", path=out, checkpoint=checkpoint)
        dropped += jobs.dropped_late(progress)
    counted = table.filter(c("family_id") != "flush").select("lines", F.lit(0).alias("staged"))
    staged = spark.read.schema(p.schema).parquet(*[f"{path}/step={k}" for k in (0, 3)]).select(F.lit(0), F.lit(1))
    total = counted.union(staged).agg(F.sum("lines").alias("lines_counted"), F.sum("staged").alias("staged"))
    return total.select("lines_counted", (c("staged") - c("lines_counted")).alias("late_lines"), F.lit(dropped > 0).alias("some_dropped"))
