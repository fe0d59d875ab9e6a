"""Stateful stream operators: minute panes, newest samples, late rows, evaluations with timers.

All of them keep their state in Spark's state store, keyed finely enough that a hot family is spread
over tasks, and resume from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from metricloom.operators import divergence as V
from metricloom.operators.dims import SOURCE, TAG, long_form

c = F.col
WAYS = 16  # slices of one (family, dimension), by value
PIECE = 10_000  # counts held in one state entry


def combine_batches(rows: DataFrame) -> DataFrame:
    """Equal rows of an Arrow batch as one row with their number ``n``: fewer rows reach the shuffle."""
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")])
            yield from counts.select([*names, "count_all"]).rename_columns([*names, "n"]).to_batches()

    return rows.mapInArrow(run, schema)


class Panes(StatefulProcessor):
    """Counts per pane of one key; windows are put together from panes once they are closed.

    A pane is as wide as the step from window to window, so a row is kept once whatever number of
    windows it falls into. One timer per key stands at the end of the earliest window still open.
    Counts of all panes lie together in pieces of bounded size, so the number of state entries
    follows the counts held and not the number of panes. Rows of a pane go when its last window has
    been returned.
    """

    def __init__(self, size: int, step: int, piece: int = PIECE):
        if size % step:
            raise ValueError("a window must be a whole number of steps")
        self.size, self.step, self.piece = size, step, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "piece bigint", "rows binary")
        # the timer, the number of the newest piece and its size; there while rows are held
        self.book = handle.getValueState("book", "timer bigint, piece bigint, held bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        timer, piece, held = self.book.get() if self.book.exists() else (None, 0, 0)
        parts, fresh, first = [], 0, None
        if held >= self.piece:
            piece = piece + 1
        elif held:
            parts = [self.unpack(*self.pieces.getValue((piece,)))]
        for frame in rows:
            first = int(frame["pane"].min()) if first is None else min(first, int(frame["pane"].min()))
            parts.append(frame[["pane", "value", "n"]])
            fresh += len(frame)
            if fresh >= 4 * self.piece:
                piece, last = self.keep(parts, piece)
                parts, fresh = [last], 0
        if first is not None:
            piece, last = self.keep(parts, piece)
            # windows that ended before have been returned without this pane, which only began later
            self.wait(first + self.step, timer, piece, len(last), timerValues)
        yield from ()

    @staticmethod
    def pack(rows: pd.DataFrame) -> bytes:
        """A piece as one Arrow stream: state calls carry bytes, not single values."""
        columns = [pa.array(rows["pane"].to_numpy("int64")), pa.array(rows["value"].to_numpy(object), pa.string(), from_pandas=True), pa.array(rows["n"].to_numpy("int64"))]
        table = pa.table(columns, names=["pane", "value", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpack(rows: bytes) -> pd.DataFrame:
        table = pa.ipc.open_stream(bytes(rows)).read_all()
        return pd.DataFrame({"pane": table["pane"].to_numpy(), "value": pd.Series(table["value"].to_pylist(), dtype=object), "n": table["n"].to_numpy()})

    def keep(self, parts: list[pd.DataFrame], piece: int) -> tuple[int, pd.DataFrame]:
        """Counts in order of their panes as pieces from number ``piece`` on; returns the last one."""
        rows = pd.concat(parts).groupby(["pane", "value"], sort=False, dropna=False, as_index=False)["n"].sum().sort_values("pane", kind="stable")
        for at in range(0, len(rows), self.piece):
            last = rows.iloc[at : at + self.piece]
            self.pieces.updateValue((piece + at // self.piece,), (self.pack(last),))
        return piece + (len(rows) - 1) // self.piece, last

    def wait(self, end: int, old: int | None, piece: int, held: int, timerValues: Any) -> None:
        """One timer at most: at ``end``, unless that is past or an earlier one stands."""
        closed = timerValues.getCurrentWatermarkInMs() // 1000
        new = max(end, closed // self.step * self.step + self.step) * 1000
        if old is None or new < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        else:
            new = old
        self.book.update((new, piece, held))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        timer, piece, size = self.book.get() if self.book.exists() else (None, 0, 0)
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return  # replaced by an earlier one since
        closed = timerValues.getCurrentWatermarkInMs() // 1000
        held = {k: self.unpack(*v) for (k,), v in self.pieces.iterator()}
        for starts, names, counts in self.windows(pd.concat(held.values()), timer // 1000, closed):
            yield pd.DataFrame({"family_id": key[0], "window_start": starts, "dim": key[1], "value": names, "n": counts})
        left = {k: rows[rows["pane"] + self.size > closed] for k, rows in held.items()}
        if not any(len(rows) for rows in left.values()):
            self.pieces.clear()
            self.book.clear()
            return
        for k, rows in left.items():
            if not len(rows):
                self.pieces.removeKey((k,))
            elif len(rows) < len(held[k]):
                self.keep([rows], k)
        # the next rows begin a new piece if the newest one has gone
        self.wait(int(min(rows["pane"].min() for rows in left.values() if len(rows))) + self.step, None, piece, len(left.get(piece, ())) or self.piece, timerValues)

    def windows(self, rows: pd.DataFrame, since: int, closed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts, values and counts of all windows that end from ``since`` to ``closed``, some thousand panes' counts at a time."""
        rows = rows.sort_values("pane", kind="stable")
        panes, counts = rows["pane"].to_numpy("int64"), rows["n"].to_numpy("int64")
        codes, names = pd.factorize(rows["value"].to_numpy(object), use_na_sentinel=False)
        names = np.array([x if isinstance(x, str) else None for x in names], dtype=object)
        edges = [panes[0] - self.size, *np.unique(panes[self.piece :: self.piece]).tolist(), panes[-1] + self.step]
        for low, high in zip(edges, edges[1:]):
            a, b = np.searchsorted(panes, [low, high + self.size - self.step])
            starts = panes[a:b, None] - np.arange(0, self.size, self.step)
            within = (starts >= low) & (starts < high) & (starts + self.size >= since) & (starts + self.size <= closed)
            row, _ = np.nonzero(within)
            if not len(row):
                continue
            order = np.lexsort((code := codes[a:b][row], start := starts[within]))
            start, code = start[order], code[order]
            new = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (code[1:] != code[:-1])])
            yield start[new], names[code[new]], np.add.reduceat(counts[a:b][row[order]], new)

    def close(self) -> None:
        pass


def pane_counts(points: DataFrame, size: int = 300, step: int = 60, late: str = "2 minutes", ways: int = WAYS, numbers: bool = True) -> DataFrame:
    """Counts per (family, window_start, dim, value) of windows of ``size`` seconds every ``step`` seconds.

    Rows are counted per batch first, then by (family, dim, slice of the value), so neither a hot
    family nor a common value gathers in one task. Each slice returns its own values, and no value
    is in two. The watermark runs on pane starts. Without ``numbers`` there are source and tags only.
    """
    pane = (F.floor(c("ts") / step) * step).cast("bigint").alias("pane")
    rows = long_form(points.select("family_id", pane, "source", "value", "line_length", "tags"), "family_id", "pane")
    counted = combine_batches(rows if numbers else rows.filter((c("dim") == SOURCE) | c("dim").startswith(TAG)))
    timed = counted.withColumn("pane_time", F.timestamp_seconds("pane")).withWatermark("pane_time", late)
    return (
        timed.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(ways))).groupBy("family_id", "dim", "slice")
        .transformWithStateInPandas(
            statefulProcessor=Panes(size, step, PIECE), outputStructType="family_id string, window_start bigint, dim string, value string, n bigint",
            outputMode="Append", timeMode="EventTime",
        )
    )


class Newest(StatefulProcessor):
    """The newest ``k`` rows of one key, as a list that is cut back when it has doubled.

    Frames and state hold all columns but the grouping ones.
    """

    def __init__(self, k: int, keys: list[str], order: list[str], schema: StructType, ttl: int | None):
        self.k, self.keys, self.order, self.schema, self.ttl = k, keys, order, schema, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema, self.ttl)
        self.size = handle.getValueState("size", "held bigint, batch bigint", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        fresh = None
        for frame in rows:
            frame = frame[names]
            fresh = self.cut(frame if fresh is None else pd.concat([fresh, frame]))
        held, batch = self.size.get() if self.size.exists() else (0, 0)
        old = pd.DataFrame(list(self.rows.get()), columns=names) if held else None
        both = fresh if old is None or old.empty else self.cut(pd.concat([old.astype(fresh.dtypes.to_dict()), fresh]))
        if held + len(fresh) > 2 * self.k:
            self.rows.put(self.plain(both))
            held = len(both)
        else:
            self.rows.appendList(self.plain(fresh))
            held += len(fresh)
        self.size.update((held, batch + 1))
        yield both.assign(**dict(zip([*self.keys, "slice"], key)), batch=batch + 1)

    def cut(self, frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) <= self.k:
            return frame
        return frame.sort_values(self.order, ascending=False, kind="stable").head(self.k)

    @staticmethod
    def plain(frame: pd.DataFrame) -> list[tuple]:
        return [tuple(None if pd.isna(x) else x for x in row) for row in frame.astype(object).itertuples(index=False)]

    def close(self) -> None:
        pass


def newest_rows(stream: DataFrame, keys: list[str], order: list[str], k: int = 10_000, ttl: int | None = None, ways: int = WAYS) -> DataFrame:
    """The newest ``k`` rows of every slice that a batch touched, with ``slice`` and ``batch``.

    A key's rows are dealt over ``ways`` slices by the last column of ``order``, which should tell
    rows of one time apart; the newest of all are among those of the slices (:func:`latest_rows`).
    Columns are plain values. ``ttl`` milliseconds after its last change a row is forgotten; Spark then
    runs on processing time and never finds all input available, so such a stream wants a trigger
    by time.
    """
    schema = StructType([f for f in stream.schema.fields if f.name not in keys])
    out = StructType([*stream.schema.fields, StructField("slice", LongType()), StructField("batch", LongType())])
    return (
        stream.withColumn("slice", F.pmod(F.xxhash64(order[-1]), F.lit(ways))).groupBy(*keys, "slice")
        .transformWithStateInPandas(
            statefulProcessor=Newest(k, keys, order, schema, ttl), outputStructType=out, outputMode="Append", timeMode="ProcessingTime" if ttl else "None",
        )
    )


def latest_rows(table: DataFrame, keys: list[str], order: list[str], k: int = 10_000) -> DataFrame:
    """The newest ``k`` rows of each key after all batches in ``table``, with ``rank``."""
    last = table.groupBy(*keys, "slice").agg(F.max("batch").alias("batch"))
    now = table.join(last, [*keys, "slice", "batch"])
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(x) for x in order]))
    return now.withColumn("rank", rank).where(c("rank") <= k).drop("slice", "batch")


class Split(StatefulProcessor):
    """Rows with whether they came behind the watermark, and by how much; keeps no state."""

    def __init__(self, ts: str):
        self.ts = ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            behind = mark - frame[self.ts] * 1000
            yield frame.assign(late=behind > 0, delay=(behind.clip(lower=0) / 1000).astype("int64"))

    def close(self) -> None:
        pass


def split_late(stream: DataFrame, late: str, ts: str = "ts", ways: int = 64) -> DataFrame:
    """Every row of the stream with ``late`` and ``delay`` (seconds behind the watermark, else 0).

    The watermark follows ``ts`` (epoch seconds) but the event time itself does not reach the
    stateful step, so Spark hands it all rows instead of dropping the late ones. Rows are dealt by
    hash, whatever their family.
    """
    timed = stream.withColumn("_event_time", F.timestamp_seconds(ts)).withWatermark("_event_time", late)
    dealt = timed.select(*[c(f"`{x}`") for x in stream.columns], F.pmod(F.xxhash64(*[c(f"`{x}`") for x, kind in stream.dtypes if not kind.startswith("map")]), F.lit(ways)).alias("_slice"))
    out = StructType([*stream.schema.fields, StructField("late", BooleanType()), StructField("delay", LongType())])
    return dealt.groupBy("_slice").transformWithStateInPandas(
        statefulProcessor=Split(ts), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


EVALUATION = "family_id string, window_start bigint, status string, red_streak bigint, critical boolean, late boolean"


class Evaluations(StatefulProcessor):
    """One evaluation per family and step, also where the family was silent.

    After each evaluation a timer stands at the end of the next window. If the watermark gets there
    without a score, the family is ``insufficient`` for that window and its streak ends. After
    ``retire`` silent steps in a row the timer goes and the family is not evaluated until it returns.
    A window that comes after a later evaluation changes nothing and is returned as late.
    """

    def __init__(self, size: int, step: int, retire: int):
        self.size, self.step, self.retire = size, step, retire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("family", "streak bigint, last bigint, silent bigint, timer bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        streak, last, silent, timer = self.state.get() if self.state.exists() else (0, None, 0, None)
        # scored windows of one family in one batch: one row per step
        batch = pd.concat(list(rows)).sort_values("window_start")
        out: list[tuple] = []
        for start, status in zip(batch["window_start"].tolist(), batch["status"]):
            late = last is not None and start <= last
            if not late:
                if last is not None:
                    silent = self.silence(key[0], last, silent, start, out)
                # silence of any length ends a streak
                gap = last is not None and start > last + self.step
                streak = (1 if gap else streak + 1) if status == V.RED else 0
                last, silent = start, 0
            out.append((key[0], start, status, streak, streak >= V.CRITICAL_STREAK, late))
        self.keep(streak, last, silent, timer)
        yield self.frame(out)

    def silence(self, family: str, last: int, silent: int, before: int, out: list[tuple]) -> int:
        """Add evaluations of the windows from ``last`` on that start before ``before``; returns the silent steps so far."""
        start = last + self.step
        while start < before and silent < self.retire:
            out.append((family, start, V.INSUFFICIENT, 0, False, False))
            start, silent = start + self.step, silent + 1
        return silent

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        streak, last, silent, timer = self.state.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return  # set anew since
        closed = timerValues.getCurrentWatermarkInMs() // 1000
        out: list[tuple] = []
        silent = self.silence(key[0], last, silent, closed - self.size + 1, out)
        if silent >= self.retire:
            self.state.update((0, last + len(out) * self.step, silent, None))
        else:
            self.keep(0 if out else streak, last + len(out) * self.step, silent, None)
        if out:
            yield self.frame(out)

    def keep(self, streak: int, last: int, silent: int, timer: int | None) -> None:
        new = (last + self.step + self.size) * 1000
        if timer is not None and timer != new:
            self.handle.deleteTimer(timer)
        if timer != new:
            self.handle.registerTimer(new)
        self.state.update((streak, last, silent, new))

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["family_id", "window_start", "status", "red_streak", "critical", "late"])

    def close(self) -> None:
        pass


def evaluations(scored: DataFrame, size: int, step: int, late: str = "0 seconds", retire: int = 60) -> DataFrame:
    """Evaluations of a stream of scored windows (family_id, window_start, status), silent ones included.

    Time is the end of the windows: when it has moved past a window's end by ``late``, families
    without a score for it count as silent.
    """
    timed = scored.select("family_id", "window_start", "status", F.timestamp_seconds(c("window_start") + size).alias("_end")).withWatermark("_end", late)
    return timed.select("family_id", "window_start", "status").groupBy("family_id").transformWithStateInPandas(
        statefulProcessor=Evaluations(size, step, retire), outputStructType=EVALUATION, outputMode="Append", timeMode="EventTime"
    )
