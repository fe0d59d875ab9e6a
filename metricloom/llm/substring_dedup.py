"""Repeated passages by difference-cover anchors, extended to full windows.

Word runs are hashed only where a word's position modulo a period lies in a difference cover. For
any two equal windows some shift below the period brings both onto the cover, so the run hashed
there is the same: every repeat shares an anchor, and most positions are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.words import fresh, run_hashes, slices, words
from metricloom.session import materialize, scratch

c = F.col
WINDOW = 35
# Perfect difference sets: every non-zero remainder is the difference of two members.
COVERS = {31: (0, 1, 3, 8, 12, 18), 21: (0, 1, 4, 14, 16), 13: (0, 1, 3, 9), 7: (0, 1, 3), 3: (0, 1), 1: (0,)}
ANCHOR_PART = 0.4  # of a window that an anchor has at least; shorter ones repeat by chance


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length) with anchor + period - 1 <= window."""
    period = max(v for v in COVERS if window - v + 1 >= max(1, ANCHOR_PART * window))
    return period, COVERS[period], window - period + 1


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """Text under the 96-bit name that stands for it in all tables."""
    return docs.select(F.xxhash64(text).alias("t"), F.hash(text).alias("u"), c(text).alias("text")).where("text is not null")


def _within(w, length: int) -> np.ndarray:
    """Whether the run of ``length`` words from each word on stays in its text."""
    n = max(0, len(w.hash) - length + 1)
    last = np.repeat(w.first[1:], w.counts())[:n]
    return np.arange(n) + length <= last


def _position(w) -> np.ndarray:
    return np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts())


def anchors(texts: DataFrame, window: int, positions: bool) -> DataFrame:
    """(h, n) of anchors, counted per task, or (h, t, u, pos) of each."""
    period, cover, length = cover_for(window)
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                pos = _position(w)
                h = run_hashes(w.hash, length)
                long_enough = np.repeat(w.counts() >= window, w.counts())
                at = np.flatnonzero(in_cover[pos[: len(h)] % period] & _within(w, length) & long_enough[: len(h)])
                if positions:
                    row = np.repeat(np.arange(part.num_rows), w.counts())[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[at].view(np.int64)), part.column("t").take(pa.array(row)), part.column("u").take(pa.array(row)), pa.array(pos[at].astype(np.int32))],
                        ["h", "t", "u", "pos"],
                    )
                else:
                    value, n = np.unique(h[at], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(run, "h bigint, t bigint, u int, pos int" if positions else "h bigint, n bigint")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and where each row's list begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])


def windows(marked: DataFrame, window: int) -> DataFrame:
    """(w, x, t, u, pos) of every window that holds a repeated anchor; w and x make 96 bits."""
    period = cover_for(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                value, at = _lists(part.column("anchors"))
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                starts = (w.first[row] + value)[:, None] - np.arange(period)[None, :]
                here = np.zeros(len(w.hash) + 1, bool)
                here[starts[starts >= w.first[row][:, None]]] = True
                n = max(0, len(w.hash) - window + 1)
                good = np.flatnonzero(here[:n] & _within(w, window))
                first, second = run_hashes(w.hash, window)[good], run_hashes(w.hash, window, second=True)[good]
                row = pa.array(np.repeat(np.arange(part.num_rows), w.counts())[good])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        part.column("t").take(row), part.column("u").take(row), pa.array(_position(w)[good].astype(np.int32)),
                    ],
                    ["w", "x", "t", "u", "pos"],
                )

    return marked.mapInArrow(run, "w bigint, x int, t bigint, u int, pos int")


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(t, u, starts): first words of windows of each text that occur elsewhere, in it or in another row."""
    with scratch(docs.sparkSession):
        return _repeated(_texts(docs, text), window)


def _repeated(texts: DataFrame, window: int) -> DataFrame:
    repeated = anchors(texts, window, False).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    repeated = materialize(repeated, "repeat-anchors")
    held = anchors(texts, window, True).join(repeated, "h", "left_semi")
    # a set per text: copies of one text say the same, and are combined before the shuffle
    held = materialize(held.groupBy("t", "u").agg(F.collect_set("pos").alias("anchors")), "repeat-held")
    found = materialize(windows(texts.join(held, ["t", "u"]), window), "repeat-windows")
    several = found.groupBy("w", "x").agg(F.count("*").alias("n")).where("n > 1").select("w", "x")
    hits = found.join(several, ["w", "x"], "left_semi")
    return materialize(hits.groupBy("t", "u").agg(F.collect_set("pos").alias("starts")), "repeat-starts", keep=True)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, joined: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the text without its repeated words.

    Words are maximal runs of other bytes than ASCII white space. A word goes when a window of
    ``window`` words over it equals a window that starts anywhere else, in the same row or another;
    all windows are judged on the input, so of a passage no copy stays. ``kept`` joins the other
    words by one blank; with ``joined=False`` it is the text itself where nothing was removed, and
    otherwise the text with the removed stretches cut out.

    Null and empty texts have no words and an empty ``kept``. Repeated rows are repeats of each
    other. Existing columns of the three names are replaced; an empty table stays empty. Windows
    are compared by 96 bits of hash. A passage that fills a third of the table is a set of hot
    hashes, which are counted before the shuffle and met by a join that adaptive execution splits.
    """
    docs = docs.drop(*[x for x in ("n_words", "n_removed", "kept") if x != text])
    t, u, spots = fresh(docs.columns, "_t", "_u", "_starts")
    keyed = docs.withColumns({t: F.xxhash64(text), u: F.hash(text)})
    starts = repeated_windows(docs, text, window).select(c("t").alias(t), c("u").alias(u), c("starts").alias(spots))
    keyed = keyed.join(starts, [t, u], "left").select(*[c(f"`{x}`") for x in docs.columns], spots)
    keep = [f for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", n_words bigint, n_removed bigint, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                w = words(part.column(text))
                value, at = _lists(part.column(spots))
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                edge = np.zeros(len(w.hash) + 1, np.int64)
                begin = w.first[row] + value
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                kept = []
                raw = w.data.tobytes()
                original = part.column(text)
                for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
                    if not joined and removed[a] == removed[b]:
                        kept.append(original[k].as_py())
                    elif joined:
                        left = np.flatnonzero(~gone[a:b]) + a
                        kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[left].tolist(), w.end[left].tolist())]).decode())
                    else:
                        left = np.flatnonzero(np.diff(np.concatenate([[1], gone[a:b], [1]]).astype(np.int8)))
                        spans = zip(w.start[a + left[::2]].tolist(), w.end[a + left[1::2] - 1].tolist())
                        kept.append(b"\n".join([raw[s:e] for s, e in spans]).decode())
                made = [pa.array(w.counts()), pa.array(removed[w.first[1:]] - removed[w.first[:-1]]), pa.array(kept, pa.string())]
                rest = [part.column(f.name) for f in keep]
                yield pa.RecordBatch.from_arrays(rest + made, [f.name for f in keep] + ["n_words", "n_removed", "kept"])

    return keyed.mapInArrow(run, schema)
