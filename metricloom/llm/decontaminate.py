"""Benchmark leaks by verbatim pieces of items and exact edit checks.

An item of n words that may have e edits is cut into e + 1 pieces. Every edit touches one piece at
most, so a stretch of a document within e edits holds some piece word for word: looking up all runs
of words of the pieces' lengths misses no leak, whatever the length of the item.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.words import NON_ALNUM, run_hashes, slices, words

c = F.col
MAX_EDITS = 0.2  # word edits per word of the item
BLOCK_KEYS = 1 << 21  # words and pieces of one block of items; bounds what a task holds
SLOTS_PER_KEY = 32  # of the filter in front of the keys
HITS = 1 << 20  # pieces met that are looked at together, about
PAD = np.uint64(0)  # stands behind the last word of a text


@dataclass
class Pieces:
    """Pieces of ``length`` words of all items."""

    length: int
    filter: np.ndarray  # whether some key has these leading bits
    shift_bits: np.uint64
    keys: np.ndarray  # run hashes, sorted
    item: np.ndarray  # of each key
    shift: np.ndarray  # words of the item in front of the piece


def allowed_edits(n_words: int, max_edits: float) -> int:
    return min(int(max_edits * n_words), n_words - 1)


def index(items: list[np.ndarray], max_edits: float) -> list[Pieces]:
    """Pieces of items by length, over word hashes."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, values in enumerate(items):
        parts = allowed_edits(len(values), max_edits) + 1
        cuts = [i * len(values) // parts for i in range(parts + 1)]
        for low, high in zip(cuts, cuts[1:]):
            key = int(run_hashes(values[low:high], high - low)[0])
            found.setdefault(high - low, []).append((key, k, low))
    out = []
    for length, rows in sorted(found.items()):
        rows.sort()
        keys = np.array([r[0] for r in rows], np.uint64)
        width = (len(keys) * SLOTS_PER_KEY).bit_length()
        bits = np.zeros(1 << width, bool)
        bits[(keys >> np.uint64(64 - width)).astype(np.intp)] = True
        item, shift = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        out.append(Pieces(length, bits, np.uint64(64 - width), keys, item, shift))
    return out


def fit_ends(item: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, from) of the stretch closest to ``item`` by word edits that ends at each place of ``region``."""
    n = len(region)
    steps = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), steps.copy()
    for i, word in enumerate(item.tolist(), 1):
        change = cost[:-1] + (region != word)
        drop = cost[1:] + 1
        best = np.minimum(change, drop)
        came = np.where(change <= drop, begin[:-1], begin[1:])
        # insertions run left to right: the least of (best[j] - j) so far
        whole = np.concatenate([[i], best]) - steps
        from_ = np.concatenate([[0], came])
        low = np.minimum.accumulate(whole)
        source = np.maximum.accumulate(np.where(whole == low, steps, 0))
        cost, begin = low + steps, from_[source]
    return cost, begin


def fit_edits(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, from, to) of the stretch of ``region`` closest to ``item`` by word edits."""
    cost, begin = fit_ends(item, region)
    to = int(np.argmin(cost))
    return int(cost[to]), int(begin[to]), to


def apart(finds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, from, to) that overlap, the one with fewest edits, then the first; by rank."""
    kept: list[tuple[int, int, int]] = []
    begins: list[int] = []
    for edits, low, high in sorted(finds):
        at = bisect_left(begins, high)
        # those kept are apart, so only the last that begins before ``high`` can reach into it
        if at and kept[at - 1][2] > low:
            continue
        begins.insert(at, low)
        kept.insert(at, (edits, low, high))
    return kept


def hits(piece: Pieces, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, begin of the item if nothing is inserted or left out before) where runs are pieces."""
    runs = run_hashes(values, piece.length)
    maybe = np.flatnonzero(piece.filter[(runs >> piece.shift_bits).astype(np.intp)])
    low, high = np.searchsorted(piece.keys, runs[maybe], "left"), np.searchsorted(piece.keys, runs[maybe], "right")
    maybe, low, n = maybe[high > low], low[high > low], (high - low)[high > low]
    before = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(maybe):
        to = max(at + 1, int(np.searchsorted(before, before[at] + HITS, "right")) - 1)
        k = np.repeat(maybe[at:to], n[at:to])
        j = np.arange(before[at], before[to]) + np.repeat(low[at:to] - before[at:to], n[at:to])
        row = np.searchsorted(first, k, "right") - 1
        whole = k + piece.length <= end[row]
        yield row[whole], piece.item[j[whole]], k[whole] - piece.shift[j[whole]]
        at = to


def search(w, row_of_word: np.ndarray, pieces: list[Pieces], items: list[np.ndarray], max_edits: float) -> list[tuple]:
    """(row, item, edits, from word, to word) of every leak in the texts of ``w``."""
    n_texts = len(w.first) - 1
    # a pad behind every text
    values = np.full(len(w.hash) + n_texts, PAD, np.uint64)
    values[np.arange(len(w.hash)) + row_of_word] = w.hash
    first = w.first[:-1] + np.arange(n_texts)
    end = first + w.counts()
    sizes = np.array([len(x) for x in items])
    allowed = np.array([allowed_edits(n, max_edits) for n in sizes.tolist()])
    members: dict[int, set[int]] = {}
    stretches: dict[tuple[int, int], set[tuple[int, int]]] = {}
    finds: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for piece in pieces:
        for row, item, begin in hits(piece, values, first, end):
            lows = np.maximum(first[row], begin - allowed[item])
            highs = np.minimum(end[row], begin + sizes[item] + allowed[item])
            # an item without edits is its only piece
            for r, k, low, high in set(zip(row.tolist(), item.tolist(), lows.tolist(), highs.tolist())):
                if not allowed[k]:
                    if np.array_equal(values[low:high], items[k]):
                        finds.setdefault((r, k), []).append((0, low, high))
                    continue
                known = stretches.get((r, k))
                if known and (low, high) in known:
                    continue
                # every word of the item that the stretch lacks costs an edit
                if k not in members:
                    members[k] = set(items[k].tolist())
                if len(members[k].difference(values[low:high].tolist())) <= allowed[k]:
                    stretches.setdefault((r, k), set()).add((low, high))
    for (r, k), parts in stretches.items():
        joined: list[list[int]] = []
        for low, high in sorted(parts):
            if joined and low <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], high)
            else:
                joined.append([low, high])
        for low, high in joined:
            cost, begin = fit_ends(items[k], values[low:high])
            ends = np.flatnonzero(cost <= allowed[k])
            if len(ends):
                finds.setdefault((r, k), []).extend(zip(cost[ends].tolist(), (low + begin[ends]).tolist(), (low + ends).tolist()))
    out = []
    for (r, k), rows in finds.items():
        out += [(r, k, edits, low - int(first[r]), high - int(first[r])) for edits, low, high in apart(rows)]
    return out


def item_words(texts: list[str]) -> list[np.ndarray]:
    w = words(pc.utf8_lower(pa.array(texts, pa.string())), NON_ALNUM)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]


def item_blocks(items: DataFrame, key: str, text: str, max_edits: float) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Items in blocks whose keys a task can hold, read one block at a time."""
    ids, values, load = [], [], 0
    for row in items.select(c(key).cast("bigint").alias("key"), c(text).alias("text")).where("text is not null").toLocalIterator():
        hashes = item_words([row["text"]])[0]
        if not len(hashes):
            continue
        ids.append(row["key"])
        values.append(hashes)
        load += len(hashes) + allowed_edits(len(hashes), max_edits) + 1
        if load >= BLOCK_KEYS:
            yield ids, values
            ids, values, load = [], [], 0
    if ids:
        yield ids, values


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS
) -> DataFrame:
    """(key, item_key, edits, n_item_words, start_word, end_word) of benchmark items found in documents.

    Words are lower-cased runs of letters and digits. An item is found where a stretch of the
    document's words can be turned into it by at most ``max_edits`` times its length of word
    insertions, deletions and changes, rounded down, so items of under five words are found word
    for word. Every such stretch is found, whatever the length of the item; of finds of one item
    that overlap, the one with fewest edits is given. Null and empty texts have no leaks; items
    without words are found nowhere; repeated rows repeat theirs; no item or document, no row.

    The items are a query set: they are read in blocks of bounded size, and every block goes
    through all documents in one map-only pass, so nothing of the documents is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` bigint, edits int, n_item_words int, start_word bigint, end_word bigint"
    slim = docs.select(c(key), c(text).alias("_text"))
    spark = docs.sparkSession
    out = None
    for ids, values in item_blocks(items, item_key, item_text, max_edits):
        held = spark.sparkContext.broadcast((ids, values))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, values = held.value
            pieces = None
            for batch in batches:
                for part in slices(batch, "_text"):
                    pieces = pieces or index(values, max_edits)
                    w = words(pc.utf8_lower(part.column("_text")), NON_ALNUM)
                    row_of_word = np.repeat(np.arange(part.num_rows), w.counts())
                    leaks = search(w, row_of_word, pieces, values, max_edits)
                    row, item, edits, low, high = (list(x) for x in zip(*leaks)) if leaks else ([], [], [], [], [])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(key).take(pa.array(row, pa.int64())), pa.array([ids[i] for i in item], pa.int64()), pa.array(edits, pa.int32()),
                            pa.array([len(values[i]) for i in item], pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                        ],
                        [key, item_key, "edits", "n_item_words", "start_word", "end_word"],
                    )

        found = slim.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)
