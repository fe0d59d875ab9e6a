"""Ranked lexical search: impact lists and the Best Position Algorithm.

Documents stay where they are: every task builds impact lists of the documents it reads, a bounded
number of postings at a time, and searches them for all items of a block. A list holds the documents
of one term, highest impact first. Lists are read side by side; each document met is looked up in
every list of the item at once, and the places where it was found count as seen. What no list has
shown up to its best position, the end of its unbroken run of seen places, bounds all unseen
documents; the search stops when that bound is strictly below the score of the last rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from metricloom.llm.words import LOWER, NON_ALNUM, slices, words
from metricloom.session import materialize, scratch

c = F.col
FILTER_LOG2 = 24  # bits of the filter that lets query terms pass: 2 MiB whatever the query set
BLOCK_TERMS = 2_000_000  # (item, term) pairs searched for in one pass over the postings
SHARD_POSTINGS = 1 << 20  # postings in the lists of a task at one time
DEPTH = 16  # places read of each list at first; doubled from step to step
SCALE = 1_000_000_000  # fixed value: full impact of a term


def term_counts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, terms of each row with repeats, row of each distinct term, its hash, its count)."""
    for part in slices(batch, column):
        w = words(part.column(column), NON_ALNUM, LOWER)
        row = np.repeat(np.arange(part.num_rows), w.counts())
        order = np.lexsort((w.hash, row))
        row, term = row[order], w.hash[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))) if len(row) else np.empty(0, np.intp)
        yield part, w.counts(), row[first], term[first], np.diff(np.append(first, len(row)))


def _lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(row, item, terms): distinct term hashes of every item; rows are numbered to keep equal ids apart."""
    slim = items.select(c(f"`{key}`").alias("item"), c(f"`{text}`").alias("text"))
    schema = StructType([slim.schema["item"], StructField("terms", ArrayType(LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, row, term, _ in term_counts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("item"), _lists(row, part.num_rows, term.view(np.int64))], ["item", "terms"])

    found = slim.mapInArrow(run, schema)
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "search-items")


def place(term: np.ndarray) -> np.ndarray:
    """Place of a term's bit in the filter."""
    return (term >> np.uint64(64 - FILTER_LOG2)).astype(np.intp)


def term_filter(vocabulary: DataFrame) -> np.ndarray:
    """Bits of all query terms, of fixed size; other terms pass by chance and are found out later."""
    spots = vocabulary.select(F.shiftrightunsigned("term", 64 - FILTER_LOG2).alias("place"))
    by_byte = spots.groupBy(F.shiftright("place", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(place & 7 AS INT))")).alias("bits"))
    bits = np.zeros(1 << (FILTER_LOG2 - 3), np.uint8)
    for row in by_byte.toLocalIterator():  # at most one row for each byte of the filter
        bits[row["byte"]] = row["bits"]
    return bits


def document_terms(docs: DataFrame, key: str, text: str, bits: np.ndarray) -> DataFrame:
    """(doc, n, terms, counts) of every document: its length and those of its terms that pass the filter."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    slim = docs.select(c(f"`{key}`").alias("doc"), c(f"`{text}`").alias("text"))
    schema = StructType([slim.schema["doc"], StructField("n", LongType()), StructField("terms", ArrayType(LongType(), False)), StructField("counts", ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, row, term, count in term_counts(batch, "text"):
                at = place(term)
                good = held.value[at >> 3] >> (at & 7) & 1 == 1
                row, term, count = row[good], term[good], count[good]
                made = [pa.array(n.astype(np.int64)), _lists(row, len(n), term.view(np.int64)), _lists(row, len(n), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *made], schema.names)

    return slim.mapInArrow(run, schema)


def document_frequencies(found: DataFrame) -> DataFrame:
    """(term, df) of all terms in ``found``, combined per batch and task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "df"])

    return found.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """Impact lists of some documents; places in them, and direct access by list and document."""

    def __init__(self, docs: pa.Array, m: np.ndarray, row: np.ndarray, slot: np.ndarray, count: np.ndarray, slots: int):
        # documents are numbered in the order of their keys, which breaks ties
        order = pc.sort_indices(docs, null_placement="at_end")
        self.docs, self.size = docs.take(order), len(docs)
        number = np.empty(len(docs), np.int64)
        number[order.to_numpy()] = np.arange(len(docs))
        doc, impact = number[row], SCALE * count // (1000 * count + 8 * m[row])
        by_doc = np.lexsort((doc, slot))
        doc, impact, slot = doc[by_doc], impact[by_doc], slot[by_doc]
        self.entry = slot * self.size + doc  # ascending: direct access by binary search
        self.entry_impact = impact
        by_impact = np.lexsort((doc, -impact, slot))
        self.doc, self.impact = doc[by_impact], impact[by_impact]
        self.rank = np.empty(len(doc), np.int64)  # place in the lists of every entry
        self.rank[by_impact] = np.arange(len(doc))
        self.first = np.searchsorted(slot, np.arange(slots + 1))

    def best(self, slots: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, documents, direct accesses) of all that can be among the ``k`` best with a score of at least ``least``."""
        start, length = self.first[slots], self.first[slots + 1] - self.first[slots]
        some = (length > 0) & (weights > 0)
        slots, weights, start, length = slots[some], weights[some], start[some], length[some]
        offset = np.append(0, np.cumsum(length))
        seen = np.zeros(offset[-1] + 1, bool)
        known = np.zeros(self.size, bool)
        scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step, work = 0, DEPTH, 0
        while len(slots):
            # sorted access: the next places of every list
            take = np.clip(length - at, 0, step)
            where = np.repeat(start + at - (np.cumsum(take) - take), take) + np.arange(take.sum())
            new = np.unique(self.doc[where])
            new = new[~known[new]]
            known[new] = True
            # direct access: the new documents in all lists
            wanted = slots[:, None] * self.size + new[None, :]
            spot = np.searchsorted(self.entry, wanted)
            hit = self.entry[np.minimum(spot, len(self.entry) - 1)] == wanted
            work += wanted.size
            line, column = np.nonzero(hit)
            spot = spot[hit]
            total = np.zeros(len(new), np.int64)
            np.add.at(total, column, weights[line] * self.entry_impact[spot])
            seen[offset[line] + self.rank[spot] - start[line]] = True
            scores, found = np.append(scores, total), np.append(found, new)
            keep = np.lexsort((found, -scores))[:k]
            scores, found = scores[keep], found[keep]
            # best positions: the first unseen place of every list; what stands there bounds the unseen
            unseen = np.flatnonzero(~seen)
            front = unseen[np.searchsorted(unseen, offset[:-1])] - offset[:-1]
            open_ = front < length
            bound = int((weights[open_] * self.impact[start[open_] + front[open_]]).sum())
            kth = max(least, int(scores[-1])) if len(scores) == k else least
            if bound < kth or bound == 0 or not open_.any():
                break
            at, step = at + step, step * 2
        return scores, found, work


def search_block(found: DataFrame, block: list, texts: int, length: int, k: int) -> tuple[DataFrame, Broadcast]:
    """(row, doc, score): the ``k`` best documents of every task for every item of the block; and what is sent to tasks."""
    terms = np.unique(np.concatenate([np.asarray(r["terms"], np.int64) for r in block]))
    slots = [np.searchsorted(terms, np.asarray(r["terms"], np.int64)) for r in block]
    weights = [np.asarray(r["weights"], np.int64) for r in block]
    held = found.sparkSession.sparkContext.broadcast((terms, [r["row"] for r in block], slots, weights))
    kind = found.schema["doc"]
    schema = StructType([StructField("row", LongType()), kind, StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rows, slots, weights = held.value
        best: list[list] = [[] for _ in rows]  # (-score, key is null, key), best first
        parts: list[tuple] = []
        postings = 0

        def search() -> None:
            docs = pa.concat_arrays([p[0] for p in parts])
            row = np.concatenate([p[2] + before for p, before in zip(parts, np.cumsum([0, *[len(p[0]) for p in parts[:-1]]]))])
            shard = Shard(docs, *[np.concatenate([p[1] for p in parts])], row, *[np.concatenate([p[i] for p in parts]) for i in (3, 4)], len(terms))
            for i, top in enumerate(best):
                least = -top[-1][0] if len(top) == k else 1
                scores, where, _ = shard.best(slots[i], weights[i], k, least)
                good = scores >= least
                if good.any():
                    keys = shard.docs.take(pa.array(where[good])).to_pylist()
                    top += [(-int(s), key is None, key) for s, key in zip(scores[good], keys)]
                    top.sort(key=lambda t: t[:2] if t[1] else t)
                    del top[k:]
            parts.clear()

        for batch in batches:
            n = batch.column(1).to_pylist()
            # products past 64 bits are possible on very large tables, so in Python's integers
            m = np.array([10 + 90 * x * texts // length for x in n], np.int64)
            lists, term = batch.column(2), batch.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
            slot = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
            good = terms[slot] == term
            count = batch.column(3).flatten().to_numpy().astype(np.int64)
            parts.append((batch.column(0), m, row[good], slot[good], count[good]))
            postings += int(good.sum())
            if postings > SHARD_POSTINGS:
                search()
                postings = 0
        if parts:
            search()
        flat = [(r, key, -s) for r, top in zip(rows, best) for s, _, key in top]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat), (pa.int64(), parts_type, pa.int64()))], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    parts_type = to_arrow_type(kind.dataType)
    # small batches keep a list of postings near its bound
    return found.mapInArrow(run, schema), held


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score for each item, score above 0.

    Terms are runs of ASCII letters, digits and all code points from 128 on, A-Z lower-cased; null
    and empty texts have none. N counts documents with a term, L their terms with repeats. A term
    held by df documents weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); with n terms in the
    document, m = 10 + (90 * n * N) div L, and tf occurrences, it adds w * ((10^9 * tf) div (1000 * tf
    + 8 * m)). Every term of an item counts once. Equal scores rank by ascending key, nulls last.

    Rows of one key are documents, or items, of their own: repeated items give repeated ranks,
    repeated documents take a rank each. Items without a match, empty tables and other columns give
    no rows. Terms are compared by 64-bit hashes. All results are exact: a document is passed over
    only where its bound is strictly below the last rank.

    The documents are read once; postings of query terms are written and searched in blocks of
    items of bounded size, so memory depends on neither table.
    """
    spark = docs.sparkSession
    out_schema = StructType([StructField(item_key, items.schema[item_key].dataType), StructField("rank", IntegerType()), StructField(key, docs.schema[key].dataType), StructField("score", LongType())])
    with scratch(spark):
        asked = item_terms(items, item_key, item_text)
        pairs = asked.select("row", F.explode("terms").alias("term"))
        vocabulary = materialize(pairs.select("term").distinct(), "search-vocabulary")
        found = materialize(document_terms(docs, key, text, term_filter(vocabulary)), "search-postings")
        texts, length = found.agg(F.count_if(c("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not length:
            return spark.createDataFrame([], out_schema)
        df = document_frequencies(found).join(vocabulary, "term")
        weight = F.floor(1000 * F.log(F.lit(2.0 * texts + 2) / (2 * c("df") + 1))).cast("bigint")
        weighted = pairs.join(df.select("term", weight.alias("weight")), "term")
        weighted = weighted.groupBy("row").agg(F.collect_list(F.struct("term", "weight")).alias("t"), F.count("*").alias("size"))
        weighted = materialize(weighted.select("row", "size", c("t.term").alias("terms"), c("t.weight").alias("weights")), "search-weighted")
        blocks = -(-(weighted.agg(F.sum("size")).first()[0] or 0) // BLOCK_TERMS)
        done = []
        for b in range(blocks):
            rows = weighted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()
            if rows:
                scored, held = search_block(found, rows, texts, length, k)
                done.append(materialize(top_ranks(scored, k), f"search-block-{b}"))
                held.unpersist()  # tasks hold one block at a time
        if not done:
            return spark.createDataFrame([], out_schema)
        ranks = done[0]
        for more in done[1:]:
            ranks = ranks.union(more)
        named = ranks.join(asked.select("row", "item"), "row")
        out = named.select(c("item").alias(item_key), "rank", c("doc").alias(key), "score")
        return materialize(out, "search-ranks", keep=True)


def top_ranks(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each row; Spark keeps ``k`` per task before the shuffle."""
    by = W.partitionBy("row").orderBy(F.desc("score"), c("doc").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(by)).where(c("rank") <= k)
