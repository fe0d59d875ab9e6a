"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard checks.

Two permutations make every signature: sigma scatters a set's elements over 2**32 places, and the
k-th coordinate is the smallest value of pi at the places shifted by k around the circle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.components import components
from metricloom.llm.words import LOWER, mix64, run_hashes, slices, words
from metricloom.session import materialize, scratch

c = F.col
BANDS, ROWS = 32, 5  # a pair of Jaccard 0.8 shares no band three times in a million
COORDINATE_BYTES = 2  # low bits of a coordinate; equal ones by chance only add candidates
CENTRES = 4  # members of a group that the others are compared with in the second round
LIKELY = 0.174  # a pair this far below the similarity by signature (5.5 deviations) is not compared
LARGE_GROUP = 64  # members of larger leftover groups are paired by an exact prefix filter
ORDER_LOG2 = 18  # counters that order its elements
BLOCK = 1 << 15  # coordinates computed at once


def signature(elements: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` coordinates of a non-empty set of 64-bit elements."""
    # sigma; then pi, a bijection of 32-bit values, at every place shifted by 0 .. size - 1
    place = (mix64(elements ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[None, :]
    step = max(1, BLOCK // size)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    x = np.empty((min(step, len(place)), size), np.uint32)
    y = np.empty_like(x)
    for at in range(0, len(place), step):
        part = place[at : at + step, None]
        value, high = x[: len(part)], y[: len(part)]
        np.add(part, shift, out=value)
        np.multiply(value, np.uint32(0x9E3779B1), out=value)
        np.right_shift(value, np.uint32(15), out=high)
        np.bitwise_xor(value, high, out=value)
        np.multiply(value, np.uint32(0x85EBCA77), out=value)
        np.minimum(out, value.min(axis=0), out=out)
    return out


def shingle_sets(texts: pa.Array, length: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one element."""
    w = words(texts, table=LOWER)
    runs = run_hashes(w.hash, length)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= length:
            yield np.unique(runs[a : b - length + 1])
        elif b > a:
            yield run_hashes(w.hash[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.empty(0, np.uint64)


def signatures(docs: DataFrame, text: str, length: int) -> DataFrame:
    """Every column of ``docs`` but its text, with n_shingles, a set fingerprint and a signature."""
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", n_shingles bigint, fp bigint, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                n, fp, sig = [], [], []
                for elements in shingle_sets(part.column(text), length):
                    n.append(len(elements))
                    if len(elements):
                        mixed = mix64(elements)
                        whole = np.array([mixed.sum(), np.bitwise_xor.reduce(mixed)], np.uint64)
                        fp.append(int(mix64(whole[:1] * np.uint64(3) ^ mix64(whole[1:] + np.uint64(n[-1])))[0].view(np.int64)))
                        sig.append(signature(elements).astype("<u2").tobytes())
                    else:
                        fp.append(None)
                        sig.append(None)
                rest = [part.column(f.name) for f in keep]
                made = [pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(rest + made, [f.name for f in keep] + ["n_shingles", "fp", "sig"])

    return docs.mapInArrow(run, schema)


def band_keys(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, node) for each band of each set."""
    width = rows * COORDINATE_BYTES
    part = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.xxhash64(j, F.substring("sig", j * width + 1, F.lit(width))))
    return sets.select("node", F.explode(part).alias("key"))


def prefix_pairs(texts: DataFrame, length: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that an exact prefix filter cannot rule out.

    ``texts`` has node, component and text. Elements are put in one order, rare ones first. Sets
    that reach the similarity share an element among the first ones of both, and the places of the
    first shared one bound what they can share at all. So of a crowd of copies, each with rare
    changes of its own, only those that changed little meet. The order comes from counts in a table
    of fixed size; any order would give the same pairs in the end.
    """
    spark = texts.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_LOG2, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for elements in shingle_sets(part.column("text"), length):
                    np.add.at(total, (elements >> np.uint64(64 - ORDER_LOG2)).astype(np.intp), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    counts = np.zeros(1 << ORDER_LOG2, np.int64)
    for row in texts.select("text").mapInArrow(tally, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[row["slot"]] = row["n"]
    held = spark.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, element, place, size, index = [], [], [], [], []
                for k, elements in enumerate(shingle_sets(part.column("text"), length)):
                    n = len(elements)
                    order = np.lexsort((elements, held.value[(elements >> np.uint64(64 - ORDER_LOG2)).astype(np.intp)]))
                    probe = n - -(-percent * n // 100) + 1  # against smaller sets
                    short = n - -(-2 * percent * n // (100 + percent)) + 1  # against sets as large or larger
                    chosen = elements[order[:probe]]
                    row += [k] * len(chosen)
                    element.append(chosen)
                    place.append(np.arange(len(chosen)))
                    size += [n] * len(chosen)
                    index.append(np.arange(len(chosen)) < short)
                flat = np.concatenate(element) if element else np.empty(0, np.uint64)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(flat.view(np.int64)), part.column("node").take(row), part.column("component").take(row), pa.array(size, pa.int64()),
                        pa.array(np.concatenate(place) if place else [], pa.int64()), pa.array(np.concatenate(index) if index else [], pa.bool_()),
                    ],
                    ["key", "node", "component", "size", "place", "short"],
                )

    schema = "key bigint, node bigint, component bigint, size bigint, place bigint, short boolean"
    heads = materialize(texts.mapInArrow(first, schema), "minhash-heads")
    x = outside(heads).select("key", *[c(k).alias(f"x_{k}") for k in heads.columns if k != "key"])
    # the smaller set of a pair, by size and then by node, shows its short head
    smaller = (c("x_size") < c("size")) | ((c("x_size") == c("size")) & (c("x_node") < c("node")))
    shared = F.least(c("x_size") - c("x_place"), c("size") - c("place"))
    least, most = F.least("x_size", "size"), F.greatest("x_size", "size")
    fits = (
        (c("x_component") != c("component")) & F.when(smaller, c("x_short")).otherwise(c("short"))
        & (least * 100 >= most * percent) & (shared * (100 + percent) >= (c("x_size") + c("size")) * percent)
    )
    return x.join(heads, (x["key"] == heads["key"]) & fits).select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b"))


def outside(members: DataFrame) -> DataFrame:
    """Members of groups (``key``) that are not of their group's commonest component."""
    sums = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    most = sums.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("several")).where("several > 1")
    return members.join(most.select("key", "most"), "key").where("component <> most").drop("most")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures leave it possible that their sets reach the similarity."""
    left = sets.select(c("node").alias("a"), c("sig").alias("sig_a"))
    right = sets.select(c("node").alias("b"), c("sig").alias("sig_b"))
    least = percent / 100 - LIKELY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(x).to_pylist()), "<u2").reshape(batch.num_rows, -1) for x in ("sig_a", "sig_b")
            )
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least if len(a) else [], pa.bool_()))

    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity; ``texts`` has node and text."""
    left = texts.select(c("node").alias("a"), c("text").alias("text_a"))
    right = texts.select(c("node").alias("b"), c("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)  # rows of one centre come together
        for batch in batches:
            for part in slices(batch, "text_b"):
                a = part.column("a").to_pylist()
                good = []
                for k, other in enumerate(shingle_sets(part.column("text_b"), length)):
                    if last[0] != a[k]:
                        last = (a[k], next(shingle_sets(part.column("text_a").slice(k, 1), length)))
                    own = last[1]
                    joint = 0
                    if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                        joint = len(np.intersect1d(own, other, assume_unique=True))
                    good.append(100 * joint >= percent * (len(own) + len(other) - joint))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def with_component(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the component of their node, the node itself where it has no link."""
    out = rows.join(groups.select("node", "component"), "node", "left")
    return out.withColumn("component", F.coalesce("component", "node"))


def merge(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(node, component) of ``groups`` after adding ``links``; only links between components count."""
    if groups is None:
        return materialize(components(links, name="minhash-components"), "minhash-groups")
    near = with_component(links.select(c("a").alias("node"), "b"), groups).select(c("b").alias("node"), c("component").alias("a"))
    far = with_component(near, groups).select("a", c("component").alias("b")).where("a <> b")
    moves = materialize(components(far, name="minhash-components"), "minhash-moves")
    if moves.isEmpty():
        return groups
    single = moves.join(groups.select("node"), "node", "left_anti").select("node", c("node").alias("component"))
    ends = moves.select(c("node").alias("component"), c("component").alias("end"))
    merged = groups.select("node", "component").union(single).join(ends, "component", "left")
    return materialize(merged.select("node", F.coalesce("end", "component").alias("component")), "minhash-groups")


def _grouped(slim: DataFrame, length: int, percent: int) -> DataFrame:
    """(key, n_shingles, component) of each row of ``slim`` (key, text), written."""

    def link(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
        """Components of the sets once the links among ``pairs`` are added."""
        pairs = materialize(likely(pairs, sets, percent), "minhash-pairs")
        nodes = pairs.select(c("a").alias("node")).union(pairs.select(c("b").alias("node"))).distinct()
        texts = materialize(texts_of(nodes), "minhash-texts")
        new = materialize(verify(pairs, texts, length, percent), "minhash-links")
        return merge(new, groups)

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text): one whole text for each set."""
        wanted = nodes.join(sets.select("node", "t"), "node")
        source = slim.select(F.xxhash64("text").alias("t"), "text").join(wanted.select("t"), "t", "left_semi")
        return source.groupBy("t").agg(F.first("text").alias("text")).join(wanted, "t").select("node", "text")

    rows = materialize(signatures(slim.withColumn("t", F.xxhash64("text")), "text", length), "minhash-rows")
    sets = rows.where("fp is not null").groupBy(c("fp").alias("node")).agg(F.min(F.struct("t", "sig")).alias("m"))
    sets = materialize(sets.select("node", "m.t", "m.sig"), "minhash-sets")
    bands = band_keys(sets)

    # first round: every group's members against its smallest one
    centre = bands.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    pairs = bands.join(centre, "key").where("node <> a").select("a", c("node").alias("b")).distinct()
    groups = link(pairs, None)

    # second round: groups of several components, against their most typical members, those in the
    # largest groups, and some drawn by hash
    members = with_component(bands, groups)
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    members = materialize(members.join(mixed.where("low <> high and n > 2").select("key", "n"), "key"), "minhash-mixed")
    typical = members.groupBy("node").agg(F.sum("n").alias("score"))
    members = members.join(typical, "node")
    noise = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 16)) / float(1 << 16) for k in range(CENTRES)]
    drawn = [
        F.max(F.struct((c("score") * (1 - 0.05 * k * noise[k]) if k < CENTRES // 2 else noise[k]).alias("by"), "node", "component")) for k in range(CENTRES)
    ]
    centre = members.groupBy("key").agg(F.array(*[F.struct(m["node"].alias("a"), m["component"].alias("own")) for m in drawn]).alias("m"))
    mixed = centre.select("key", F.explode(F.array_distinct("m")).alias("m")).select("key", "m.a", "m.own")
    pairs = members.join(mixed, "key").where("component <> own").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    groups = link(pairs, groups)

    # the rest: pairs of different components that share a group
    members = with_component(bands, groups)
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    mixed = mixed.where("low <> high and n > 2").select("key", "n")
    left = materialize(members.join(mixed, "key"), "minhash-left")
    large = materialize(left.where(c("n") > LARGE_GROUP).select("node", "component").distinct(), "minhash-large")
    left = left.where(c("n") <= LARGE_GROUP).select("node", "component", "key")
    other = outside(left).select("key", c("node").alias("x"), c("component").alias("other"))
    pairs = other.join(left, "key").where("component <> other").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
    if not large.isEmpty():
        texts = texts_of(large.select("node")).join(large, "node").select("node", "component", "text")
        pairs = pairs.union(prefix_pairs(materialize(texts, "minhash-texts"), length, percent))
    groups = link(pairs.distinct(), groups)

    named = with_component(rows.select("key", "n_shingles", c("fp").alias("node")), groups)
    return materialize(named.select("key", "n_shingles", "component"), "minhash-named", keep=True)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row for each row of ``docs``.

    A row's set holds the distinct runs of ``length`` words (A-Z lower-cased) of its whole text; a
    shorter text is one element; null and empty texts have no elements and no links. Two rows are
    linked when 100 * |intersection| >= ``percent`` * |union|. ``component_id`` is the smallest key
    reachable by links, the row's own key included; ``kept`` marks the rows that bear it. Rows of
    one key in one component share the mark; a null key is never the smallest unless all are null.

    Rows with equal sets become one node first, so copies never meet. Each band group links its
    members to one member, twice with different ones; only groups that still hold several
    components are compared in full, members of large ones after an exact prefix filter. So near
    copies by the thousand cost some pairs each, and every pair that shares a band is in one
    component, compared, or shown to be too different. What is left to chance is the banding alone (about 3e-6 at the threshold).
    """
    with scratch(docs.sparkSession):
        named = _grouped(docs.select(c(key).alias("key"), c(text).alias("text")), length, percent)
    least = named.where("component is not null").groupBy("component").agg(F.min("key").alias("component_id"))
    out = named.join(least, "component", "left")
    smallest = F.coalesce("component_id", "key")
    return out.select(c("key").alias(key), "n_shingles", smallest.alias("component_id"), c("key").eqNullSafe(smallest).alias("kept"))
