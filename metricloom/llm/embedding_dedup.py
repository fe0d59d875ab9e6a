"""Exact cosine threshold groups of vectors by a distributed cover tree and dual traversal.

Unit vectors of one label form one space. A cell that is too large gets a net: centres at least a
radius apart, the radius halved until the net has several; members within it become children, the
others stay together. Pairs of cells are then followed downwards: if the distance of their centres
less both covering radii exceeds the threshold distance, no pair in them can be linked; if the
distance plus both radii stays below it, all are. Vectors of the pairs left over are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.components import components
from metricloom.session import materialize

c = F.col
LEAF = 1024  # vectors compared as one block; larger leaves are cut into several
NET_SAMPLE = 64  # members a net is chosen from, about
MAX_LEVELS = 10
SLACK = 1e-7  # keeps rounding away from the bounds; the dot products decide
SMALL = LEAF // 8  # a child with fewer members stays in the remainder, where it costs no blocks of its own
MEMBER = "space string, cell string, node bigint, n bigint, vec array<double>, dist double"


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows as doubles of length 1; rows that are zero or not finite throughout become NaN."""
    top = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    usable = np.isfinite(x).all(axis=1, keepdims=True) & (top > 0)
    # scaled first, so that squares neither vanish nor overflow
    scaled = np.divide(x, top, out=np.full_like(x, np.nan), where=usable)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def unit(embedding: Column) -> Column:
    """The vector as doubles of length 1; null where it is null, empty, zero or not finite throughout."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            n = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
            at = np.concatenate([[0], np.cumsum(n)])
            out = np.empty(len(flat))
            good = np.zeros(len(n), bool)
            for size in np.unique(n[n > 0]):
                rows = np.flatnonzero(n == size)
                where = at[rows][:, None] + np.arange(size)[None, :]
                made = unit_rows(flat[where])
                out[where] = made
                good[rows] = ~np.isnan(made).any(axis=1)
            # lists of the unusable rows are null and take no values, so the others keep their own
            kept = np.concatenate([[0], np.cumsum(np.where(good, n, 0))])
            yield pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(out[np.repeat(good, n)]), mask=pa.array(~good))

    return run(embedding)


def distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def net(vectors: np.ndarray, radius: float) -> np.ndarray:
    """Rows at least ``radius`` apart, the radius halved until there are several if possible."""
    for _ in range(30):
        chosen = [0]
        near = np.linalg.norm(vectors - vectors[0], axis=1)
        while near.max() > radius and len(chosen) < len(vectors):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
        if len(chosen) > 1:
            break
        radius /= 2
    return np.array(chosen)


def split(members: DataFrame, big: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(children's members, children) of the cells in ``big`` (cell, size, radius, center)."""
    fraction = F.least(F.lit(1.0), F.lit(float(NET_SAMPLE)) / c("size"))
    draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 20)) / float(1 << 20)
    held = members.join(big.select("cell", "size", "radius", "center"), "cell")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["vec"])
        reach = float(group["radius"].iloc[0])
        rows = net(x, reach / 2)
        gap = min((np.linalg.norm(x[i] - x[j]) for k, i in enumerate(rows) for j in rows[:k]), default=reach)
        near = reach / 2
        while near > gap:
            near /= 2
        cell = group["cell"].iloc[0]
        return pd.DataFrame({"cell": cell, "child": [f"{cell}.{k}" for k in range(len(rows))], "center": list(x[rows]), "reach": near})

    sample = held.where(draw < fraction).select("cell", "vec", "radius")
    centers = materialize(
        sample.groupBy("cell").applyInPandas(choose, "cell string, child string, center array<double>, reach double"), "tree-centers"
    )
    # chunks of a cell meet its centres; no task gets a whole large cell
    chunks = big.select("cell", F.col("center").alias("old"), F.explode(F.sequence(F.lit(0), F.floor(c("size") / LEAF).cast("int"))).alias("chunk"))
    tests = chunks.join(centers, "cell")
    spread = held.withColumn("chunk", F.pmod(F.xxhash64("node"), F.floor(c("size") / LEAF) + 1).cast("int"))

    def assign(rows: pd.DataFrame, tests: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"space": [], "cell": [], "node": [], "n": [], "vec": [], "dist": [], "rest": [], "far": []})
        x = np.stack(rows["vec"])
        cell = rows["cell"].iloc[0]
        old = np.array(rows["center"].iloc[0])
        far, child = np.linalg.norm(x - old, axis=1), np.full(len(x), f"{cell}.r", object)
        dist = far
        if len(tests):
            centers = np.stack(tests["center"])
            d = np.sqrt(np.maximum(((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2), 0))
            k = d.argmin(axis=1)
            best = d[np.arange(len(x)), k]
            within = best <= tests["reach"].to_numpy()[k]
            dist, child = np.where(within, best, dist), np.where(within, tests["child"].to_numpy()[k], child)
        return pd.DataFrame(
            {"space": rows["space"], "cell": child, "node": rows["node"], "n": rows["n"], "vec": rows["vec"], "dist": dist, "rest": f"{cell}.r", "far": far}
        )

    out = spread.select("space", "cell", "chunk", "node", "n", "vec", "center").groupBy("cell", "chunk")
    out = out.cogroup(tests.groupBy("cell", "chunk")).applyInPandas(assign, MEMBER + ", rest string, far double")
    out = materialize(out, "tree-assigned")
    large = out.groupBy("cell").agg(F.count("*").alias("_size")).where(c("_size") >= SMALL).select("cell", F.lit(True).alias("_large"))
    own = F.coalesce("_large", F.lit(False))
    out = out.join(large, "cell", "left").select(
        "space", F.when(own, c("cell")).otherwise(c("rest")).alias("cell"), "node", "n", "vec", F.when(own, c("dist")).otherwise(c("far")).alias("dist")
    )
    out = materialize(out, "tree-members")
    made = centers.select(c("child").alias("cell"), "center").union(big.select(F.concat("cell", F.lit(".r")), "center"))
    return out, describe(out, made)


def describe(members: DataFrame, centers: DataFrame) -> DataFrame:
    """(cell, size, weight, rep, radius, center) of cells that have members."""
    sums = members.groupBy("cell").agg(
        F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("node").alias("rep"), F.max("dist").alias("radius")
    )
    return materialize(sums.join(centers, "cell"), "tree-cells")


def tree(nodes: DataFrame, limit: float) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(members of leaves, all cells, (cell, child) links, levels)."""
    members = nodes.withColumn("cell", c("space")).withColumn("dist", F.lit(2.0)).select("space", "cell", "node", "n", "vec", "dist")
    roots = members.groupBy("cell").agg(F.min_by("vec", "node").alias("center"))
    cells = describe(members, roots)
    all_cells, leaves, children, level = [cells], [], [], 0
    while level < MAX_LEVELS:
        big = cells.where((c("size") > LEAF) & (c("radius") * 2 > limit))
        if "stuck" in cells.columns:
            big = big.where("not stuck")
        big = materialize(big, "tree-large")
        if big.isEmpty():
            break
        leaves.append(members.join(big, "cell", "left_anti"))
        members, cells = split(members.join(big.select("cell"), "cell", "left_semi"), big, level)
        parent = F.regexp_extract("cell", r"^(.*)\.[^.]+$", 1)
        children.append(cells.select(parent.alias("cell"), c("cell").alias("child")))
        all_cells.append(cells)
        # a remainder that hardly shrank has no structure left to split by
        before = big.select(c("cell").alias("parent"), c("size").alias("size_before"))
        cells = cells.withColumn("parent", parent).join(before, "parent")
        cells = cells.withColumn("stuck", c("cell").endswith(".r") & (c("size") > 0.9 * c("size_before"))).drop("parent", "size_before")
        level += 1
    leaves.append(members)
    links = reduce(DataFrame.union, children) if children else cells.select("cell", c("cell").alias("child")).limit(0)
    return reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, all_cells), links, level


def traverse(cells: DataFrame, links: DataFrame, levels: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """(cell pairs that are linked throughout, leaf pairs left to compare), a <= b."""
    inner = links.select("cell").distinct()
    steps = links.union(cells.join(inner, "cell", "left_anti").select("cell", c("cell").alias("child")))
    bounds = cells.select("cell", "center", "radius")

    def judge(pairs: DataFrame) -> DataFrame:
        a = bounds.select(c("cell").alias("a"), c("center").alias("ca"), c("radius").alias("ra"))
        b = bounds.select(c("cell").alias("b"), c("center").alias("cb"), c("radius").alias("rb"))
        near = pairs.join(a, "a").join(b, "b").withColumn("d", distance(c("ca"), c("cb")))
        near = near.where(c("d") - c("ra") - c("rb") <= limit + SLACK)
        return materialize(near.select("a", "b", (c("d") + c("ra") + c("rb") <= limit - SLACK).alias("all")), "tree-pairs")

    roots = cells.where(~c("cell").contains(".")).select(c("cell").alias("a"), c("cell").alias("b"))
    pairs = judge(roots)
    whole = [pairs.where("all")]
    for _ in range(levels):
        down = pairs.where("not all").join(steps.select(c("cell").alias("a"), c("child").alias("x")), "a")
        down = down.join(steps.select(c("cell").alias("b"), c("child").alias("y")), "b")
        pairs = judge(down.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        whole.append(pairs.where("all"))
    return reduce(DataFrame.union, whole).select("a", "b"), pairs.where("not all").select("a", "b")


def compare(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks: per vector the linked weight, and one node of its local group."""
    right = group["side"].to_numpy() == 1
    same = not right.any()
    x = np.stack(group["vec"])
    node, n = group["node"].to_numpy(), group["n"].to_numpy()
    left, other = (np.arange(len(x)), np.arange(len(x))) if same else (np.flatnonzero(~right), np.flatnonzero(right))
    linked = x[left] @ x[other].T >= threshold
    if same:
        np.fill_diagonal(linked, False)
    count = np.zeros(len(x), np.int64)
    count[left] += linked @ n[other]
    if not same:
        count[other] += linked.T @ n[left]
    label = node.copy()
    i, j = np.nonzero(linked)
    i, j = left[i], other[j]
    while len(i):
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            break
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
    some = count > 0
    return pd.DataFrame({"node": node[some], "links": count[some], "root": label[some]})


def block_links(members: DataFrame, cells: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) from comparing the vectors of leaf pairs, block by block."""
    parts = cells.select("cell", F.ceil(c("size") / LEAF).cast("int").alias("k"))
    a, b = parts.select(c("cell").alias("a"), c("k").alias("ka")), parts.select(c("cell").alias("b"), c("k").alias("kb"))
    blocks = pairs.join(a, "a").join(b, "b")
    blocks = blocks.withColumn("sa", F.explode(F.sequence(F.lit(0), c("ka") - 1))).withColumn("sb", F.explode(F.sequence(F.lit(0), c("kb") - 1)))
    blocks = blocks.where("a <> b or sa <= sb").withColumn("pair", F.concat_ws("|", "a", "sa", "b", "sb"))
    sides = blocks.select("pair", c("a").alias("cell"), c("sa").alias("part"), F.lit(0).alias("side")).union(
        blocks.where("a <> b or sa <> sb").select("pair", "b", "sb", F.lit(1))
    )
    rows = members.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), c("k")).cast("int"))
    rows = rows.select("cell", "part", "node", "n", "vec").join(sides, ["cell", "part"])
    return rows.select("pair", "side", "node", "n", "vec").groupBy("pair").applyInPandas(
        lambda group: compare(group, threshold), "node bigint, links bigint, root bigint"
    )


def similar_vectors(
    rows: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93
) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each row of ``rows``.

    Rows are linked when their labels are equal and not null and the cosine of their vectors, in
    double precision, is at least ``threshold``. Vectors that are null, empty, zero or hold null or
    non-finite components have no links; vectors of different lengths are not compared. ``n_links``
    counts linked rows other than the row itself, repeated rows included; ``component_id`` is the
    smallest key reachable, ``kept`` marks the rows that bear it. An empty table stays empty.

    Equal vectors become one node first. A ball of near copies, however many, is one cell whose
    inner links are counted, not listed. No centre, vector or link is collected by the driver.
    """
    limit = float(np.sqrt(2 - 2 * threshold))
    named = rows.select(c(key).alias("key"), c(label).cast("string").alias("label"), c(embedding).alias("e"), unit(c(embedding)).alias("vec"))
    usable = F.when(c("label").isNotNull() & c("vec").isNotNull(), F.xxhash64("label", "e"))
    named = materialize(named.withColumn("node", usable), "vector-rows")
    valid = named.where("node is not null")
    space = F.md5(F.concat_ws(":", F.size("vec"), "label"))
    nodes = valid.groupBy("node").agg(F.count("*").alias("n"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    nodes = materialize(nodes.select(space.alias("space"), "node", "n", "vec"), "vector-nodes")

    members, cells, links, levels = tree(nodes, limit)
    members, cells = materialize(members, "tree-leaves"), materialize(cells, "tree-all")
    whole, left = traverse(cells, links, levels, limit)
    found = block_links(members, cells, left, threshold)
    # pairs of cells that are linked throughout, seen from either cell
    info = cells.select("cell", "weight", "rep")
    seen = whole.select(c("a").alias("cell"), c("b").alias("other")).union(whole.where("a <> b").select("b", "a"))
    seen = seen.join(info.select(c("cell").alias("other"), c("weight").alias("w"), c("rep").alias("root")), "other")
    prefix = F.split("cell", r"\.")
    steps = F.transform(F.sequence(F.lit(1), F.size(prefix)), lambda i: F.array_join(F.slice(prefix, 1, i), "."))
    above = members.select("node", "n", F.explode(steps).alias("cell"))
    gained = seen.groupBy("cell").agg(F.sum("w").alias("w"), F.max(F.when(c("cell") == c("other"), 1).otherwise(0)).alias("own"))
    inside = above.join(gained, "cell").join(info.select("cell", "rep"), "cell")
    found = found.union(inside.select("node", c("w") - F.when(c("own") == 1, c("n")).otherwise(0), c("rep")))
    found = materialize(found, "vector-links")
    bridges = seen.join(info.select("cell", "rep"), "cell").select(c("rep").alias("a"), c("root").alias("b"))
    edges = found.select(c("node").alias("a"), c("root").alias("b")).union(bridges)
    groups = components(edges, name="vector-components")

    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.select("node", "n").join(counted, "node", "left").join(groups, "node", "left")
    per_node = per_node.select(
        "node", (F.coalesce("links", F.lit(0)) + c("n") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    out = materialize(named.select("key", "node").join(per_node, "node", "left"), "vector-named")
    least = out.where("component is not null").groupBy("component").agg(F.min("key").alias("component_id"))
    out = out.join(least, "component", "left")
    smallest = F.coalesce("component_id", "key")
    return out.select(
        c("key").alias(key), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), smallest.alias("component_id"),
        c("key").eqNullSafe(smallest).alias("kept"),
    )
