"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.session import materialize

MAX_ROUNDS = 80  # a round leaves about half of the nodes of any graph; stars and cliques need one

c = F.col


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, component) for every node with a link to another; component is the smallest node.

    ``links`` has two columns of one type that can be ordered and hashed; nulls, self links,
    repeats and both directions may occur. In each round every node moves to the one of its
    neighbours, itself included, that comes first in a random order drawn for the round, and links
    within what has met disappear. Minima are combined before the shuffle, so a node with a third
    of all links is no hot group. Rounds are written to the shared folder, so lost executors cost
    one round at most. No link is ever collected.
    """
    edges = links.select(c(a).alias("u"), c(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    moved: DataFrame | None = None
    for k in range(MAX_ROUNDS):
        if edges.isEmpty():
            break

        def place(x: str):
            return F.struct(F.xxhash64(c(x), F.lit(k)).alias("h"), c(x).alias("to"))

        both = edges.union(edges.select(c("v").alias("u"), c("u").alias("v")))
        first = both.groupBy("u").agg(F.min(F.least(place("u"), place("v"))).alias("m")).select("u", "m.to")
        first = materialize(first, f"{name}-moves")
        left, right = first.select("u", c("to").alias("x")), first.select(c("u").alias("v"), c("to").alias("y"))
        edges = edges.join(left, "u").join(right, "v").where("x <> y")
        edges = materialize(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), name)
        if moved is None:
            moved = first.select(c("u").alias("node"), "to")
        else:
            further = first.select(c("u").alias("to"), c("to").alias("next"))
            moved = moved.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    else:
        raise RuntimeError("link components did not settle")
    if moved is None:
        return edges.select(c("u").alias("node"), c("v").alias("component"))
    moved = materialize(moved, f"{name}-ends")
    least = moved.groupBy("to").agg(F.min("node").alias("component"))
    return moved.join(least, "to").select("node", "component")
