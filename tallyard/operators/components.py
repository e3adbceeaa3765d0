"""Connected components by alternating large-star and small-star rounds on an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.runtime import cut, drop_cut, skew_safe_join

MAX_ROUNDS = 60
#: Edges that a task shortens together.
CHUNK_EDGES = 500_000


def key_edges(rows: DataFrame, node: str, keys: dict[str, Column]) -> DataFrame:
    """Edges (u, v) from each row to the smallest node that has the same value of one of the keys.

    A value relates rows under its own key name only; null values relate nothing. The smallest node is a
    partial aggregate, so no group of rows is gathered and a key with n rows costs n edges, not n squared.
    """
    long = rows.select(
        F.col(node).alias("u"),
        F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), value.cast("string").alias("value")) for name, value in keys.items()])).alias("k"),
    ).select("u", "k.kind", "k.value").filter("u is not null and value is not null")
    anchors = cut(long.groupBy("kind", "value").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1"))
    total = anchors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).head()["t"]
    return skew_safe_join(long, anchors, ["kind", "value"], "n", total).filter("u <> v").select("u", "v").distinct()


def _stars(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges' own components as stars: each node with the smallest node it reaches by these edges."""
    codes, nodes = pd.factorize(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]), sort=True)
    a, b = codes[: len(edges)], codes[len(edges) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[inner], "v": nodes[root[inner]]})


def _shorten(chunk: int):
    """For mapInPandas: edges as stars, chunk by chunk; a chunk never becomes more edges and connects what it connected before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= chunk:
                yield _stars(pd.concat(held, ignore_index=True))
                held, count = [], 0
        if held:
            yield _stars(pd.concat(held, ignore_index=True))

    return run


def _shortened(edges: DataFrame) -> DataFrame:
    """edges (u, v) without repeats, shortened where they lie and written down; a combiner before the next shuffle."""
    return cut(edges.distinct().mapInPandas(_shorten(CHUNK_EDGES), edges.schema))


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m, n): the smallest v of each u and how many edges u has, written down."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges has columns u and v of one orderable type; direction, repeats and self-loops do not matter; nulls
    are left out. An empty edge list gives an empty result. Each round makes the edges of one place into stars there,
    then takes a large-star and a small-star step over all of them, by partial minima and joins that split hot nodes. Each step's table is written to the shared folder and the one before it removed, so neither
    plans nor files pile up. It ends when every node that is not the smallest of its edges has one edge only, which
    the minima tell without another pass; rounds grow with the logarithm of the largest component.
    """
    current = _shortened(edges.select("u", "v").filter("u is not null and v is not null and u <> v"))
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = _smallest(both)
        total, open_nodes = smallest.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).head()
        if not open_nodes:
            drop_cut(smallest)
            break
        # large star: every larger neighbour of a node is linked with the smallest of the node and its neighbours
        seen = skew_safe_join(both, smallest, ["u"], "n", total).filter("v > u")
        linked = cut(seen.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        drop_cut(current)
        drop_cut(smallest)
        # small star: a node's smaller neighbours and the node itself are linked with the smallest of them
        smallest = _smallest(linked)
        total = smallest.agg(F.sum("n")).head()[0]
        seen = skew_safe_join(linked, smallest, ["u"], "n", total).filter("v <> m")
        current = _shortened(seen.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v"))))
        drop_cut(linked)
        drop_cut(smallest)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
