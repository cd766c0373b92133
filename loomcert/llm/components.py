"""Connected components of an edge table by alternating large and small stars, each round a few joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import column, discard, on_executors, stored, to_batch

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges, by pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def contracted_of(batches):
    """The edges of each batch as stars around the least node of what they join: fewer edges, and no long chains within a batch."""
    for batch in batches:
        node, least = least_of(column(batch, "u").to_numpy(), column(batch, "v").to_numpy())
        other = node != least
        yield to_batch(_EDGES, node[other], least[other])


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (u, v), both long: root is the component's least node.

    Rounds run until the edges stay the same; each is written to the shared folder. With `rounds`, so many at most: then a root is a node of
    the component, but several may be. Nulls, loops and repeated edges are of no account.
    """
    whole = edges.where("u != v").select("u", "v").mapInArrow(on_executors("components", "contracted_of"), "u long, v long")
    now, before, done = stored(whole.distinct(), "edges"), None, 0
    while done != rounds and (state := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before and state[0]:
        before, old, done = state, now, done + 1
        now = stored(_small_star(_large_star(now)), "edges")
        discard(old)
    pairs = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return pairs.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(pairs.select("node"), "node", "left_anti"))
