"""Connected components on Spark: alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_tables, materialize

#: Edges that a task ties together at a time before any are shuffled.
FOREST_EDGES = 1 << 17
#: Edges that one task ties at once instead of in rounds: 8 MB of them.
AT_ONCE = 1 << 19


def roots_of(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least node of its component for each of n nodes, given edges between x and y."""
    root = np.arange(n)
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def forest(batches: Iterator[pa.RecordBatch], at_once: int = FOREST_EDGES) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to stars (node, least node) with the same components, so many edges at a time.

    Many edges between few nodes become at most one for each node.
    """

    def tie(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots_of(place[: len(a)], place[len(a) :], len(nodes))
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= at_once:
            yield tie(held)
            held, n = [], 0
    if n:
        yield tie(held)


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it. Edges have a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node with an edge that isn't the least of its component; root is that least node.

    All edges of a node at end a meet in one task, but for those of hot nodes, which are dealt to several; there they are
    tied to stars before the first round. What is left is tied by one task if it is at most `AT_ONCE` edges, else by rounds,
    whose number grows with the logarithm of the longest path; the result is the same. Only counts come to the driver.
    """
    x, y = F.col(a), F.col(b)
    round_no, made, earlier = 0, [], []
    met = edges.filter(x != y).select(x.cast("long").alias("a"), y.cast("long").alias("b")).hint("rebalance", "a")
    state = materialize(met.mapInArrow(forest, "a long, b long"), "forest", made)  # every round reads it several times
    if state.count() <= AT_ONCE:
        whole = lambda batches: forest(batches, AT_ONCE + 1)
        return materialize(state.coalesce(1).mapInArrow(whole, "a long, b long"), "trees").select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = state.distinct()
    while True:
        made, earlier = [], made
        state = materialize(small_star(large_star(state)), f"stars{round_no}", made)
        drop_tables(edges.sparkSession, earlier)
        # done when every edge leads from a node of one edge to a node that has none upwards
        upward = state.groupBy("a").count()
        if state.join(upward.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and upward.filter("count > 1").isEmpty():
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        round_no += 1
