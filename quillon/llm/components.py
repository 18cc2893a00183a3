"""Connected components of links in rounds of joins; no task or driver holds all links.

Method: large-star and small-star contraction. An edge points from its smaller
node to its larger one. A large step moves each edge's smaller end to the least
node that points to it; a small step joins all nodes that point to one to the
least of them. Edges end as stars around each component's smallest node, and the
rounds stop when no node has two parents or is parent and child at once. Before
the first round each task contracts what it holds by union-find, which changes
no component. Both steps of a round are written to the shared folder, so a lost
executor costs no more than one step. A hub's minima are taken before the
exchange, and its joins can be split like any skewed join.

Cases. Self-links and repeated links do nothing. An empty input gives no rows.
Nodes are longs; null ends are not allowed (callers drop them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, save

EDGE = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components: (root, node) with the smallest node as root."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # labels fall to the least neighbour's, then along their own pointers
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def contracted(rows, flush: int = 1 << 20):
    """What ``rows`` makes of batches, as edges, in each task as stars; beyond ``flush`` edges it passes them on and starts anew."""

    def run(batches):
        a, b = [], []
        held = 0
        for batch in rows(batches):
            a.append(batch.column("a").to_numpy(zero_copy_only=False))
            b.append(batch.column("b").to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= flush:
                yield out(*forest(np.concatenate(a), np.concatenate(b)))
                a, b, held = [], [], 0
        if held:
            yield out(*forest(np.concatenate(a), np.concatenate(b)))

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def contract(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars."""
    return map_arrow(edges, contracted(lambda batches: batches), EDGE)


def _open(edges: DataFrame) -> DataFrame:
    """Nodes that keep the edges from being stars: children of several, or parent and child at once.

    ``low`` is a node's least parent, ``parent`` whether it is one itself.
    """
    children = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"), F.max("a").alias("high"))
    parents = edges.select(F.col("a").alias("of")).distinct()
    joined = children.join(parents, F.col("node") == F.col("of"), "left")
    return joined.filter((F.col("low") != F.col("high")) | F.col("of").isNotNull()).select("node", "low", F.col("of").isNotNull().alias("parent"))


def components(links: DataFrame, stars: bool = False) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has a link.

    ``stars`` tells that a ``contracted`` function made the links, so that no task needs a second worker to contract them.
    """
    # Saved, as what a task contracts to depends on the order in which its rows arrive.
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    edges = save(edges if stars else contract(edges))
    # Only nodes that a step moves are joined with the edges. They are saved, since joins are split
    # where a key is hot only if both sides come straight from an exchange. A step makes one edge of each at most.
    while not (state := save(_open(edges))).isEmpty():
        moved = state.filter("parent").select("node", "low")
        large = save(edges.join(moved, F.col("a") == F.col("node"), "left").select(F.coalesce("low", "a").alias("a"), "b"))
        shared = save(large.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low < high").select("node", "low"))
        # Of a child of several the edge from its least parent stays; the others become edges from that parent to themselves.
        small = large.join(shared, F.col("b") == F.col("node"), "left")
        edges = save(small.select(F.coalesce("low", "a").alias("x"), F.when(F.col("low") < F.col("a"), F.col("a")).otherwise(F.col("b")).alias("y")).toDF("a", "b").distinct())
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(roots)
