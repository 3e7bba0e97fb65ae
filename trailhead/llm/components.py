"""Connected components of an edge table by alternating minimum-label rounds, in DataFrame operations.

A round takes every node's smallest neighbour and rewires (large star, then small star); the number of rounds grows
with the logarithm of the longest path.  Each round ends in ``checkpoint()``: nothing is gathered on the driver but
one count, and a lost executor costs no earlier round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def _large(e: DataFrame, n: int) -> DataFrame:
    """Link each larger neighbour of u to the smallest node known at u."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return runtime.lookup(both.where("v > u"), low, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame, n: int) -> DataFrame:
    """Every edge points to the smaller end: link u and its smaller neighbours to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    star = runtime.lookup(e, low, "u", "n", n).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return star.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that an edge touches and that is not itself the root.

    Null ends and self-links are ignored; edges may repeat and point either way.  No edges: no rows.  A hub's smallest
    neighbour is sent to its edges, which stay where they are (``runtime.lookup``).
    """
    runtime.shared_dir(edges.sparkSession)
    e = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
        .checkpoint()
    )
    mark, n = None, e.count()
    while n:
        large = _large(e, n)
        if n > runtime.PLAIN_ROWS:  # both halves of a lookup read it
            large = large.distinct().checkpoint()
        e = _small(large, n).distinct().checkpoint()
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def stars(links: np.ndarray) -> np.ndarray:
    """(node, root) for the nodes of links (n, 2) that are not the smallest of what they are chained to."""
    node, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            return np.stack([node, node[root]], 1)[root != np.arange(len(node))]
        root = new


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of equal neighbours."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    return edge[:-1], edge[1:]
