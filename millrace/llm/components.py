"""Connected components of a graph that no machine holds: alternating large and small stars.

A large star links every larger neighbour of a node to the node's smallest neighbour, a small star
every smaller neighbour and the node itself (Kiveris et al., Connected Components in MapReduce and
Beyond, 2014). Both keep the components; after a number of rounds about logarithmic in the nodes
the edges are stars around the smallest node. Minima are summed before the shuffle, and the join
with them is one that adaptive execution may split, so a hub is no bottleneck. Every round is
written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize_at


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v): one step; returns edges (u > v)."""
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ends.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if large:
        out = ends.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = ends.join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def named(nodes: DataFrame, linked: DataFrame, node: str, name: str, out: str) -> DataFrame:
    """``nodes`` with ``out``: the ``name`` of their component's smallest node, their own where they have no link.

    ``linked`` comes from ``components``; the join by component has unique keys on one side, so adaptive execution
    may split a large component.
    """
    placed = nodes.join(linked, F.col(node) == F.col("node"), "left").withColumn("_root", F.coalesce("component", node)).drop("node", "component")
    names = nodes.select(F.col(node).alias("_node"), F.col(name).alias(out))
    return placed.join(names, F.col("_root") == F.col("_node")).drop("_root", "_node")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v), of any one orderable type; the component is its
    smallest node. Null ends, loops and repeated edges are ignored; no edges give no rows."""
    edges, last = materialize_at(edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = None
    while True:
        edges, path = materialize_at(_star(_star(edges, True), False), "star")
        discard(edges.sparkSession, last)
        last = path
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == digest:
            break
        digest = now
    hubs = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs.select(F.col("v").alias("node"), F.col("v").alias("component")))
