"""Connected components of a graph whose edges are rows, by alternating large and small stars.

A graph that one task holds is joined there: rounds of stars over a few edges cost little but their thousands of tasks,
with the files and events of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct edges that one task joins; more are joined in rounds.
TOGETHER = 1 << 20
ROOTS = "node long, root long"


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges, in order, and the least node it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a and b are roots, and no root is below its own
        while not np.array_equal(root, up := root[root]):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    if edges:
        node, root = united(*(np.concatenate(side) for side in zip(*edges, strict=True)))
        for i in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(root[i : i + (1 << 16)])], ["node", "root"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node points to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the least of them; edges run from larger to smaller."""
    least = _least(edges)
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(node, root) of every node that has an edge; edges: (u, v) of longs. root: the least node it reaches.

    Up to `together` distinct edges are joined in one task. Beyond that rounds grow with the logarithm of the longest
    path; each is written, so that lineage stays short.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = _state(edges)
    if before[0] <= together:
        return edges.coalesce(1).mapInArrow(_united, ROOTS).checkpoint()
    while before[0]:
        edges = _small_star(_large_star(edges)).checkpoint()
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
