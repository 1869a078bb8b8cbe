"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialise

#: Edges that a task reduces to a forest at once.
AT_ONCE = 1 << 20


def least_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component, by repeated minima along the edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` with the same components: a task joins the edges it has into forests, fewer than its nodes, before any is shuffled."""

    def reduce(parts: list[np.ndarray]) -> np.ndarray:
        ends = np.concatenate(parts, axis=1)
        nodes, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        root = least_members(at[0], at[1], len(nodes))
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return np.stack([nodes[other], nodes[root[other]]])

    parts: list[np.ndarray] = []
    kept = 0
    for batch in batches:
        parts.append(np.stack([batch.column(c).to_numpy() for c in ("a", "b")]))
        if sum(p.shape[1] for p in parts) - kept >= AT_ONCE:
            parts = [reduce(parts)]
            kept = parts[0].shape[1]
            if kept >= AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["a", "b"])
                parts, kept = [], 0
    if parts and (out := reduce(parts)).shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b"])


def combined(edges: DataFrame) -> DataFrame:
    """The edges that ``forests`` leaves of each task's."""
    return edges.where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(lean(forests), "a long, b long")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge that isn't itself the root.

    ``root`` is the least node of the component. Each step only groups by a
    node and joins the group's minimum back, so a hub is pre-aggregated before
    its rows are shuffled and its join partition can be split; nothing but the
    edge count and a checksum comes to the driver. Null ends are ignored.
    """
    edges = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
