"""Connected components as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import join_hot, kept

#: Edges that a task contracts at a time, about.
STEP_EDGES = 1 << 18


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' nodes that are not the smallest of their component, and that smallest one: as connected as before, and no more edges."""
    names, ids = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ids.reshape(2, -1)
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= STEP_EDGES:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label for every node of edges (u, v), longs, that is not the smallest of its component, which is the label.

    First each task replaces its edges, some at a time, by a forest of stars, so that few rounds are left. Rounds of large-star and
    small-star: each node's larger neighbours, then its smaller ones, are tied to the smallest node it knows, until nothing changes.
    A hub's neighbours are pre-aggregated before any shuffle, and in its joins they stay where they are (join_hot), so one component
    may hold most nodes. Every round is written down; to the driver come two sums and the hubs' names.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = kept(e.mapInArrow(_contracted, "u long, v long"), name)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept(join_hot(both.filter("v > u"), least, "u", most=state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, least, "u", most=state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        e = kept(small.distinct(), name)
