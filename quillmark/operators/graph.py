"""Distributed union-find: connected components by alternating large-star and small-star.

Up to ONE_TASK edges between longs, counted first, are labelled by one task.  Beyond that:

Every step is a partial aggregation and an equi-join, each round's edges are a written
table (the one before is deleted), and nothing is gathered on the driver but two numbers a
round.  A hub's rows need not meet in one task: the minimum is pre-aggregated, and the few
nodes that hold a large share of all edges are joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, weighted_join, written


#: Edges (16 bytes each) that one task may label, instead of rounds over tables.
ONE_TASK = 1_000_000


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of 0..n-1 under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        left = label[i] != label[j]
        i, j = i[left], j[left]
    return label


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [np.stack([np.asarray(c) for c in b.columns]) for b in batches]
    if ends:
        nodes, back = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        back = back.reshape(2, -1)
        roots = nodes[spanning(len(nodes), back[0], back[1])]
        for low in range(0, len(nodes), 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.record_batch([pa.array(nodes[part]), pa.array(roots[part])], names=["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of one orderable type -> (node, root), root = smallest node reachable.

    Nodes without an edge do not appear.  Loops, repeated edges and both directions are
    allowed; edges with a null end are ignored; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = written(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "edges",
    )
    before, total = None, now.count()
    if total <= ONE_TASK and now.schema["a"].dataType.simpleString() == "bigint":
        return now.coalesce(1).mapInArrow(_labelled, "node long, root long")
    while total:
        # Large star: a node's larger neighbours move to its smallest neighbour.
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        least = least.select("a", F.least("a", "m").alias("m"), "n")
        big = weighted_join(both.where(b > a), least, "a", "n", total).select(b.alias("a"), F.col("m").alias("b")).distinct()
        big = written(big, "star")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        small = big.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        star = weighted_join(big, small, "a", "n", total).where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        old, now = now, written(star.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(old, big)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before, total = state, state[0]
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
