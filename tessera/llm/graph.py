"""Connected components by contraction, with nothing but joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.session import discard

JUMPS = 3
#: so few edges are solved in one task
FEW = 1 << 14


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> (n, h): every node and the smallest that it reaches."""
    columns = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not columns:
        return
    ends = np.concatenate([np.stack(c) for c in columns], 1)
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(ends.shape)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["n", "h"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): for every node of an edge, the smallest node it can reach.

    Each round, every node hooks on to its smallest neighbour if that is smaller, hooks are followed a few steps, and
    the graph is contracted along them; rounds are logarithmic in practice. Minima are combined map-side, so a hub
    costs one row for each task. Each round is written to the shared folder. When FEW edges are left, one task follows them to
    the end. Nulls are dropped, loops are kept as
    nodes, repeated edges count once, no edge gives no row.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    every = edges = stored(edges.distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    rest = edges.where("a <> b")
    while (left := rest.count()) > 0:
        if left <= FEW:
            hooks = stored(rest.coalesce(1).mapInArrow(_solved, "n long, h long"), "hooks")
            before, labels = labels, stored(labels.join(hooks, F.col("component") == F.col("n"), "left").select("node", F.coalesce("h", "component").alias("component")), "labels")
            discard(before, hooks, every)
            return labels
        both = rest.union(rest.select("b", "a"))
        near = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("h")).select("n", F.least("n", "h").alias("h"))
        near = hooks = stored(near, "hooks")
        for _ in range(JUMPS):
            onward = hooks.select(F.col("n").alias("m"), F.col("h").alias("o"))
            hooks = hooks.join(onward, F.col("h") == F.col("m")).select("n", F.col("o").alias("h"))
        hooks = stored(hooks, "hooks")
        before, labels = labels, labels.join(hooks, F.col("component") == F.col("n"), "left").select("node", F.coalesce("h", "component").alias("component"))
        labels = stored(labels, "labels")
        moved = rest.join(hooks.select(F.col("n").alias("a"), F.col("h").alias("x")), "a").join(hooks.select(F.col("n").alias("b"), F.col("h").alias("y")), "b")
        last, rest = every, stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        every = rest
        # what a round is made from goes when the round is written
        discard(before, near, hooks, last)
    return labels
