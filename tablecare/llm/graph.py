"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges to (node, label): the smallest node of each component. Nodes without an edge are absent.

    Up to BROADCAST_ROWS edges, counted first, are solved in one task; more are solved by joins.
    There, every round takes the least label among a node's neighbours and then the label of that
    label, so chains shorten by doubling; each round's labels are a written table, and rounds end
    when no label changes."""
    edges = written(edges.select("a", "b"), f"{name}-edges")
    if edges.count() <= BROADCAST_ROWS:
        return written(edges.coalesce(1).mapInArrow(_solve, "node long, label long"), name)
    return by_joins(edges, name)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
    if not both:
        return
    nodes, at = np.unique(np.concatenate(both, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def by_joins(edges: DataFrame, name: str = "components") -> DataFrame:
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-both")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")),
                     f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = new.join(of, "label").select("node", F.least("label", "up").alias("label"), "old")
        new = written(new, f"{name}-{step}")
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
