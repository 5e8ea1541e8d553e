"""Connected components of a table of edges, by alternating stars in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimwire.llm.common import in_batches, written


class Groups:
    """Disjoint sets of the integers below ``n``."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        root = i
        while self.up[root] != root:
            root = self.up[root]
        while self.up[i] != root:
            self.up[i], i = root, self.up[i]
        return int(root)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        """The least member of each one's set."""
        up = self.up
        while True:
            higher = up[up]
            if np.array_equal(higher, up):
                return up
            self.up = up = higher


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars around the least node of their components."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        nodes = np.unique(np.concatenate([a, b]))
        groups = Groups(len(nodes))
        for i, j in zip(np.searchsorted(nodes, a).tolist(), np.searchsorted(nodes, b).tolist(), strict=True):
            groups.join(i, j)
        label = nodes[groups.labels()] if len(nodes) else nodes
        keep = label != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(label[keep], pa.int64())], ["a", "b"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (long a, long b): the least node that links reach. Edges repeat freely.

    Rounds of stars towards the least neighbour, each written to the shared folder, until the edges stay the same: a
    number of rounds that grows with the logarithm of the largest component."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, seen = written(ordered.transform(in_batches, _contract, "a long, b long").distinct(), "edges"), None
    while True:
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
        now = written(_small(_large(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
