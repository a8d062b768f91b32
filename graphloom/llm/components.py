"""Connected components of a table of links, by union-find in tasks and contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import cut, forget, in_arrow


class UnionFind:
    """Sets under their smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def local_forest(links: DataFrame, most: int = 500_000) -> DataFrame:
    """Links (a, b) with those that close a circle inside a task left out; at most ``most`` nodes are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()
        for batch in batches:
            if len(sets.parent) > most:
                sets = UnionFind()
            kept = [(a, b) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()) if sets.union(a, b)]
            if kept:
                a, b = zip(*kept)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return in_arrow(links.select("a", "b"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the links (a, b): the smallest id that it reaches.

    Every round hooks each node to its smallest neighbour, follows the hooks two steps, and replaces the links' ends;
    links inside a set go. Only counts reach the driver. Each round's tables are written below
    ``spark.checkpoint.dir`` and those before it removed.
    """
    spark = links.sparkSession
    left = cut(local_forest(links.where("a != b")), "links")
    labels = cut(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("up")), "hook")
        far = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = cut(hook.join(far, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "jump")
        a = jump.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = jump.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        ends = left.join(a, "a").join(b, "b").where("ua != ub")
        moved = ends.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        old = (left, labels, hook, jump)
        onto = jump.select(F.col("node").alias("component"), "up")
        labels = cut(labels.join(onto, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "labels")
        left = cut(local_forest(moved), "links")
        for df in old:
            forget(df)
    return labels

