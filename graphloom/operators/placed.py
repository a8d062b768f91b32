"""Edges that stay where they are while node state moves.

A loop joins its edges with the nodes' state in every step. Here the edges are written once as a table bucketed by the
end that listens, so each step shuffles only the state; a bucketed scan is already dealt as the join wants it. The edges of a hub,
a node with more than ``HUB_EDGES`` of them, are dealt over several buckets by a salt, and its state is sent to each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import bucketed, cut, release

HUB_EDGES = 1_000_000


@dataclass
class PlacedEdges:
    edges: DataFrame
    end: str
    by: list[str]
    hubs: DataFrame | None = None
    rows: int | None = None
    symmetric: bool = False  # every edge is there in both directions, with one weight

    def meet(self, state: DataFrame) -> DataFrame:
        """Every edge with the state ``(by, id, ...)`` of the node at its end."""
        keys = [*self.by, self.end]
        moved = state.withColumnRenamed("id", self.end)
        if self.hubs is None:
            return self.edges.join(moved, keys)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        return self.edges.join(moved.join(self.hubs, keys, "left").withColumn("_salt", copies).drop("_parts"), [*keys, "_salt"]).drop("_salt")

    def plain(self) -> DataFrame:
        out = self.edges.drop("_salt")
        out._lies_by = self.end if self.hubs is None and not self.by else None
        return out

    def heard(self) -> DataFrame | None:
        """The edges as ``(src, dst, w)`` that lie with ``src``, if they are the same in both directions."""
        other = "dst" if self.end == "src" else "src"
        return self.edges.select(F.col(self.end).alias("src"), F.col(other).alias("dst"), "w") if self.symmetric else None

    def release(self) -> None:
        release(self.edges)


def place_edges(
    edges: DataFrame, end: str, by: Sequence[str] = (), hub: int | None = None, buckets: int | None = None
) -> PlacedEdges:
    """``edges`` written in buckets of ``(by, end)``; one exchange, and another one only where there are hubs.

    With ``buckets`` they come dealt into so many tasks already, and that exchange is none.
    """
    hub = HUB_EDGES if hub is None else hub
    keys = [*by, end]
    table = bucketed(edges, keys, buckets=buckets)
    rows = table.count()  # from the files' footers
    if rows <= hub:
        return PlacedEdges(table, end, list(by), rows=rows)
    # a bucket has all edges of its ends, so this needs no shuffle
    counts = table.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("_parts"))
    hubs = cut(counts.where("_parts > 1"), "hubs")
    if hubs.isEmpty():
        return PlacedEdges(table, end, list(by), rows=rows)
    others = [c for c in table.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*others), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = bucketed(table.join(hubs, keys, "left").withColumn("_salt", salt).drop("_parts"), [*keys, "_salt"])
    release(table)
    return PlacedEdges(salted, end, list(by), hubs, rows)


def lies_by(edges: DataFrame, end: str) -> bool:
    """Whether ``edges`` is a table that ``plain`` gave, in buckets of ``end`` alone."""
    return getattr(edges, "_lies_by", None) == end
