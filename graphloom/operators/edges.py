"""Operators on edge tables ``(src, dst, w)`` and label tables ``(id, label)``.

``by`` names grouping columns (such as ``subgraph_id``) that both tables share; graphs in different
groups never mix. Joins carry no broadcast hints: Spark broadcasts a side when its measured size is
below the session's limit and otherwise sorts and merges, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import default_weight
from graphloom.operators.ordering import hash_key, rank_rows
from graphloom.scratch import settled

# ---- projections and set operations


def reverse_edges(edges: DataFrame) -> DataFrame:
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)


def both_directions(edges: DataFrame) -> DataFrame:
    # exploded instead of a union, so that the input is read once
    ends = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.explode(ends).alias("_e"), *others).select(
        *[F.col(f"_e.{c}").alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns]
    )


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def with_default_weight(edges: DataFrame, value: float = 1.0) -> DataFrame:
    return edges.withColumn("w", default_weight("w", value))


def add_self_loops(edges: DataFrame, nodes: DataFrame, w: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """One loop of weight ``w`` per node, added to a loop that is there already."""
    loops = nodes.select(*by, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(w).alias("w"))
    plain = edges.select(*by, "src", "dst", F.col("w").cast("double").alias("w"))
    return sum_duplicate_edges(plain.unionByName(loops), by)


def apply_augmentation(kept: DataFrame, added: DataFrame, dedupe: bool = False) -> DataFrame:
    """Added edges together with the kept ones, as a bag unless ``dedupe``."""
    both = added.unionByName(kept)
    return both.dropDuplicates([c for c in both.columns if c != "w"]) if dedupe else both


def merge_graphs(graphs: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Separate networks as one table; ``(source, subgraph_id)`` names a subgraph."""
    out = None
    for name, df in graphs.items():
        tagged = df.select(F.lit(name).alias(tag), *df.columns)
        out = tagged if out is None else out.unionByName(tagged)
    return out


def distinct_nodes(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    if getattr(edges, "_symmetric", False):  # each node is at both ends, so the one that the edges lie with will do
        return edges.select(*by, F.col(getattr(edges, "_lies_by", None) or "src").alias("id")).distinct()
    # distinct works before and after the shuffle, so a hub's many rows are not moved
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("id")).distinct()


def init_labels(edges: DataFrame) -> DataFrame:
    return distinct_nodes(edges).withColumn("label", F.col("id"))


# ---- aggregations


def out_strength(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and total weight per source."""
    return edges.groupBy(*by, "src").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength")
    )


def degree(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row sums of the adjacency."""
    return edges.groupBy(*by, "src").agg(F.sum("w").alias("degree"))


def sum_duplicate_edges(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return edges.groupBy(*by, "src", "dst").agg(F.sum("w").alias("w"))


def symmetrize_max(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both orientations of every edge with the larger of the two weights."""
    return both_directions(edges).groupBy(*by, "src", "dst").agg(F.max("w").alias("w"))


def incident_weights(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per edge end: node and weight."""
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("id"), "w")


def node_weight_range(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return incident_weights(edges, by).groupBy(*by, "id").agg(
        F.min("w").alias("min_w"), F.max("w").alias("max_w")
    )


def graph_counts(edges: DataFrame) -> DataFrame:
    """One row: nodes and edge rows."""
    nodes = distinct_nodes(edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.lit(0).cast("long").alias("n_edges"))
    rows = edges.agg(F.lit(0).cast("long").alias("n_nodes"), F.count(F.lit(1)).alias("n_edges"))
    return nodes.union(rows).agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"))


def nnz(adjacency: DataFrame, by: Sequence[str] = (), value: str = "w") -> DataFrame:
    """Non-zero cells; rows of the same cell must be summed before."""
    return adjacency.groupBy(*by).agg(F.count(F.when(F.col(value) != 0, 1)).alias("nnz"))


def label_sizes(labels: DataFrame, cap: int) -> DataFrame:
    """Members per label; a label of ``cap`` or more members is frozen."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("frozen", F.col("size") >= cap)


def coarse_node_weight(mapping: DataFrame) -> DataFrame:
    """Original nodes per coarse node."""
    return mapping.groupBy(F.col("label").alias("id")).agg(F.count(F.lit(1)).alias("node_w"))


def coarse_edges(edges: DataFrame, labels: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges between labels: loops dropped, weight summed, rows counted. With ``tasks`` they come dealt by ``src`` into so many."""
    relabelled = drop_self_loops(relabel_edges(edges, labels))
    dealt = relabelled if tasks is None else relabelled.repartition(tasks, "src")
    return dealt.groupBy("src", "dst").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


# ---- joins


def relabel_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace both endpoints by their label."""
    of_src = mapping.select(F.col("id").alias("src"), F.col("label").alias("_src"))
    of_dst = mapping.select(F.col("id").alias("dst"), F.col("label").alias("_dst"))
    return (
        edges.select("src", "dst", "w")
        .join(of_dst, "dst")
        .join(of_src, "src")
        .select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "w")
    )


def induced_edges(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges with both endpoints in the node set."""
    ids = nodes.select(*by, "id")
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.withColumnRenamed("id", end), [*by, end], "left_semi")
    return out.select(*edges.columns)


def flag_members(df: DataFrame, ids: DataFrame, key: str = "id", flag: str = "is_member") -> DataFrame:
    """Boolean column: is the key in the id list?"""
    known = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(flag, F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def new_pairs_only(candidates: DataFrame, edges: DataFrame, by: Sequence[str] = (), dedupe: bool = False) -> DataFrame:
    """Candidate pairs that are not an edge in either direction.

    With ``dedupe`` a pair proposed from both ends is kept once, smaller id first.
    """
    known = both_directions(edges.select(*by, "src", "dst"))
    out = candidates.join(known, [*by, "src", "dst"], "left_anti").select(*candidates.columns)
    if dedupe:
        low, high = F.least("src", "dst"), F.greatest("src", "dst")
        out = out.withColumns({"src": low, "dst": high}).dropDuplicates([*by, "src", "dst"])
    return out


def threshold_join(
    edges: DataFrame,
    thresholds: DataFrame,
    value: str | None,
    how: str = "and",
    by: Sequence[str] = (),
    node_value: str | None = None,
) -> DataFrame:
    """Keep an edge by comparing against a threshold at both ends.

    ``thresholds`` has ``id, threshold``. The compared value is the edge column ``value``, or, when
    that is None, the end's own column ``node_value`` of ``thresholds``. ``how`` joins the two tests.
    """
    out, thresholds = edges, settled(thresholds, "thresholds")
    tests = []
    for end in ("src", "dst"):
        own = [F.col(node_value).alias(f"_{end}_value")] if value is None else []
        side = thresholds.select(*by, F.col("id").alias(end), F.col("threshold").alias(f"_{end}_thr"), *own)
        out = out.join(side, [*by, end])
        compared = F.col(value) if value is not None else F.col(f"_{end}_value")
        tests.append(compared >= F.col(f"_{end}_thr"))
    keep = (tests[0] & tests[1]) if how == "and" else (tests[0] | tests[1])
    return out.filter(keep).select(*edges.columns)


def left_join_default(df: DataFrame, other: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join, replacing the missing values of the named columns."""
    out = df.join(other, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, F.Column) else F.lit(v)) for c, v in defaults.items()})


def compose_levels(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Follow ``fine.label`` into ``coarse.id``: one row per fine id; unmatched keeps its label."""
    nxt = coarse.select(F.col("id").alias("_mid"), F.col("label").alias("_next"))
    return fine.join(nxt, F.col("label") == F.col("_mid"), "left").select(
        "id", F.coalesce("_next", "label").alias("label")
    )


def attach_scores(ids: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(scores, key)


# ---- neighbour lists


def adjacency_list(edges: DataFrame, chunk: int | None = None) -> DataFrame:
    """Neighbours of each source in ascending order, joined by spaces.

    One row a source, with ``part`` 0. With ``chunk``, a list continues after so many neighbours in
    further rows numbered by ``part``, so that a hub need not be one huge value; nothing is left out.
    Neighbours whose ids are text are in ascending order inside a part.
    """
    pairs = edges.select("src", "dst")
    if chunk is None:
        ranked, chunk = pairs.withColumn("rank", F.lit(0).cast("long")), 1
    else:
        # equal order keys of one source are neighbours of the same id: a repeated edge is listed twice
        ranked = rank_rows(pairs, key="dst", by=["src"])
    return (
        ranked.groupBy("src", F.floor(F.col("rank") / chunk).alias("part"))
        .agg(F.sort_array(F.collect_list("dst")).alias("_list"))
        .select("src", "part", F.concat_ws(" ", F.transform("_list", lambda x: x.cast("string"))).alias("neighbours"))
    )


# ---- indexes


def local_index(nodes: DataFrame, by: Sequence[str] = ("subgraph_id",), numeric: bool = True) -> DataFrame:
    """0-based ``local_idx`` inside each group: by id, or by a hash of the id when ids are text."""
    if numeric:
        return rank_rows(nodes, key="id", by=by, name="local_idx").drop("total")
    keyed = nodes.withColumn("_order", hash_key("id"))
    return rank_rows(keyed, key="_order", by=by, ties=["id"], hashed=True, name="local_idx").drop("_order", "total")


def dense_ids(df: DataFrame, numeric: bool = True) -> DataFrame:
    """Global contiguous index ``idx`` from 1, without an unpartitioned window."""
    ranked = local_index(df, by=(), numeric=numeric)
    return ranked.withColumn("idx", F.col("local_idx") + 1).drop("local_idx")
