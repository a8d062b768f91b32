"""Edge and subgraph sampling, and batches of subgraphs. All draws are seeded and repeatable."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.draws import hash_draw
from graphloom.operators.edges import out_strength
from graphloom.operators.ordering import hash_key, rank_rows
from graphloom.scratch import per_key, settled

Draw = Callable[[str, str, int], Column]


def edge_draw(src: str, dst: str, seed: int) -> Column:
    return hash_draw(src, dst, seed=seed)


def sample_edges(
    edges: DataFrame,
    nbr_upper: int = 100,
    w_ratio: float = 0.1,
    save_ratio: float = 0.2,
    seed: int = 0,
    draw: Draw = edge_draw,
) -> DataFrame:
    """Thin out the edges of each source.

    Keeps an edge that carries more than ``w_ratio`` of its source's weight, and others with
    probability ``min(nbr_upper / degree, save_ratio)``. Degrees are counted with partial sums and
    joined back, so that a hub's edges need not meet in one task.
    """
    edges = settled(edges)
    stats = per_key(out_strength(edges), "strength")
    share = F.col("w").cast("double") / F.col("strength")
    keep_rate = F.least(F.lit(float(nbr_upper)) / F.col("degree"), F.lit(float(save_ratio)))
    return (
        edges.join(stats, "src")
        .filter((share > w_ratio) | (draw("src", "dst", seed) < keep_rate))
        .select(*edges.columns)
    )


def sample_subgraphs(
    ids: DataFrame, ratio: float, seed: int = 0, replace: bool = True, key: str = "subgraph_id", draw: Draw = edge_draw
) -> DataFrame:
    """``int(ratio * k)`` subgraph ids: with replacement (column ``draw_no``), or the first by hash."""
    ranked = rank_rows(ids.select(key).distinct(), key=key, name="pos")
    k = ranked.count()
    m = int(ratio * k)
    if not replace:
        hashed = ids.select(key).distinct().withColumn("_h", hash_key(key, seed=seed))
        picked = rank_rows(hashed, key="_h", ties=[key], hashed=True, name="draw_no")
        return picked.filter(F.col("draw_no") < m).select("draw_no", key)
    draws = ids.sparkSession.range(m).select(F.col("id").alias("draw_no"))
    at = F.floor(draw("draw_no", "draw_no", seed) * k)
    return draws.withColumn("pos", at).join(ranked, "pos").select("draw_no", key)


def batch_assignment(parts: DataFrame, block_size: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Shuffle the distinct subgraph ids and number every ``block_size`` of them as one batch."""
    ids = parts.select("subgraph_id").distinct()
    if order is None:
        keyed = ids.withColumn("_h", hash_key("subgraph_id", seed=seed))
        ranked = rank_rows(keyed, key="_h", ties=["subgraph_id"], hashed=True, name="_pos")
    else:
        ranked = rank_rows(ids.withColumn("_h", order), key="_h", ties=["subgraph_id"], name="_pos")
    return ranked.select("subgraph_id", F.floor(F.col("_pos") / block_size).cast("int").alias("batch_id"))


def make_batches(
    nodes: DataFrame,
    edges: DataFrame,
    block_size: int,
    seed: int = 0,
    order: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(batch_id, subgraph_id, id, ...)`` and the edges inside each batch.

    ``edges`` is the whole graph ``(src, dst, w)``: edges between two subgraphs of one batch are
    kept, edges that leave the batch are not.
    """
    batches = batch_assignment(nodes, block_size, seed, order)
    batched = nodes.join(batches, "subgraph_id")
    ends: Sequence[str] = ("src", "dst")
    out = edges
    for end in ends:
        out = out.join(batched.select(F.col("id").alias(end), F.col("batch_id").alias(f"_{end}_batch")), end)
    inside = out.filter(F.col("_src_batch") == F.col("_dst_batch"))
    return batched, inside.select(F.col("_src_batch").alias("batch_id"), "src", "dst", "w")


