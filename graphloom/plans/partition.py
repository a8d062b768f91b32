"""Cutting a graph into balanced parts: coarsen by label propagation, cut the coarse graph, project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.draws import hash_draw
from graphloom.operators.edges import (
    both_directions,
    coarse_edges,
    coarse_node_weight,
    compose_levels,
    distinct_nodes,
    init_labels,
    left_join_default,
    symmetrize_max,
)
from graphloom.operators import labels as steps
from graphloom.operators.labels import SCORE_DIGITS, lp_iteration
from graphloom.operators.ordering import prefix_sum, rank_rows
from graphloom.operators.placed import PlacedEdges, lies_by, place_edges
from graphloom.operators.sampling import Draw, edge_draw, sample_edges
from graphloom.scratch import Loop, cut, new_path, per_key, settled, tasks_for


def size_cap(n_nodes: int, k: int) -> int:
    """Members at which a label freezes; at least 2, so that something can merge."""
    return max(2, n_nodes // k)


def label_propagation(
    edges: DataFrame | PlacedEdges,
    k: int,
    iterations: int = 3,
    labels: DataFrame | None = None,
    cap: int | None = None,
    heard: DataFrame | None = None,
) -> DataFrame:
    """Size-capped label propagation over ``edges``; ``k`` is the number of parts aimed at.

    A node keeps its label when it hears nothing, so every node of ``labels`` (by default, every
    endpoint) is in the result. ``heard`` are the same edges laid out by ``src``, given if every node starts
    with its own id as its label: the first step then sends no labels.
    """
    loop = Loop("labels")
    placed = place_edges(edges.select("src", "dst", "w"), "dst") if isinstance(edges, DataFrame) else edges
    if labels is None:
        heard = placed.heard()
        labels = init_labels(placed.plain()) if heard is None else heard.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    labels = loop.step(labels)
    cap = size_cap(labels.count(), k) if cap is None else cap
    for i in range(iterations):
        alone = i == 0 and cap > 1 and heard is not None
        labels = loop.step(steps.first_step(heard, labels) if alone else lp_iteration(placed, labels, cap))
    if placed is not edges:
        placed.release()
    return labels


@dataclass
class Coarse:
    """A coarsened graph: ``edges(src, dst, w)``, ``nodes(id, node_w)``, ``levels(level, id, label)``."""

    edges: DataFrame
    nodes: DataFrame
    levels: DataFrame
    rounds: int


def coarsen(
    edges: DataFrame,
    k: int,
    rounds: int = 5,
    lp_iterations: int = 3,
    nbr_upper: int = 100,
    w_ratio: float = 0.1,
    save_ratio: float = 0.2,
    seed: int = 0,
    draw: Draw = edge_draw,
    weighted_cap: bool = False,
    levels_path: str | None = None,
) -> Coarse:
    """Rounds of sampling, label propagation and contraction.

    Each round's mapping is written as one level of a parquet table partitioned by ``level``.
    Nodes whose edges were all sampled out, and communities without outside edges, stay in the
    mapping. The cap counts nodes of the round's graph; ``weighted_cap`` freezes by original nodes.
    """
    if not (rounds > 0 and lp_iterations > 0 and nbr_upper > 0 and 0 < w_ratio < 1 and 0 < save_ratio < 1):
        raise ValueError("rounds, lp_iterations, nbr_upper must be positive; w_ratio, save_ratio in (0, 1)")
    spark = edges.sparkSession
    path = levels_path or new_path(spark, "levels")
    graph = settled(edges if edges.columns == ["src", "dst", "w"] else edges.select("src", "dst", "w"), "graph")
    members = distinct_nodes(graph)
    weights, before = None, None
    for r in range(rounds):
        sampled = sample_edges(graph, nbr_upper, w_ratio, save_ratio, seed + r, draw).select("src", "dst", "w")
        working = place_edges(sampled, "dst")
        if before:
            before.release()
        before = working
        start = members.select("id", F.col("id").alias("label"))
        if weighted_cap and weights is not None:
            total = weights.agg(F.sum("node_w")).first()[0]
            labels = _propagate_weighted(working, start, weights, size_cap(int(total), k), lp_iterations)
        else:
            # the sample of edges laid out by src is taken again where it lies
            labels = label_propagation(working, k, lp_iterations, labels=start, heard=sampled if lies_by(graph, "src") else None)
        write_level(labels, path, r + 1)
        labels = read_levels(spark, path, r + 1)
        # laid out by src, as they are sampled
        tasks = tasks_for(spark, working.rows)
        graph = place_edges(coarse_edges(working.plain(), labels, tasks).select("src", "dst", "w"), "src", buckets=tasks).plain()
        graph._is_cut = True
        members = labels.select(F.col("label").alias("id")).distinct()
        if weighted_cap:
            composed = composed_labels(read_levels(spark, path), r + 1)
            weights = cut(coarse_node_weight(composed), "weights")
    final = sample_edges(graph, nbr_upper, w_ratio, save_ratio, seed + rounds, draw)
    levels = read_levels(spark, path)
    nodes = cut(coarse_node_weight(composed_labels(levels, rounds)), "coarse-nodes")
    coarse = cut(symmetrize_max(final), "coarse-edges")
    before.release()
    return Coarse(coarse, nodes, levels, rounds)


def _propagate_weighted(edges: PlacedEdges, labels: DataFrame, weights: DataFrame, cap: int, iterations: int) -> DataFrame:
    """Label propagation whose sizes and cap count original nodes."""
    loop = Loop("labels")
    labels = loop.step(labels)
    for _ in range(iterations):
        weighed = labels.join(weights, "id")
        sizes = weighed.groupBy("label").agg(F.sum("node_w").alias("size"))
        sizes = per_key(sizes.withColumn("frozen", F.col("size") >= cap), "sizes")
        state = labels.join(sizes, "label").select("id", "label", "frozen", "size")
        labels = loop.step(steps.take_best(state, steps.label_scores(steps.messages(edges, state), edges.rows)))
    return labels


def write_level(labels: DataFrame, path: str, level: int) -> None:
    """Write one round's mapping, replacing that level if it is there."""
    labels.select("id", "label").write.mode("overwrite").parquet(f"{path}/level={level}")


def read_levels(spark, path: str, level: int | None = None) -> DataFrame:
    """``(level, id, label)``, or one level's ``(id, label)`` with the other levels' files pruned."""
    levels = spark.read.option("basePath", path).parquet(path)
    if level is None:
        return levels.select("level", "id", "label")
    return levels.filter(F.col("level") == level).select("id", "label")


def composed_labels(levels: DataFrame, rounds: int) -> DataFrame:
    """Every original node with its label after ``rounds`` levels."""
    out = levels.filter("level = 1").select("id", "label")
    for r in range(2, rounds + 1):
        out = compose_levels(out, levels.filter(F.col("level") == r).select("id", "label"))
    return out


def snake_start(nodes: DataFrame, k: int) -> DataFrame:
    """Parts 0..k-1, k-1..0, ... in descending order of weight."""
    # weights are whole numbers: the hash fraction orders nodes of equal weight and spreads them out
    keyed = nodes.withColumn("_key", -F.col("node_w") + hash_draw("id", seed=1))
    ranked = rank_rows(keyed, key="_key", ties=["id"])
    lap, step = F.floor(F.col("rank") / k), (F.col("rank") % k)
    part = F.when(lap % 2 == 0, step).otherwise(k - 1 - step)
    return ranked.select("id", "node_w", part.cast("int").alias("part"))


def balanced_parts(
    edges: DataFrame,
    nodes: DataFrame,
    k: int,
    sweeps: int = 20,
    slack: float = 0.05,
    seed: int = 0,
    patience: int = 6,
    min_gain: float = 0.001,
) -> DataFrame:
    """Balanced k-way parts of a vertex-weighted graph, as ``(id, node_w, part)``.

    Capacity-penalised label propagation (Spinner, Martella et al. 2017). A node prefers the part
    that holds most of its neighbours' weight and has most room. Of the nodes that want a part, a
    random share as large as its free capacity moves in.
    """
    total = nodes.agg(F.sum("node_w")).first()[0] or 0
    capacity = F.lit(float((1 + slack) * total / k))
    plain = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    strength = per_key(plain.groupBy("src").agg(F.sum("w").alias("strength")), "strength")
    arcs = place_edges(plain.join(strength, "src").select("src", "dst", F.try_divide("w", "strength").alias("share")), "dst")
    state = cut(snake_start(nodes, k), "parts")
    best, best_score, stale = state, None, 0
    for sweep in range(sweeps + 1):
        load = state.groupBy("part").agg(F.sum("node_w").alias("load"))
        # a node hears the parts of its neighbours, and its own part even without a neighbour there
        own = state.select("id", "part", F.lit(0.0).alias("share"), F.lit(1).alias("own"), "node_w")
        heard = (
            arcs.meet(state.select("id", "part"))
            .select(F.col("src").alias("id"), "part", "share", F.lit(0).alias("own"), F.lit(0).cast("bigint").alias("node_w"))
            .unionByName(own)
            .groupBy("id", "part")
            .agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("conn"), F.max("own").alias("own"), F.max("node_w").alias("node_w"))
            .join(per_key(load, "load"), "part", "left")
            .withColumn("load", F.coalesce("load", F.lit(0).cast("bigint")))
        )
        score = F.round(F.col("conn") + 1 - F.col("load") / capacity, SCORE_DIGITS).alias("score")
        mine = F.col("own") == 1
        wishes = cut(
            heard.groupBy("id")
            .agg(
                F.max(F.struct(score, "own", (-F.col("part")).alias("part"), "load")).alias("best"),
                F.max(F.when(mine, F.col("part"))).alias("part"),
                F.max(F.when(mine, F.col("conn"))).alias("conn"),
                F.max("node_w").alias("node_w"),
            )
            .filter("part IS NOT NULL")
            .select("id", "node_w", "part", "conn", (-F.col("best.part")).alias("wish"), F.col("best.load").alias("load")),
            "wishes",
        )
        per_part = wishes.groupBy("part").agg(F.sum("node_w").alias("load"), F.sum("conn").alias("conn"), F.count(F.lit(1)).alias("n"))
        inside, n, fullest = per_part.agg(F.sum("conn"), F.sum("n"), F.max("load") / capacity).first()
        # share of the neighbours inside, less the overload of the fullest part
        score_now = (inside or 0.0) / max(n or 1, 1) - max((fullest or 0.0) - 1.0, 0.0)
        if best_score is not None and score_now < best_score + min_gain * abs(best_score):
            stale += 1
        else:
            stale = 0
        if best_score is None or score_now > best_score:
            best, best_score = wishes.select("id", "node_w", "part"), score_now
        if stale >= patience or sweep == sweeps:
            break
        moves = (F.col("wish") != F.col("part")) & (hash_draw("id", seed=seed * 1009 + sweep) < F.col("rate"))
        state = wishes.join(per_key(_admission(wishes, capacity), "admission"), ["part", "wish"], "left").select(
            "id", "node_w", F.when(moves, F.col("wish")).otherwise(F.col("part")).alias("part")
        )
    arcs.release()
    return best


def _admission(wishes: DataFrame, capacity: Column, damping: float = 0.9) -> DataFrame:
    """Per pair of parts ``(part, wish)`` with movers, the ``rate`` of them that may go.

    As much weight as wants to come the other way is exchanged; beyond that, the movers into a part
    share its free capacity. ``damping`` keeps some back, or two neighbours that want to join each
    other would trade places for ever. The table has at most one row per pair of parts.
    """
    flow = wishes.filter("wish <> part").groupBy("part", "wish").agg(F.sum("node_w").alias("out"), F.max("load").alias("load"))
    back = flow.select(F.col("part").alias("wish"), F.col("wish").alias("part"), F.col("out").alias("back"))
    into = flow.groupBy("wish").agg(F.sum("out").alias("demand"))
    free = F.greatest(capacity - F.col("load"), F.lit(0.0))
    swapped = F.least("out", F.coalesce("back", F.lit(0)))
    return (
        flow.join(back, ["part", "wish"], "left")
        .join(into, "wish")
        .select("part", "wish", (damping * (swapped / F.col("out") + free / F.col("demand"))).alias("rate"))
    )


def project_partition(levels: DataFrame, rounds: int, parts: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Every original node gets the part of its coarse node.

    A node whose coarse node has no part gets one by hash of that last label, so that a lost
    community stays together.
    """
    last = composed_labels(levels, rounds).select(F.col("label"), "id")
    fallback = F.pmod(F.xxhash64("label", F.lit(seed)), F.lit(k)).cast("int")
    known = parts.select(F.col("id").alias("label"), F.col("part").cast("int").alias("part"))
    return left_join_default(last, known, "label", {"part": fallback}).select("id", "part")


def partition_graph(
    edges: DataFrame,
    k: int,
    rounds: int = 5,
    lp_iterations: int = 3,
    nbr_upper: int = 100,
    w_ratio: float = 0.1,
    save_ratio: float = 0.2,
    seed: int = 0,
    sweeps: int = 20,
    slack: float = 0.05,
    undirected: bool = False,
    levels_path: str | None = None,
) -> DataFrame:
    """``(id, part)`` for every node, with at most ``part_limit`` nodes in a part.

    ``undirected=True`` says each edge is given in one direction. The size cap of label propagation
    counts original nodes, so that coarse nodes stay light enough to be balanced.
    """
    graph = both_directions(edges.select("src", "dst", "w")) if undirected else edges
    coarse = coarsen(
        graph, k, rounds, lp_iterations, nbr_upper, w_ratio, save_ratio, seed, weighted_cap=True, levels_path=levels_path
    )
    parts = balanced_parts(coarse.edges, coarse.nodes, k, sweeps, slack, seed)
    return rebalance(project_partition(coarse.levels, rounds, parts, k, seed), graph, k, slack)


def part_limit(n_nodes: int, k: int, slack: float) -> int:
    """Nodes that a part may have: the mean and the slack, and at least the mean rounded up."""
    return max(-(-n_nodes // k), int((1 + slack) * n_nodes / k))


def rebalance(parts: DataFrame, edges: DataFrame, k: int, slack: float = 0.05) -> DataFrame:
    """``(id, part)`` with nodes moved out of overfull parts until none is above ``part_limit``.

    The nodes with the least weight inside their part go first, ties by a hash of the id. They take
    the free places of the other parts, which are numbered part by part, in order.
    """
    parts = cut(parts.select("id", "part"), "projected")
    loads = parts.groupBy("part").agg(F.count(F.lit(1)).alias("load"))
    limit = part_limit(parts.count(), k, slack)
    over = cut(loads.filter(F.col("load") > limit).select("part", (F.col("load") - limit).alias("excess")), "overfull")
    n_moves = over.agg(F.sum("excess")).first()[0]
    if not n_moves:
        return parts
    crowded = parts.join(over, "part")
    # only weights of nodes in overfull parts are asked for
    ends = crowded.select(F.col("id").alias("src"), F.col("part").alias("_src")), parts.select(F.col("id").alias("dst"), F.col("part").alias("_dst"))
    inner = edges.select("src", "dst", F.col("w").cast("double").alias("w")).join(ends[0], "src").join(ends[1], "dst")
    held = per_key(inner.filter("_src = _dst").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("held")), "held")
    order = F.round(F.coalesce("held", F.lit(0.0)), SCORE_DIGITS) + hash_draw("id", seed=2) / 10.0**SCORE_DIGITS
    ranked = rank_rows(crowded.join(held, "id", "left").withColumn("_order", order), key="_order", by=["part"], ties=["id"])
    leaving = ranked.filter(F.col("rank") < F.col("excess")).select("id", hash_draw("id", seed=3).alias("_order"))
    movers = rank_rows(cut(leaving, "movers"), key="_order", ties=["id"]).select("id", F.col("rank").alias("place"))
    all_parts = parts.sparkSession.range(k).select(F.col("id").cast("int").alias("part"))
    free = all_parts.join(loads, "part", "left").select("part", (limit - F.coalesce("load", F.lit(0))).alias("free"))
    # one row a part
    numbered = prefix_sum(free.filter("free > 0"), "free", key="part")
    wanted = numbered.filter(F.col("before") < n_moves)
    last = F.least(F.col("before") + F.col("free"), F.lit(n_moves)) - 1
    places = wanted.select(F.col("part").alias("_to"), F.explode(F.sequence(F.col("before"), last)).alias("place"))
    moved = cut(movers.join(places, "place").select("id", "_to"), "moves")
    return parts.join(moved, "id", "left").select("id", F.coalesce("_to", "part").alias("part"))


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: weight of all edges and weight of edges between parts."""
    of = {e: parts.select(F.col("id").alias(e), F.col("part").alias(f"{e}_part")) for e in ("src", "dst")}
    joined = edges.join(of["src"], "src").join(of["dst"], "dst")
    crossing = F.when(F.col("src_part") != F.col("dst_part"), F.col("w")).otherwise(0)
    return joined.agg(F.sum("w").alias("total_w"), F.sum(crossing).alias("cut_w"))
