"""Steps of size-capped label propagation. ``state`` is ``(id, label, frozen, size)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.edges import label_sizes
from graphloom.operators.placed import PlacedEdges
from graphloom.scratch import dealt, per_key, settled

SCORE_DIGITS = 9  # scores are rounded before ranking, so ties do not depend on the order of sums

LABEL_PARTS = 8  # tasks that hear a node


def label_state(labels: DataFrame, cap: int) -> DataFrame:
    """Every node with its label, the label's size, and whether that label is frozen."""
    labels = settled(labels, "labels")
    return labels.join(per_key(label_sizes(labels, cap), "sizes"), "label").select("id", "label", "frozen", "size")


def send_labels(edges: DataFrame, state: DataFrame) -> DataFrame:
    """One message per edge: ``src`` hears the label of ``dst``."""
    return edges.join(state.withColumnRenamed("id", "dst"), "dst").select(
        F.col("src").alias("id"), "label", "frozen", "size", "w"
    )


def label_scores(messages: DataFrame, rows: int | None = None) -> DataFrame:
    """Per node and label that is not frozen: total of weight over label size.

    Few messages of one table's part share node and label, so they are summed after the shuffle only. A node's labels
    go to at most ``LABEL_PARTS`` tasks: its best label is then found with as many rows to shuffle, and a hub is
    heard by as many tasks. ``rows``, where known, is the number of messages.
    """
    live = messages.filter(~F.col("frozen")).select("id", "label", (F.col("w") / F.col("size")).alias("score"))
    apart = live.withColumn("_part", F.pmod(F.xxhash64("label"), F.lit(LABEL_PARTS)).cast("int"))
    return dealt(apart, rows, "id", "_part").groupBy("id", "_part", "label").agg(F.sum("score").alias("score")).drop("_part")


def argmax_label(scores: DataFrame) -> DataFrame:
    """The label with the best score; of equal scores the smallest label."""
    ranked = F.struct(F.round("score", SCORE_DIGITS).alias("score"), (-F.col("label")).alias("label"))
    return scores.groupBy("id").agg(F.max(ranked).alias("best")).select(
        "id", (-F.col("best.label")).alias("new_label"), F.col("best.score").alias("score")
    )


def update_labels(state: DataFrame, best: DataFrame) -> DataFrame:
    """Take the new label unless the node's label is frozen or nothing was heard."""
    stay = F.col("frozen") | F.col("new_label").isNull()
    return state.join(best.select("id", "new_label"), "id", "left").select(
        "id", F.when(stay, F.col("label")).otherwise(F.col("new_label")).alias("label")
    )


def first_step(heard: DataFrame, labels: DataFrame) -> DataFrame:
    """The step in which every node's label is its own id: sizes are 1, none is frozen, and neighbours' labels are their ids.

    ``heard`` are the edges laid out by ``src``, so none of them is sent.
    """
    scores = heard.where("dst is not null").groupBy("src", "dst").agg(F.sum(F.col("w") / F.lit(1).cast("bigint")).alias("score"))
    return take_best(labels.withColumn("frozen", F.lit(False)), scores.select(F.col("src").alias("id"), F.col("dst").alias("label"), "score"))


def lp_iteration(edges: DataFrame | PlacedEdges, labels: DataFrame, cap: int) -> DataFrame:
    """One synchronous step: sizes are those before the step, so the cap is soft."""
    state = label_state(labels, cap)
    return take_best(state, label_scores(messages(edges, state), known_rows(edges)))


def known_rows(edges: DataFrame | PlacedEdges) -> int | None:
    """The number of edges, where they are a table."""
    if isinstance(edges, DataFrame):
        return edges.count() if getattr(edges, "_is_cut", False) else None
    return edges.rows


def messages(edges: DataFrame | PlacedEdges, state: DataFrame) -> DataFrame:
    if isinstance(edges, DataFrame):
        return send_labels(edges, state)
    return edges.meet(state).select(F.col("src").alias("id"), "label", "frozen", "size", "w")


def take_best(state: DataFrame, scores: DataFrame) -> DataFrame:
    """``argmax_label`` and ``update_labels`` in one aggregation, in which a node's scores and its own row meet."""
    ranked = F.struct(F.round("score", SCORE_DIGITS).alias("score"), (-F.col("label")).alias("label"))
    heard = scores.select("id", ranked.alias("best"), F.lit(None).cast(state.schema["label"].dataType).alias("own"), F.lit(False).alias("frozen"))
    own = state.select("id", F.lit(None).cast(heard.schema["best"].dataType).alias("best"), F.col("label").alias("own"), "frozen")
    met = heard.unionByName(own).groupBy("id").agg(F.max("best").alias("best"), F.max("own").alias("own"), F.bool_or("frozen").alias("frozen"))
    stay = F.col("frozen") | F.col("best").isNull()
    return met.where("own is not null").select("id", F.when(stay, F.col("own")).otherwise(-F.col("best.label")).alias("label"))
