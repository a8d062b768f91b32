"""Losses and classification metrics as aggregations. 0/0 counts as 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import let, log_sum_exp, predict_class, sigmoid, vector_sum
from graphloom.operators.ordering import prefix_sum


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def row_loss(kind: str, logits: str = "logits", target: str = "target") -> Column:
    """Cross-entropy of one row. ``target`` is the one-hot or multi-label array; [0, 0] costs 0 under softmax."""
    if kind == "softmax":
        return let(log_sum_exp(logits), lambda lse: vector_sum(F.zip_with(logits, target, lambda x, y: y * (lse - x))))
    if kind == "sigmoid":
        cell = F.zip_with(
            logits, target, lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
        )
        return vector_sum(cell) / F.size(logits)
    raise ValueError(f"unknown kind {kind}")


def row_correct(kind: str, logits: str = "logits", target: str = "target") -> Column:
    """1 when the largest logit is the target's class, or the share of right cells for ``sigmoid``."""
    if kind == "softmax":
        return (predict_class(logits) == predict_class(target)).cast("double")
    if kind == "sigmoid":
        right = F.zip_with(logits, target, lambda x, y: ((x > 0) == (y > 0.5)).cast("double"))
        return vector_sum(right) / F.size(logits)
    raise ValueError(f"unknown kind {kind}")


def masked_mean(df: DataFrame, value: Column, mask: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of the masked values over the number of masked rows, and that number ``n``."""
    m = F.col(mask).cast("int")
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(value * m), F.sum(m)).alias(name), F.coalesce(F.sum(m), F.lit(0)).alias("n")
    )


def masked_loss(df: DataFrame, kind: str = "softmax", mask: str = "is_masked", by: Sequence[str] = ()) -> DataFrame:
    return masked_mean(df, row_loss(kind), mask, "loss", by)


def masked_accuracy(df: DataFrame, kind: str = "softmax", mask: str = "is_masked", by: Sequence[str] = ()) -> DataFrame:
    return masked_mean(df, row_correct(kind), mask, "accuracy", by)


def weighted_batch_metric(per_group: DataFrame, metrics: Sequence[str], weight: str = "n") -> DataFrame:
    """Means over groups weighted by masked rows; a group without any counts for nothing."""
    used = per_group.filter(F.col(weight) > 0)
    return used.agg(*[(F.sum(F.col(m) * F.col(weight)) / F.sum(weight)).alias(m) for m in metrics])


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, as ``(name, precision, recall, f1, support)``.

    Further rows are the micro, macro and support-weighted averages.
    """
    cells = confusion(df, label, pred)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    side = cells.select(F.col("label").alias("cls"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"))
    other = cells.select(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"))
    per = (
        side.withColumn("tp", F.col("tp").cast("bigint"))
        .unionByName(other)
        .groupBy("cls")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
        .withColumns(
            {
                "precision": _ratio(F.col("tp"), F.col("predicted")),
                "recall": _ratio(F.col("tp"), F.col("support")),
            }
        )
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    cols = ["name", "precision", "recall", "f1", "support"]
    classes = per.withColumn("name", F.col("cls").cast("string")).select(*cols)
    # the three averages come from one row of sums over the classes
    tp, support, predicted = F.sum("tp"), F.sum("support"), F.sum("predicted")
    w = F.col("support")
    totals = per.agg(
        _ratio(tp, predicted).alias("mp"),
        _ratio(tp, support).alias("mr"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[_ratio(F.sum(F.col(c) * w), F.sum(w)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        support.alias("support"),
    )
    micro_f1 = _ratio(2 * F.col("mp") * F.col("mr"), F.col("mp") + F.col("mr"))
    rows = F.array(
        F.struct(F.lit("micro avg").alias("name"), F.col("mp").alias("precision"), F.col("mr").alias("recall"), micro_f1.alias("f1"), "support"),
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("name"),
                F.col(f"{kind}_precision").alias("precision"),
                F.col(f"{kind}_recall").alias("recall"),
                F.col(f"{kind}_f1").alias("f1"),
                "support",
            )
            for kind in ("macro", "weighted")
        ],
    )
    return classes.unionByName(totals.select(F.inline(rows)))


def f1_scores(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: micro and macro F1. Micro equals accuracy for one label per row."""
    report = class_report(df, label, pred)
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("f1")))
    return report.agg(pick("micro avg").alias("micro_f1"), pick("macro avg").alias("macro_f1"))


def multilabel_f1(df: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    """One row: micro and macro F1 over the classes of a multi-label target; a class is predicted above 0."""
    cells = df.select(F.posexplode(F.arrays_zip(F.col(logits).alias("l"), F.col(target).alias("t"))).alias("cls", "c"))
    hit, truth = F.col("c.l") > 0, F.col("c.t") > 0.5
    count = lambda test: F.sum(test.cast("bigint"))
    per = cells.groupBy("cls").agg(count(hit & truth).alias("tp"), count(hit).alias("predicted"), count(truth).alias("support"))
    # 2 tp / (predicted + support) is the harmonic mean of precision and recall
    f1 = lambda tp, p, s: _ratio(2 * tp, p + s)
    per = per.withColumn("f1", f1(F.col("tp"), F.col("predicted"), F.col("support")))
    return per.agg(
        f1(F.sum("tp"), F.sum("predicted"), F.sum("support")).alias("micro_f1"), F.avg("f1").alias("macro_f1")
    )


def binary_micro_f1(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """F1 of the positive class, predicted by the rounded sigmoid of the score."""
    pred = F.rint(sigmoid(score)).cast("int")
    both = lambda p, t: F.sum(((pred == p) & (F.col(label) == t)).cast("bigint"))
    counts = df.agg(both(1, 1).alias("tp"), both(1, 0).alias("fp"), both(0, 1).alias("fn"))
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by trapezoids; equal scores form one step of the curve.

    Rows are first counted per distinct score; the running count of lower negatives is a
    distributed prefix sum, not a window over the whole table.
    """
    pos = F.sum((F.col(label) == 1).cast("bigint"))
    neg = F.sum((F.col(label) != 1).cast("bigint"))
    steps = df.groupBy(F.col(score).alias("score")).agg(pos.alias("pos"), neg.alias("neg"))
    placed = prefix_sum(steps, "neg", key="score")
    won = F.sum(F.col("pos").cast("double") * (F.col("before").cast("double") + F.col("neg") / 2.0))
    return placed.agg(
        F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
    )


def repeat_summary(runs: DataFrame, value: str = "accuracy") -> DataFrame:
    """Mean and sample deviation over repeated runs."""
    return runs.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("runs"))


def mean_subgraph_loss(losses: DataFrame, value: str = "loss") -> DataFrame:
    """Mean loss over the subgraphs that were used."""
    return losses.agg(F.avg(value).alias("loss"), F.count(F.lit(1)).alias("n_subgraphs"))


def evaluate(scored: DataFrame, kind: str = "softmax", by: Sequence[str] = ("subgraph_id",)) -> DataFrame:
    """One row of loss, accuracy, micro F1, macro F1 and ROC area over the masked rows.

    ``scored`` has ``logits``, one-hot ``target`` and ``is_masked``. Loss and accuracy are means over
    groups weighted by their masked rows. A row of unknown class counts as class 0 for accuracy, F1
    and area, as the position of the largest of equal targets.
    """
    m = F.col("is_masked").cast("int")
    per_group = scored.groupBy(*by).agg(
        F.try_divide(F.sum(row_loss(kind) * m), F.sum(m)).alias("loss"),
        F.try_divide(F.sum(row_correct(kind) * m), F.sum(m)).alias("accuracy"),
        F.sum(m).alias("n"),
    )
    used = scored.filter("is_masked").select(
        predict_class("target").alias("label"), predict_class("logits").alias("pred"), F.element_at("logits", 2).alias("score")
    )
    key = F.lit(1).alias("_one")
    out = weighted_batch_metric(per_group, ["loss", "accuracy"]).select("*", key)
    for part in (f1_scores(used), roc_auc(used).select("auc")):
        out = out.join(part.select("*", key), "_one")
    return out.drop("_one")
