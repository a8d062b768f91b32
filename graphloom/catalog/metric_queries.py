"""Losses and metrics on the scored labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.common import Catalog, with_
from graphloom.catalog.tables import SCORED_SQL, scored
from graphloom.operators import metrics as M

CATALOG = Catalog()
query = CATALOG.query

# two logits per row; every eleventh row has an unknown class
PRED_SQL = """
pred AS (
  SELECT id, source, is_masked, label, score, -score AS l0, 0.5::DOUBLE * score AS l1,
    CASE WHEN id % 11 = 0 THEN 0 ELSE 1 - label END AS t0, CASE WHEN id % 11 = 0 THEN 0 ELSE label END AS t1 FROM scored
),
losses AS (
  SELECT *, GREATEST(l0, l1) + LN(EXP(l0 - GREATEST(l0, l1)) + EXP(l1 - GREATEST(l0, l1))) AS lse FROM pred
),
per_row AS (
  SELECT *, t0 * (lse - l0) + t1 * (lse - l1) AS soft_loss,
    ((GREATEST(l0, 0) - l0 * t0 + LN(1 + EXP(-ABS(l0)))) + (GREATEST(l1, 0) - l1 * t1 + LN(1 + EXP(-ABS(l1))))) / 2 AS sig_loss,
    CASE WHEN (l1 > l0) = (t1 > t0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS soft_right,
    (CAST((l0 > 0) = (t0 > 0.5) AS INTEGER) + CAST((l1 > 0) = (t1 > 0.5) AS INTEGER)) / 2.0::DOUBLE AS sig_right FROM losses
)"""


def predictions(spark, d):
    hot = F.when(F.col("id") % 11 == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(
        F.array((1 - F.col("label")).cast("double"), F.col("label").cast("double"))
    )
    return scored(spark, d).withColumns({"logits": F.array(-F.col("score"), 0.5 * F.col("score")), "target": hot})


def _masked_sql(value: str, name: str) -> str:
    return (
        with_(SCORED_SQL, PRED_SQL)
        + f"""SELECT source, ROUND(SUM(CASE WHEN is_masked THEN {value} ELSE 0 END) / NULLIF(SUM(CAST(is_masked AS INTEGER)), 0), 6) AS {name},
        CAST(SUM(CAST(is_masked AS INTEGER)) AS BIGINT) AS n FROM per_row GROUP BY 1"""
    )


@query("masked_loss_softmax", _masked_sql("soft_loss", "loss"))
def _(spark, d):
    return M.masked_loss(predictions(spark, d), "softmax", by=["source"]).withColumn("loss", F.round("loss", 6))


@query("masked_loss_sigmoid", _masked_sql("sig_loss", "loss"))
def _(spark, d):
    return M.masked_loss(predictions(spark, d), "sigmoid", by=["source"]).withColumn("loss", F.round("loss", 6))


@query("masked_accuracy_softmax", _masked_sql("soft_right", "accuracy"))
def _(spark, d):
    return M.masked_accuracy(predictions(spark, d), "softmax", by=["source"]).withColumn("accuracy", F.round("accuracy", 6))


@query("masked_accuracy_sigmoid", _masked_sql("sig_right", "accuracy"))
def _(spark, d):
    return M.masked_accuracy(predictions(spark, d), "sigmoid", by=["source"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "weighted_batch_metric",
    with_(SCORED_SQL, PRED_SQL)
    + "SELECT ROUND(AVG(soft_loss), 6) AS loss FROM per_row WHERE is_masked",
)
def _(spark, d):
    per_group = M.masked_loss(predictions(spark, d), by=["source"])
    return M.weighted_batch_metric(per_group, ["loss"]).withColumn("loss", F.round("loss", 6))


REPORT_SQL = """
verdict AS (SELECT label, CASE WHEN score > 0 THEN 1 ELSE 0 END AS pred FROM scored),
classes AS (SELECT DISTINCT label AS cls FROM verdict UNION SELECT DISTINCT pred FROM verdict),
counts AS (
  SELECT cls, (SELECT COUNT(*) FROM verdict WHERE label = cls AND pred = cls) AS tp,
    (SELECT COUNT(*) FROM verdict WHERE label = cls) AS support, (SELECT COUNT(*) FROM verdict WHERE pred = cls) AS predicted FROM classes
),
per_class AS (
  SELECT cls, tp, support, predicted, COALESCE(tp / NULLIF(predicted, 0), 0) AS p, COALESCE(tp / NULLIF(support, 0), 0) AS r FROM counts
),
report AS (
  SELECT CAST(cls AS VARCHAR) AS name, p, r, COALESCE(2 * p * r / NULLIF(p + r, 0), 0) AS f1, support FROM per_class
),
full_report AS (
  SELECT name, p, r, f1, support FROM report
  UNION ALL SELECT 'micro avg', a, a, a, n FROM (SELECT SUM(tp) / SUM(support) AS a, CAST(SUM(support) AS BIGINT) AS n FROM per_class)
  UNION ALL SELECT 'macro avg', AVG(p), AVG(r), AVG(f1), CAST(SUM(support) AS BIGINT) FROM report
  UNION ALL SELECT 'weighted avg', SUM(p * support) / SUM(support), SUM(r * support) / SUM(support), SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM report
)"""


def _verdict(spark, d):
    return scored(spark, d).withColumn("pred", F.when(F.col("score") > 0, 1).otherwise(0))


@query(
    "class_report",
    with_(SCORED_SQL, REPORT_SQL) + "SELECT name, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f1, 6) AS f1, support FROM full_report",
)
def _(spark, d):
    report = M.class_report(_verdict(spark, d))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "f1_scores",
    with_(SCORED_SQL, REPORT_SQL)
    + """SELECT ROUND(MAX(CASE WHEN name = 'micro avg' THEN f1 END), 6) AS micro_f1, ROUND(MAX(CASE WHEN name = 'macro avg' THEN f1 END), 6) AS macro_f1 FROM full_report""",
)
def _(spark, d):
    return M.f1_scores(_verdict(spark, d)).select(F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"))


@query(
    "multilabel_f1",
    with_(SCORED_SQL, PRED_SQL)
    + """, cells AS (SELECT 0 AS cls, l0 > 0 AS p, t0 = 1 AS t FROM pred UNION ALL SELECT 1, l1 > 0, t1 = 1 FROM pred),
    c AS (SELECT cls, SUM(CAST(p AND t AS INTEGER)) AS tp, SUM(CAST(p AS INTEGER)) AS np, SUM(CAST(t AS INTEGER)) AS nt FROM cells GROUP BY 1)
    SELECT ROUND(2.0::DOUBLE * SUM(tp) / (SUM(np) + SUM(nt)), 6) AS micro_f1, ROUND(AVG(2.0::DOUBLE * tp / (np + nt)), 6) AS macro_f1 FROM c""",
)
def _(spark, d):
    out = M.multilabel_f1(predictions(spark, d))
    return out.select(F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"))


@query(
    "binary_micro_f1",
    with_(SCORED_SQL)
    + """, v AS (SELECT label, CASE WHEN 1 / (1 + EXP(-score)) > 0.5 THEN 1 ELSE 0 END AS pred FROM scored),
    c AS (SELECT CAST(SUM(pred * label) AS DOUBLE) AS tp, SUM(pred * (1 - label)) AS fp, SUM((1 - pred) * label) AS fn FROM v)
    SELECT ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / (tp + fn), 6) AS recall, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def _(spark, d):
    return M.binary_micro_f1(scored(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


AUC_SQL = """SELECT ROUND((SUM(CASE WHEN label = 1 THEN r END) - CAST(SUM(label) AS DOUBLE) * (SUM(label) + 1) / 2)
      / (CAST(SUM(label) AS DOUBLE) * SUM(1 - label)), 9) AS auc, CAST(SUM(label) AS BIGINT) AS n_pos, CAST(SUM(1 - label) AS BIGINT) AS n_neg
    FROM (SELECT label, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored)"""


@query("roc_auc", with_(SCORED_SQL) + AUC_SQL)
def _(spark, d):
    return M.roc_auc(scored(spark, d)).withColumn("auc", F.round("auc", 9))


@query(
    "repeat_summary",
    with_(SCORED_SQL, PRED_SQL)
    + """, runs AS (SELECT source, AVG(soft_right) AS accuracy FROM per_row GROUP BY 1)
    SELECT ROUND(AVG(accuracy), 6) AS mean, ROUND(STDDEV_SAMP(accuracy), 6) AS std, COUNT(*) AS runs FROM runs""",
)
def _(spark, d):
    runs = predictions(spark, d).groupBy("source").agg(F.avg(M.row_correct("softmax")).alias("accuracy"))
    return M.repeat_summary(runs).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "runs")


@query(
    "mean_subgraph_loss",
    with_(SCORED_SQL, PRED_SQL)
    + """, runs AS (SELECT source, AVG(sig_loss) AS loss FROM per_row GROUP BY 1)
    SELECT ROUND(AVG(loss), 6) AS loss, COUNT(*) AS n_subgraphs FROM runs""",
)
def _(spark, d):
    losses = predictions(spark, d).groupBy("source").agg(F.avg(M.row_loss("sigmoid")).alias("loss"))
    return M.mean_subgraph_loss(losses).withColumn("loss", F.round("loss", 6))


@query(
    "evaluate",
    with_(
        SCORED_SQL,
        PRED_SQL,
        "used AS (SELECT CASE WHEN t1 > t0 THEN 1 ELSE 0 END AS label, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS pred, l1 AS score, soft_loss, soft_right FROM per_row WHERE is_masked)",
        """f AS (SELECT cls, 2.0::DOUBLE * SUM(CAST(label = cls AND pred = cls AS INTEGER)) /
          NULLIF(SUM(CAST(label = cls AS INTEGER)) + SUM(CAST(pred = cls AS INTEGER)), 0) AS f1 FROM used, (VALUES (0), (1)) c(cls) GROUP BY 1)""",
        """auc AS (SELECT (SUM(CASE WHEN label = 1 THEN r END) - CAST(SUM(label) AS DOUBLE) * (SUM(label) + 1) / 2)
          / (CAST(SUM(label) AS DOUBLE) * SUM(1 - label)) AS auc
          FROM (SELECT label, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM used))""",
    )
    + """SELECT ROUND(AVG(soft_loss), 6) AS loss, ROUND(AVG(soft_right), 6) AS accuracy, ROUND(AVG(soft_right), 6) AS micro_f1,
      ROUND((SELECT AVG(COALESCE(f1, 0)) FROM f), 6) AS macro_f1, ROUND((SELECT auc FROM auc), 6) AS auc FROM used""",
)
def _(spark, d):
    out = M.evaluate(predictions(spark, d), by=["source"])
    return out.select(*[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "micro_f1", "macro_f1", "auc")])
