"""Linear node classifiers on propagated features, and probes of frozen embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.network import Adam, glorot, softmax_rows, stack
from graphloom.operators.features import message_pass
from graphloom.plans.params import sum_over_rows
from graphloom.scratch import cut


def propagate_features(nodes: DataFrame, adj: DataFrame, hops: int, by: Sequence[str], dim: int | None = None) -> DataFrame:
    """Features after ``hops`` neighbour sums over a normalised adjacency with self-loops."""
    out = nodes.select(*by, "id", "features")
    for hop in range(hops):
        out = cut(message_pass(adj, out, by, dim), f"hop{hop + 1}")
    return out


def fit_node_classifier(
    nodes: DataFrame,
    adj: DataFrame,
    hops: int = 2,
    by: Sequence[str] = ("subgraph_id",),
    reg: float = 0.0,
    max_iter: int = 100,
    dim: int | None = None,
) -> tuple[LogisticRegressionModel, DataFrame]:
    """Simplified graph convolution (Wu et al. 2019): propagate, then logistic regression.

    Trains on rows with ``is_masked`` and a known ``label``; gives the model and, for every node,
    ``(by, id, label, is_masked, logits)``.
    """
    by = list(by)
    rows = propagate_features(nodes, adj, hops, by, dim).join(nodes.select(*by, "id", "label", "is_masked"), [*by, "id"])
    rows = cut(rows, "classifier-rows").withColumn("vector", array_to_vector("features"))
    train = rows.filter(F.col("is_masked") & F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double"))
    model = LogisticRegression(
        featuresCol="vector", labelCol="label", family="multinomial", regParam=reg, maxIter=max_iter
    ).fit(train.select("vector", "label"))
    # only the vector is needed: a null label is no obstacle to scoring
    scored = model.transform(rows).withColumn("logits", vector_to_array("rawPrediction"))
    return model, scored.select(*by, "id", "label", "is_masked", "logits")


def logistic_probe(
    emb: DataFrame, repeats: int = 50, steps: int = 100, lr: float = 0.01, seed: int = 0, vec: str = "vec"
) -> DataFrame:
    """Linear classifiers on frozen vectors ``(id, vec, label, is_train)``, as ``(run, accuracy)``.

    Every run starts from other weights and takes ``steps`` full-gradient Adam steps. All runs share
    each pass over the rows, so the number of Spark jobs does not grow with ``repeats``.
    """
    rows = cut(emb.select(F.col(vec).alias("v"), F.col("label").cast("int").alias("label"), "is_train"), "probe-rows")
    dim = len(rows.first()["v"])
    classes = int(rows.agg(F.max("label")).first()[0]) + 1
    train = rows.filter("is_train")
    n = train.count()
    rng = np.random.default_rng(seed)
    params = {
        "w": np.stack([glorot(rng, dim, classes) for _ in range(repeats)]),
        "b": np.zeros((repeats, classes)),
    }
    adam = Adam(lr)
    w_size = params["w"].size

    def logits(pdf: pd.DataFrame, p) -> tuple[np.ndarray, np.ndarray]:
        x = stack(pdf["v"])
        return x, np.einsum("nd,rdc->rnc", x, p["w"], optimize=True) + p["b"][:, None, :]

    for _ in range(steps):
        p = params

        def pull(pdf: pd.DataFrame, p=p) -> np.ndarray:
            x, out = logits(pdf, p)
            g = softmax_rows(out)
            g[:, np.arange(len(x)), pdf["label"].to_numpy()] -= 1.0
            g /= n
            return np.concatenate([np.einsum("nd,rnc->rdc", x, g, optimize=True).ravel(), g.sum(axis=1).ravel()])

        flat = sum_over_rows(train, pull, w_size + params["b"].size)
        grads = {"w": flat[:w_size].reshape(params["w"].shape), "b": flat[w_size:].reshape(params["b"].shape)}
        params = adam.step(params, grads)

    final = params

    def hits(pdf: pd.DataFrame) -> np.ndarray:
        x, out = logits(pdf, final)
        right = out.argmax(axis=2) == pdf["label"].to_numpy()[None, :]
        return np.concatenate([right.sum(axis=1), [len(x)]]).astype(float)

    totals = sum_over_rows(rows.filter("NOT is_train"), hits, repeats + 1)
    accuracy = totals[:repeats] / totals[repeats]
    return emb.sparkSession.createDataFrame(
        [(i, float(a)) for i, a in enumerate(accuracy)], "run int, accuracy double"
    )
