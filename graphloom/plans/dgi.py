"""Contrastive node embedding: real nodes against corrupted ones, each scored with its subgraph's summary.

The neighbour sums of the real and the corrupted view do not depend on the parameters, so they are
computed once with joins. A training step is then three passes over rows in Arrow batches: summaries,
gradients of the summaries, gradients of the parameters. The per-subgraph sums in between are small
tables; rows of one subgraph may lie in any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.network import Adam, glorot, logistic, softplus, stack
from graphloom.functions.scalars import row_normalize
from graphloom.operators.edges import add_self_loops
from graphloom.operators.features import normalize_adjacency, shuffle_features
from graphloom.plans.gcn import aggregate_neighbours
from graphloom.plans.params import Params, flatten, sum_over_rows, unflatten
from graphloom.scratch import cut, settled


@dataclass
class DgiModel:
    """``w`` (features x hidden), ``b``, PReLU slope ``a``, discriminator ``d`` (hidden x hidden) and ``d0``."""

    params: Params
    best_epoch: int = 0
    history: list[float] = field(default_factory=list)


def init_dgi(dim: int, hidden: int, seed: int) -> DgiModel:
    rng = np.random.default_rng(seed)
    return DgiModel(
        {
            "w": glorot(rng, dim, hidden),
            "b": np.zeros(hidden),
            "a": np.array([0.25]),
            "d": glorot(rng, hidden, hidden),
            "d0": np.zeros(1),
        }
    )


def propagated(
    nodes: DataFrame, edges: DataFrame, dim: int, by: Sequence[str], features: DataFrame | None = None
) -> DataFrame:
    """``(by, id, z)``: row-normalised features summed over the symmetric normalised A+I."""
    looped = add_self_loops(edges, nodes, 1.0, by)
    adj = normalize_adjacency(looped, nodes, "sym", by=by)
    rows = (features if features is not None else nodes).select(*by, "id", row_normalize("features").alias("features"))
    return aggregate_neighbours(adj, rows, by, dim, concat_self=False)


def views(
    nodes: DataFrame,
    edges: DataFrame,
    by: Sequence[str] = ("subgraph_id",),
    corruption: str = "shuffle",
    augmented: DataFrame | None = None,
    seed: int = 0,
    order: Column | None = None,
) -> DataFrame:
    """``(by, id, z, zc)``: the real view and the corrupted one.

    ``shuffle`` permutes the feature rows inside each subgraph; ``edges`` uses the same features on
    the ``augmented`` edges.
    """
    by = list(by)
    nodes = settled(nodes.select(*by, "id", "features"), "dgi-nodes")
    dim = len(nodes.first()["features"])
    real = propagated(nodes, edges, dim, by)
    if corruption == "shuffle":
        fake = propagated(nodes, edges, dim, by, shuffle_features(nodes, seed, by, order))
    elif corruption == "edges":
        if augmented is None:
            raise ValueError("corruption='edges' needs augmented edges")
        fake = propagated(nodes, augmented, dim, by)
    else:
        raise ValueError(f"unknown corruption {corruption}")
    return real.join(fake.withColumnRenamed("z", "zc"), [*by, "id"])


def _encode(p: Params, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pre = z @ p["w"] + p["b"]
    return np.where(pre > 0, pre, p["a"][0] * pre), pre


def _group_sums(
    rows: DataFrame, by: list[str], width: int, part
) -> DataFrame:
    """Per-group sums of ``part(batch)``: summed per batch and group first, then in Spark."""
    names = [f"s{i}" for i in range(width)]
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in by) + ", n bigint, part array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                values = part(pdf)
                groups = pdf.groupby(by, sort=False).indices
                keys = [k if isinstance(k, tuple) else (k,) for k in groups]
                out = pd.DataFrame(keys, columns=by)
                out["n"] = [len(i) for i in groups.values()]
                out["part"] = [values[i].sum(axis=0) for i in groups.values()]
                yield out

    partial = rows.mapInPandas(run, schema)
    sums = partial.select(*by, "n", *[F.get("part", F.lit(i)).alias(s) for i, s in enumerate(names)])
    summed = sums.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
    return summed.select(*by, "n", F.array(*names).alias("total"))


def dgi_step(rows: DataFrame, params: Params, by: Sequence[str], n_groups: int) -> tuple[float, Params]:
    """Mean loss over the groups and its gradients."""
    by, p = list(by), params
    hidden = p["w"].shape[1]
    sums = _group_sums(rows, by, hidden, lambda pdf: _encode(p, stack(pdf["z"]))[0])
    # one row per subgraph: its size and summary
    summary = cut(
        sums.select(*by, "n", F.transform("total", lambda x: 1 / (1 + F.exp(-x / F.col("n")))).alias("c")), "summary"
    )
    seen = rows.join(summary, by)

    def pulls(pdf: pd.DataFrame):
        h, pre = _encode(p, stack(pdf["z"]))
        hc, prec = _encode(p, stack(pdf["zc"]))
        c, n = stack(pdf["c"]), pdf["n"].to_numpy()[:, None]
        dc = c @ p["d"].T
        s, sc = (h * dc).sum(axis=1, keepdims=True) + p["d0"], (hc * dc).sum(axis=1, keepdims=True) + p["d0"]
        each = 1.0 / (2.0 * n * n_groups)
        loss = float(((softplus(-s) + softplus(sc)) * each).sum())
        return h, pre, hc, prec, c, n, dc, (logistic(s) - 1) * each, logistic(sc) * each, loss

    def summary_pull(pdf: pd.DataFrame) -> np.ndarray:
        h, _, hc, _, _, _, _, g, gc, _ = pulls(pdf)
        return (g * h + gc * hc) @ p["d"]

    pulled = _group_sums(seen, by, hidden, summary_pull)
    # through the sigmoid and the mean, to each node of the subgraph
    back = F.zip_with("total", "c", lambda t, c: t * c * (1 - c))
    through = cut(
        pulled.drop("n").join(summary, by).select(*by, "n", "c", F.transform(back, lambda x: x / F.col("n")).alias("dm")),
        "summary-pull",
    )
    size = 1 + flatten(p).size

    def param_pull(pdf: pd.DataFrame) -> np.ndarray:
        h, pre, hc, prec, c, _, dc, g, gc, loss = pulls(pdf)
        up, upc = g * dc + stack(pdf["dm"]), gc * dc
        slope = p["a"][0]
        dpre, dprec = up * np.where(pre > 0, 1.0, slope), upc * np.where(prec > 0, 1.0, slope)
        grads = {
            "w": stack(pdf["z"]).T @ dpre + stack(pdf["zc"]).T @ dprec,
            "b": dpre.sum(axis=0) + dprec.sum(axis=0),
            "a": np.array([(up * np.minimum(pre, 0)).sum() + (upc * np.minimum(prec, 0)).sum()]),
            "d": (g * h + gc * hc).T @ c,
            "d0": np.array([g.sum() + gc.sum()]),
        }
        return np.concatenate([[loss], flatten(grads)])

    flat = sum_over_rows(rows.join(through, by), param_pull, size)
    return float(flat[0]), unflatten(flat[1:], p)


def fit_dgi(
    rows: DataFrame | list[DataFrame],
    hidden: int = 32,
    lr: float = 1e-3,
    epochs: int = 20,
    patience: int = 3,
    seed: int = 1,
    by: Sequence[str] = ("subgraph_id",),
    start: DgiModel | None = None,
) -> DgiModel:
    """Train on tables from ``views``; several tables (other shuffles) take turns, one per epoch. ``start`` is a model to go on from.

    Stops after ``patience`` epochs without a better loss and keeps the parameters of the best.
    """
    by = list(by)
    tables = [settled(t, "dgi-rows") for t in (rows if isinstance(rows, list) else [rows])]
    n_groups = tables[0].select(*by).distinct().count()
    model = DgiModel(dict(start.params)) if start else init_dgi(len(tables[0].first()["z"]), hidden, seed)
    adam, best, waited = Adam(lr), float("inf"), 0
    params = model.params
    for epoch in range(epochs):
        loss, grads = dgi_step(tables[epoch % len(tables)], params, by, n_groups)
        model.history.append(loss)
        if loss < best:
            best, waited = loss, 0
            model.params, model.best_epoch = params, epoch
        else:
            waited += 1
            if waited == patience:
                break
        params = adam.step(params, grads)
    return model


def embed_dgi(model: DgiModel, z: DataFrame, by: Sequence[str] = ("subgraph_id",)) -> DataFrame:
    """``(by, id, vec)`` for all nodes of a table with ``z`` (from ``propagated`` or ``views``)."""
    p = model.params
    schema = z.select(*by, "id", F.col("z").alias("vec")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = pdf[[*by, "id"]].copy()
                out["vec"] = list(_encode(p, stack(pdf["z"]))[0])
                yield out

    return z.select(*by, "id", "z").mapInPandas(run, schema)
