"""Multi-layer graph convolution trained and applied as joins and aggregations.

The graph never has to fit one task. A layer is a join of the adjacency with the node vectors and a
sum per node; only the dense product with the weights is numpy, on whatever rows a task holds. The
backward pass sends gradients along the reversed edges in the same way. One step therefore covers
any number of subgraphs, of any size, and a subgraph may hold most of all nodes.

A step's loss is the mean over its subgraphs of the masked mean loss. Training takes one step per subgraph in turn;
``groups_per_step=None`` takes all in one step. Subgraphs that fit a task are packed into a row each (``packed``), so a
step reads its own subgraphs and one job gives their gradient. Larger ones are stepped over by the joins above.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.network import LN_EPS, Adam, glorot, repeatable_keep, stack
from graphloom.functions.scalars import layer_norm
from graphloom.operators.vectors import sum_vectors
from graphloom.plans.packed import MOST, SCORED, Packed, pack_subgraphs, packed_gradients, subgraph_scores, top
from graphloom.plans.params import Params, load_params, save_params, sum_arrays, unflatten
from graphloom.scratch import Loop, cut, settled, tasks_of_groups

# ---- one layer as an operator


def dense(features: str, weight: np.ndarray):
    """Row vector times matrix, in Arrow batches."""
    w = np.asarray(weight, dtype=float)

    @F.pandas_udf("array<double>")
    def product(rows: pd.Series) -> pd.Series:
        return pd.Series(list(stack(rows) @ w)) if len(rows) else pd.Series([], dtype=object)

    return product(features)


def gcn_layer(
    adj: DataFrame,
    x: DataFrame,
    weight: np.ndarray,
    by: Sequence[str] = (),
    concat_self: bool = True,
    norm: tuple[Sequence[float], Sequence[float]] | None = None,
    act: Callable | None = None,
    bias: Sequence[float] | None = None,
    propagate: bool = True,
) -> DataFrame:
    """``act(LN([A·X, X]·W))``; without ``concat_self`` ``act(LN(A·X·W + b))``; without ``propagate`` no A."""
    by = list(by)
    dim = len(weight) // 2 if concat_self and propagate else len(weight)
    if propagate:
        z = aggregate_neighbours(adj, x, by, dim, concat_self)
    else:
        z = x.select(*by, "id", F.col("features").alias("z"))
    out = dense("z", weight)
    if bias is not None:
        out = F.zip_with(out, F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b)
    rows = z.withColumn("features", out)
    if norm is not None:
        rows = rows.withColumn("features", layer_norm("features", *norm))
    if act is not None:
        rows = rows.withColumn("features", act("features"))
    return rows.select(*by, "id", "features")


NARROW = 16


def aggregate_neighbours(
    adj: DataFrame, x: DataFrame, by: Sequence[str], dim: int, concat_self: bool = True, features: str = "features"
) -> DataFrame:
    """``(by, id, z)`` with ``z = [A·X, X]`` or ``A·X``, for every node of ``x``.

    The neighbours' sum and the node's own vector meet in one aggregation, which also keeps nodes
    without neighbours. Wide vectors are summed whole, narrow ones a column an element.
    """
    by = list(by)
    if dim > NARROW:
        met = adj.join(x.select(*by, F.col("id").alias("col"), features), [*by, "col"])
        heard = sum_vectors(met.select(*by, F.col("row").alias("id"), "val", features), [*by, "id"], features, "val")
        zeros = F.array_repeat(F.lit(0.0), dim)
        rows = x.select(*by, "id", F.col(features).cast("array<double>").alias("_own")).join(heard, [*by, "id"], "left")
        total = F.coalesce("vec", zeros)
        return rows.select(*by, "id", (F.concat(total, "_own") if concat_self else total).alias("z"))
    s, t = [f"s{i}" for i in range(dim)], [f"t{i}" for i in range(dim)]
    vec = [F.get(features, F.lit(i)) for i in range(dim)]
    met = adj.join(x.select(*by, F.col("id").alias("col"), features), [*by, "col"])
    heard = met.select(*by, F.col("row").alias("id"), *[(F.col("val") * v).alias(n) for v, n in zip(vec, s)])
    own = x.select(*by, "id", *[F.lit(0.0).alias(n) for n in s])
    if concat_self:
        heard = heard.select("*", *[F.lit(0.0).alias(n) for n in t])
        own = x.select(*by, "id", *[F.lit(0.0).alias(n) for n in s], *[v.alias(n) for v, n in zip(vec, t)])
    names = s + (t if concat_self else [])
    summed = heard.unionByName(own).groupBy(*by, "id").agg(*[F.sum(n).alias(n) for n in names])
    return summed.select(*by, "id", F.array(*names).alias("z"))


# ---- the network


@dataclass
class GcnModel:
    """Layer sizes and parameters ``w{l}``, and ``offset{l}``, ``scale{l}`` of normalised layers."""

    params: Params
    n_layers: int
    norm: bool = True
    precalc: str | bool = True
    kind: str = "softmax"
    history: list[dict] = field(default_factory=list)

    def layer(self, i: int) -> dict:
        last = i == self.n_layers
        p = self.params
        return {
            "w": p[f"w{i}"],
            "offset": p.get(f"offset{i}"),
            "scale": p.get(f"scale{i}"),
            "relu": not last,
        }


def init_gcn(
    dim: int, classes: int, layers: int, hidden: int, norm: bool, precalc: str | bool, seed: int, kind: str = "softmax"
) -> GcnModel:
    rng = np.random.default_rng(seed)
    params: Params = {}
    for i in range(1, layers + 1):
        rows = (dim if precalc else 2 * dim) if i == 1 else 2 * hidden
        cols = classes if i == layers else hidden
        params[f"w{i}"] = glorot(rng, rows, cols)
        if norm and i < layers:
            params[f"offset{i}"], params[f"scale{i}"] = np.zeros(cols), np.ones(cols)
    return GcnModel(params, layers, norm, precalc, kind)


def save_gcn(spark: SparkSession, model: GcnModel, path: str) -> None:
    """Parameters and shape of a model, as two small tables below ``path``."""
    save_params(spark, model.params, f"{path}/params")
    shape = [(model.n_layers, model.norm, json.dumps(model.precalc), model.kind)]
    spark.createDataFrame(shape, "n_layers int, norm boolean, precalc string, kind string").write.mode("overwrite").parquet(f"{path}/shape")


def load_gcn(spark: SparkSession, path: str) -> GcnModel:
    shape = spark.read.parquet(f"{path}/shape").first()
    return GcnModel(load_params(spark, f"{path}/params"), shape["n_layers"], shape["norm"], json.loads(shape["precalc"]), shape["kind"])


def _forward_rows(layer: dict, z: np.ndarray) -> tuple[np.ndarray, dict]:
    out = z @ layer["w"]
    memo = {}
    if layer["scale"] is not None:
        mean = out.mean(axis=1, keepdims=True)
        root = np.sqrt(out.var(axis=1, keepdims=True) + LN_EPS)
        memo["hat"], memo["root"] = (out - mean) / root, root
        out = memo["hat"] * layer["scale"] + layer["offset"]
    if layer["relu"]:
        memo["on"] = out > 0
        out = out * memo["on"]
    return out, memo


def _backward_rows(layer: dict, z: np.ndarray, memo: dict, up: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Gradient with respect to ``z``, and the summed gradients of the layer's parameters."""
    grads = {}
    if layer["relu"]:
        up = up * memo["on"]
    if layer["scale"] is not None:
        hat = memo["hat"]
        grads["scale"], grads["offset"] = (up * hat).sum(axis=0), up.sum(axis=0)
        up = up * layer["scale"]
        up = (up - up.mean(axis=1, keepdims=True) - hat * (up * hat).mean(axis=1, keepdims=True)) / memo["root"]
    grads["w"] = z.T @ up
    return up @ layer["w"].T, grads


def first_input(nodes: DataFrame, adj: DataFrame, dim: int, precalc: str | bool, by: Sequence[str]) -> DataFrame:
    """Input of layer 1: A·X, computed once; X itself with ``precalc="skip"``; [A·X, X] without precalc."""
    if precalc == "skip":
        return nodes.select(*by, "id", F.col("features").alias("z"))
    return aggregate_neighbours(adj, nodes, by, dim, concat_self=not precalc)


def _apply_layer(z: DataFrame, layer: dict, by: Sequence[str], dropout: tuple[float, int] | None) -> DataFrame:
    rate, seed = dropout or (0.0, 0)
    schema = z.select(*by, "id", F.col("z").alias("features")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                rows = stack(pdf["z"])
                if rate:
                    rows = rows * repeatable_keep(pdf["_h"].to_numpy(), rows.shape[1], rate, seed)
                out = pdf[[*by, "id"]].copy()
                out["features"] = list(_forward_rows(layer, rows)[0])
                yield out

    hashed = z.select(*by, "id", "z", F.xxhash64(*by, "id").alias("_h"))
    return hashed.mapInPandas(run, schema)


def _inputs(model: GcnModel, z1: DataFrame, adj: DataFrame, by: Sequence[str], dropout: float, seed: int) -> list[DataFrame]:
    """The input table of every layer, each cut because the backward pass reads it again."""
    zs = [z1]
    for i in range(1, model.n_layers):
        layer = model.layer(i)
        hidden = layer["w"].shape[1]
        out = _apply_layer(zs[-1], layer, by, (dropout, seed * 100 + i) if dropout else None)
        zs.append(cut(aggregate_neighbours(adj, out, by, hidden), f"layer{i + 1}"))
    return zs


def _gradients(
    model: GcnModel, zs: list[DataFrame], targets: DataFrame, adj: DataFrame, by: Sequence[str], dropout: float, seed: int
) -> tuple[float, float, Params]:
    """Loss, share of right rows, and gradients. ``targets`` is ``(by, id, target, share)``: one-hot row and weight of the row's loss."""
    by = list(by)
    reverse = adj.select(*by, F.col("col").alias("row"), F.col("row").alias("col"), "val")
    total: Params = {}
    kind = model.kind
    loss = right = 0.0
    up: DataFrame | None = None
    for i in range(model.n_layers, 0, -1):
        layer, last = model.layer(i), i == model.n_layers
        names = ["w"] + (["scale", "offset"] if layer["scale"] is not None else [])
        like = {n: layer[n] for n in names}
        size = 2 + sum(v.size for v in like.values())
        side = targets if last else up
        rows = zs[i - 1].join(side, [*by, "id"]).withColumn("_h", F.xxhash64(*by, "id"))
        schema = rows.select(*by, "id", F.col("z").alias("down"), F.lit(None).cast("binary").alias("grads")).schema
        drop_seed = seed * 100 + i

        def run(batches, layer=layer, last=last, size=size, names=names, drop_seed=drop_seed):
            flat = np.zeros(size)
            for pdf in batches:
                if not len(pdf):
                    continue
                z = stack(pdf["z"])
                keep = repeatable_keep(pdf["_h"].to_numpy(), z.shape[1], dropout, drop_seed) if dropout else None
                z = z if keep is None else z * keep
                out, memo = _forward_rows(layer, z)
                if last:
                    cost, hit, grad = top(kind, out, stack(pdf["target"]), pdf["share"].to_numpy()[:, None])
                    flat[:2] += cost, hit
                else:
                    grad = stack(pdf["up"])
                down, grads = _backward_rows(layer, z, memo, grad)
                down = down if keep is None else down * keep
                flat[2:] += np.concatenate([grads[n].ravel() for n in sorted(names)])
                res = pdf[[*by, "id"]].copy()
                res["down"] = list(down)
                res["grads"] = None
                yield res
            # the task's share of the parameter gradients travels as one more row
            yield pd.DataFrame({**{c: [None] for c in [*by, "id"]}, "down": [None], "grads": [flat.tobytes()]})

        both = cut(rows.mapInPandas(run, _nullable(schema)), f"back{i}")
        flat = sum_arrays(both.filter("grads IS NOT NULL"), "grads", size)
        loss, right = loss + flat[0], right + flat[1]
        for n, g in unflatten(flat[2:], like).items():
            total[f"{n}{i}"] = g
        if i > 1:
            width = model.layer(i - 1)["w"].shape[1]
            up = _route_back(both.filter("down IS NOT NULL"), reverse, by, width)
    return loss, right, total


def _nullable(schema):
    for f in schema.fields:
        f.nullable = True
    return schema


def _route_back(down: DataFrame, reverse: DataFrame, by: list[str], width: int) -> DataFrame:
    """Gradient of a layer's output: its neighbours' part along reversed edges plus its own part."""
    if width > NARROW:
        met = reverse.join(down.select(*by, F.col("id").alias("col"), F.slice("down", 1, width).alias("down")), [*by, "col"])
        heard = met.select(*by, F.col("row").alias("id"), "val", "down")
        own = down.select(*by, "id", F.lit(1.0).alias("val"), F.slice("down", width + 1, width).alias("down"))
        return sum_vectors(heard.unionByName(own), [*by, "id"], "down", "val").withColumnRenamed("vec", "up")
    parts = [f"d{i}" for i in range(width)]
    met = reverse.join(down.select(*by, F.col("id").alias("col"), "down"), [*by, "col"])
    heard = met.select(*by, F.col("row").alias("id"), *[(F.col("val") * F.get("down", F.lit(i))).alias(p) for i, p in enumerate(parts)])
    own = down.select(*by, "id", *[F.get("down", F.lit(width + i)).alias(p) for i, p in enumerate(parts)])
    summed = heard.unionByName(own).groupBy(*by, "id").agg(*[F.sum(p).alias(p) for p in parts])
    return summed.select(*by, "id", F.array(*parts).alias("up"))


def _packed_step(model: GcnModel, rows: DataFrame, n: int, groups: int, dropout: float, seed: int) -> np.ndarray:
    """Loss, share of right rows and gradients, flat, of ``n`` packed subgraphs of a step of ``groups``."""
    layers = [model.layer(i) for i in range(1, model.n_layers + 1)]
    classes = layers[-1]["w"].shape[1]
    run = packed_gradients(layers, model.kind, classes, groups, dropout, seed, _forward_rows, _backward_rows)
    return sum_arrays(rows.mapInArrow(run, "part binary"), "part", 2 + sum(v.size for v in model.params.values()), few=n <= 8)


def _by_layer(model: GcnModel, flat: np.ndarray) -> Params:
    out, at = {}, 0
    for i in range(1, model.n_layers + 1):
        for name in sorted(n for n in ("w", "scale", "offset") if f"{n}{i}" in model.params):
            like = model.params[f"{name}{i}"]
            out[f"{name}{i}"] = flat[at : at + like.size].reshape(like.shape)
            at += like.size
    return out


def gcn_step(
    model: GcnModel, packed: Packed, numbers: Sequence[int], by: str, dropout: float = 0.0, seed: int = 0
) -> tuple[float, float, Params]:
    """Loss, accuracy and gradients over the subgraphs of these numbers: one job for those that are packed, joins for the others."""
    large = [i for i in numbers if i in packed.large]
    small = [i for i in numbers if i not in packed.large]
    loss, right, total = 0.0, 0.0, {k: np.zeros_like(v) for k, v in model.params.items()}
    if small:
        flat = _packed_step(model, packed.some("rows", small), len(small), len(numbers), dropout, seed)
        loss, right, total = flat[0], flat[1], _by_layer(model, flat[2:])
    if large:
        nodes, edges = packed.some("nodes", large), packed.some("edges", large)
        share = F.when(F.col("is_masked"), 1.0 / (F.col("n") * float(len(numbers)))).otherwise(0.0)
        targets = nodes.select(by, "id", "target", share.alias("share"))
        adj = edges.select(by, "row", "col", "val")
        zs = _inputs(model, nodes.select(by, "id", "z"), adj, [by], dropout, seed)
        more_loss, more_right, more = _gradients(model, zs, targets, adj, [by], dropout, seed)
        loss, right, total = loss + more_loss, right + more_right, {k: total[k] + more[k] for k in total}
    return float(loss), float(right), total


def fit_gcn(
    nodes: DataFrame,
    adj: DataFrame,
    layers: int = 5,
    hidden: int = 128,
    lr: float = 0.01,
    epochs: int = 10,
    dropout: float = 0.0,
    weight_decay: float = 0.0,
    norm: bool = True,
    precalc: str | bool = True,
    early_stopping: int = 1000,
    groups_per_step: int | None = 1,
    validation: tuple[DataFrame, DataFrame] | None = None,
    seed: int = 1,
    by: str = "subgraph_id",
    kind: str = "softmax",
    shuffle: bool = True,
    start: GcnModel | None = None,
    most: int = MOST,
) -> GcnModel:
    """Train on ``nodes(by, id, features, target, is_masked)`` and normalised ``adj(by, row, col, val)``.

    ``target`` is the one-hot array, in which a row of zeros is an unknown class, or with ``kind="sigmoid"`` the array of
    labels. Each epoch takes the subgraphs in another order, ``groups_per_step`` in a step; without ``shuffle`` in order of
    their ids. ``start`` is a model to go on from. ``history`` of the result has an entry per epoch: mean loss over the
    steps, loss of the first, loss and accuracy of the last step, ``seconds`` of training, and with ``validation=(nodes, adj)`` loss,
    accuracy, micro and macro F1 of that. Subgraphs of more than ``most`` nodes and edges are not held by a task.
    """
    if layers < 2:
        raise ValueError("at least two layers")
    keys = [by]
    nodes, adj = settled(nodes, "gcn-nodes"), settled(adj, "gcn-adj")
    first = nodes.select("features", "target").first()
    dim, classes = len(first["features"]), len(first["target"])
    model = start or init_gcn(dim, classes, layers, hidden, norm, precalc, seed, kind)
    z1 = cut(first_input(nodes, adj, dim, model.precalc, keys), "gcn-input")
    packed = pack_subgraphs(z1, nodes, adj, by, most)
    per_step = groups_per_step or packed.groups
    rng = np.random.default_rng(seed)
    adam = Adam(lr)
    costs: list[float] = []
    for epoch in range(epochs):
        begun = time.time()
        order = (rng.permutation(packed.groups) if shuffle else np.arange(packed.groups)).tolist()
        losses = []
        for step, at in enumerate(range(0, len(order), per_step)):
            loss, accuracy, grads = gcn_step(model, packed, order[at : at + per_step], by, dropout, seed + epoch * packed.groups + step)
            if weight_decay:
                for name in [n for n in grads if n.rstrip("0123456789") + "1" == n]:
                    loss += weight_decay * 0.5 * float((model.params[name] ** 2).sum())
                    grads[name] = grads[name] + weight_decay * model.params[name]
            model.params = adam.step(model.params, grads)
            losses.append(loss)
        record = {"epoch": epoch + 1, "loss": float(np.mean(losses)), "first_loss": losses[0], "last_loss": loss, "accuracy": accuracy, "seconds": time.time() - begun}
        if validation is not None:
            record |= {f"val_{k}": v for k, v in validate(model, *validation, by=by).items()}
            costs.append(record["val_loss"])
        model.history.append(record)
        if costs and epoch > early_stopping and costs[-1] > np.mean(costs[-(early_stopping + 1) : -1]):
            break
    return model


def validate(model: GcnModel, nodes: DataFrame, adj: DataFrame, by: str = "subgraph_id") -> dict[str, float]:
    """Loss and accuracy as means over subgraphs weighted by masked rows, micro and macro F1 over all masked rows."""
    from graphloom.operators.metrics import evaluate, masked_accuracy, masked_loss, multilabel_f1, weighted_batch_metric

    scored = cut(predict_gcn(model, nodes, adj, by).join(nodes.select(by, "id", "target", "is_masked"), [by, "id"]), "scored")
    if model.kind == "softmax":
        return {k: v for k, v in evaluate(scored, by=[by]).first().asDict().items() if k != "auc"}
    groups = masked_loss(scored, model.kind, by=[by]).join(masked_accuracy(scored, model.kind, by=[by]).drop("n"), by)
    out = weighted_batch_metric(groups, ["loss", "accuracy"]).first().asDict()
    return out | multilabel_f1(scored.where("is_masked")).first().asDict()


def predict_gcn(model: GcnModel, nodes: DataFrame, adj: DataFrame, by: str = "subgraph_id", most: int = MOST) -> DataFrame:
    """``(by, id, logits, p)`` for all nodes; ``p`` is the raw logit of class 1.

    A subgraph of at most ``most`` nodes and edges, whose widest layer fits a task, goes up all layers there; its vectors are neither
    shuffled nor written. Larger ones, and layers too narrow to matter, go up by a join a layer.
    """
    keys = [by]
    rows = model.params["w1"].shape[0]
    dim = rows if model.precalc else rows // 2
    adj = settled(adj, "gcn-adj")
    z = first_input(nodes, adj, dim, model.precalc, keys)
    if model.n_layers == 1 or model.params["w1"].shape[1] <= NARROW:
        out = _joined_scores(model, z, adj, keys)
    else:
        z = cut(z, "gcn-input")
        widest = max(model.params[f"w{i}"].shape[1] for i in range(1, model.n_layers + 1))
        arcs = adj.groupBy(by).agg(F.count(F.lit(1)).alias("edges"))
        sizes = z.groupBy(by).agg(F.count(F.lit(1)).alias("size")).join(arcs, by, "left")
        is_large = (F.col("size") + F.coalesce("edges", F.lit(0)) > most) | (F.col("size") * widest > SCORED)
        groups = cut(sizes.select(F.col(by).alias("_group"), is_large.alias("large")), "groups")
        large, same = groups.where("large").select("_group"), F.col(by).eqNullSafe(F.col("_group"))
        if large.isEmpty():
            out = _held_scores(model, z, adj, by, groups.count())
        else:
            held = _held_scores(model, z.join(large, same, "left_anti"), adj.join(large, same, "left_anti"), by, groups.count())
            out = held.unionByName(_joined_scores(model, z.join(large, same, "left_semi"), adj.join(large, same, "left_semi"), keys))
    return out.select(by, "id", F.col("features").alias("logits"), F.element_at("features", 2).alias("p"))


def _held_scores(model: GcnModel, z: DataFrame, adj: DataFrame, by: str, groups: int) -> DataFrame:
    """Last layer's output of subgraphs that fit a task."""
    n = tasks_of_groups(z.sparkSession, groups)
    kinds = dict(z.dtypes)
    # ends are looked up among ids, so they have their type; edges without an end or a subgraph reach no node
    ends = [F.expr(f"try_cast(`{c}` AS {kinds[to]})").alias(c) for c, to in ((by, by), ("row", "id"), ("col", "id"))]
    arcs = adj.select(*ends, F.col("val").cast("double").alias("val")).where(f"`{by}` IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL")
    run = subgraph_scores([model.layer(i) for i in range(1, model.n_layers + 1)], by, _forward_rows)
    pair = z.select(by, "id", "z").repartition(n, by).groupBy(by).cogroup(arcs.repartition(n, by).groupBy(by))
    return pair.applyInArrow(run, f"`{by}` {kinds[by]}, id {kinds['id']}, features array<double>")


def _joined_scores(model: GcnModel, z: DataFrame, adj: DataFrame, by: Sequence[str]) -> DataFrame:
    """Last layer's output of subgraphs of any size. A layer's output is written, half as wide as the input above it, and then removed."""
    loop = Loop("predict")
    for i in range(1, model.n_layers + 1):
        layer = model.layer(i)
        out = loop.step(_apply_layer(z, layer, by, None))
        if i < model.n_layers:
            z = aggregate_neighbours(adj, out, by, layer["w"].shape[1])
    return out
