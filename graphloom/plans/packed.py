"""Subgraphs packed into one row each, for training that takes a step a subgraph.

A step over one subgraph reads that subgraph's row, and nothing else: the table of packed rows is laid out in folders
by the subgraph's number. The row's gradient is worked out in the task that reads it, and only sums of gradients leave
tasks. It holds the output of one layer and the gradient of another whole, inputs in blocks of rows; the other layers' outputs wait in
files of the task, and inputs are worked out again on the way back. Predictions go up the layers only, in one task a subgraph. A subgraph of more than ``most`` nodes and edges is not packed,
because a row has to fit a task; it stays in tables of nodes and edges with the same layout, which the join plan of ``gcn`` steps over.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.network import logistic, repeatable_keep, softmax_rows
from graphloom.operators.ordering import rank_rows
from graphloom.scratch import cut, new_path

MOST = 2_000_000  # nodes and edges of a packed subgraph
FOLDERS = 4096
EDGES = 1 << 14  # that are summed at once
ROWS = 1 << 13  # nodes whose inputs are held at once
ASIDE = 1 << 20  # numbers of a layer's output above which layers lie in files while others are worked out
SCORED = 1 << 26  # numbers of a layer's output in a subgraph that one task predicts
PAIRED = 1 << 25  # numbers of a layer's output up to which two layers are held at once


@dataclass
class Packed:
    """``rows`` has a row for every packed subgraph; ``nodes`` and ``edges`` are those of the others. All have its number and masked nodes ``n``."""

    rows: DataFrame
    nodes: DataFrame
    edges: DataFrame
    groups: int
    large: frozenset[int]  # numbers of the others

    def some(self, table: str, numbers: Sequence[int]) -> DataFrame:
        """The rows of these subgraphs; other folders are not read."""
        folders = sorted({i % FOLDERS for i in numbers})
        return getattr(self, table).where(F.col("folder").isin(folders) & F.col("number").isin(list(map(int, numbers))))


def _laid_out(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.withColumn("folder", (F.col("number") % FOLDERS).cast("int")).write.partitionBy("folder").parquet(path)
    fields = [f for f in df.schema.fields] + [df.sparkSession.range(0).select(F.lit(0).alias("folder")).schema.fields[0]]
    return df.sparkSession.read.schema(type(df.schema)(fields)).parquet(path)


ROW = "number long, n long, z binary, target binary, masked binary, hash binary, row binary, col binary, val binary"


def _pack_one(key: tuple, nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """Arrays of a subgraph as bytes; nodes by id, edges by their end."""
    ids = nodes["id"].combine_chunks()
    order = pc.array_sort_indices(ids)
    nodes, sorted_ids = nodes.take(order), ids.take(order)
    flat = lambda c: np.ascontiguousarray(c.combine_chunks().flatten().to_numpy(zero_copy_only=False), float)
    row, col = (pc.index_in(edges[c].combine_chunks(), sorted_ids) for c in ("row", "col"))
    there = pc.and_(pc.is_valid(row), pc.is_valid(col)).to_numpy(zero_copy_only=False).astype(bool)
    row, col = (np.asarray(x.fill_null(0).to_numpy(zero_copy_only=False), np.int32)[there] for x in (row, col))
    val = np.asarray(edges["val"].combine_chunks().to_numpy(zero_copy_only=False), float)[there]
    by_row = np.argsort(row, kind="stable")
    arrays = [flat(nodes["z"]), flat(nodes["target"])]
    arrays += [np.asarray(nodes[c].combine_chunks().to_numpy(zero_copy_only=False), kind) for c, kind in (("is_masked", np.uint8), ("hash", np.int64))]
    arrays += [row[by_row], col[by_row], val[by_row]]
    return pa.table([[nodes["number"][0].as_py()], [nodes["n"][0].as_py()], *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=[f.split()[0] for f in ROW.split(", ")])


def pack_subgraphs(z1: DataFrame, nodes: DataFrame, adj: DataFrame, by: str, most: int = MOST) -> Packed:
    """Subgraphs with masked nodes, numbered in order of their ids.

    ``z1(by, id, z)`` is the input of the first layer, ``nodes`` has ``target`` and ``is_masked``, ``adj`` is ``(by, row, col, val)``.
    """
    used = nodes.groupBy(by).agg(F.sum(F.col("is_masked").cast("long")).alias("n"), F.count(F.lit(1)).alias("size")).where("n > 0")
    edges = adj.groupBy(by).agg(F.count(F.lit(1)).alias("edges"))
    ranked = rank_rows(used.join(edges, by, "left"), key=by, ties=[], name="number")
    groups = cut(ranked.select(by, F.col("number").cast("long").alias("number"), "n", (F.col("size") + F.coalesce("edges", F.lit(0)) > most).alias("large")), "groups")
    rows = z1.join(nodes.select(by, "id", "target", F.coalesce("is_masked", F.lit(False)).alias("is_masked")), [by, "id"]).join(groups, by)
    rows = rows.withColumn("hash", F.xxhash64(by, "id"))
    # names of their own, for both sides come from one table
    arcs = adj.join(groups.select(by, F.col("number").alias("graph"), F.col("large").alias("is_large")), by)
    arcs = arcs.select(F.col(by).alias("of"), F.col("row").alias("row"), F.col("col").alias("col"), F.col("val").cast("double").alias("val"), "graph", "is_large")
    pair = rows.where("not large").groupBy("number").cogroup(arcs.where("not is_large").groupBy("graph"))
    large = frozenset(r[0] for r in groups.where("large").select("number").collect())  # each of more than ``most`` rows
    return Packed(
        _laid_out(pair.applyInArrow(_pack_one, ROW), "packed"),
        _laid_out(rows.where("large").select(by, "id", "z", "target", "is_masked", "number", "n"), "packed-nodes"),
        _laid_out(arcs.where("is_large").select(F.col("of").alias(by), "row", "col", "val", F.col("graph").alias("number")), "packed-edges"),
        groups.count(),
        large,
    )


def spread(row: np.ndarray, col: np.ndarray, val: np.ndarray, x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Adds sums of ``val * x[col]`` by row to ``out``; edges come in order of ``row``."""
    for lo in range(0, len(row), EDGES):
        r = row[lo : lo + EDGES]
        begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[begin]] += np.add.reduceat(val[lo : lo + EDGES, None] * x[col[lo : lo + EDGES]], begin)
    return out


class Aside:
    """Arrays of one subgraph, each written in blocks of rows and read back whole or in blocks; in files of the task if they are large."""

    def __init__(self, folder: str | None):
        self.folder, self.held = folder, {}

    def write(self, name: str, blocks: Iterator[np.ndarray]) -> None:
        if self.folder is None:
            self.held[name] = np.concatenate(list(blocks))
            return
        with open(f"{self.folder}/{name}", "wb") as out:
            for block in blocks:
                self.held[name] = block.shape[1]  # of an array in a file, its width
                np.ascontiguousarray(block, float).tofile(out)

    def read(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        kept = self.held[name]
        if self.folder is None:
            return kept[lo:hi]
        count = -1 if hi is None else (hi - lo) * kept
        return np.fromfile(f"{self.folder}/{name}", float, count, offset=8 * lo * kept).reshape(-1, kept)

    def drop(self, name: str) -> None:
        if self.held.pop(name, None) is not None and self.folder is not None:
            os.remove(f"{self.folder}/{name}")


def top(kind: str, out: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Loss, share of right rows and the gradient of logits; ``share`` is the weight of each row, as a column."""
    if kind == "sigmoid":
        cell = np.maximum(out, 0) - out * y + np.log1p(np.exp(-np.abs(out)))
        right = ((out > 0) == (y > 0.5)).mean(axis=1, keepdims=True)
        return float((share * cell.mean(axis=1, keepdims=True)).sum()), float((share * right).sum()), share * (logistic(out) - y) / out.shape[1]
    high = out.max(axis=1, keepdims=True)
    lse = high + np.log(np.exp(out - high).sum(axis=1, keepdims=True))
    right = (out.argmax(axis=1) == y.argmax(axis=1))[:, None]
    return float((share * y * (lse - out)).sum()), float((share * right).sum()), share * (softmax_rows(out) * y.sum(axis=1, keepdims=True) - y)


def packed_gradients(layers: list[dict], kind: str, classes: int, groups: int, dropout: float, seed: int, forward_rows, backward_rows):
    """Rows of packed subgraphs to one array: loss, share of right rows, and the gradients of all layers' parameters by name."""

    def one(r: dict) -> np.ndarray:
        hashes = np.frombuffer(r["hash"], np.int64)
        n = len(hashes)
        row, col = (np.frombuffer(r[c], np.int32) for c in ("row", "col"))
        val = np.frombuffer(r["val"])
        y = np.frombuffer(r["target"]).reshape(n, classes)
        share = np.frombuffer(r["masked"], np.uint8)[:, None] / (r["n"] * groups)
        first = np.frombuffer(r["z"]).reshape(n, -1)
        blocks = [(lo, min(lo + ROWS, n)) for lo in range(0, n, ROWS)]
        starts = np.searchsorted(row, [lo for lo, _ in blocks] + [n])

        def inputs(i: int, b: int, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
            """Rows of the input of a layer, from the whole output of the layer below, and what dropout keeps of them."""
            lo, hi = blocks[b]
            e = slice(starts[b], starts[b + 1])
            z = first[lo:hi] if i == 1 else np.hstack([spread(row[e] - lo, col[e], val[e], below, np.zeros((hi - lo, below.shape[1]))), below[lo:hi]])
            keep = repeatable_keep(hashes[lo:hi], z.shape[1], dropout, seed * 100 + i) if dropout else None
            return (z if keep is None else z * keep), keep

        def outputs(i: int, below: np.ndarray | None) -> Iterator[np.ndarray]:
            for b in range(len(blocks)):
                yield forward_rows(layers[i - 1], inputs(i, b, below)[0])[0]

        widest = max(layer["w"].shape[1] for layer in layers)
        with tempfile.TemporaryDirectory() if n * widest > ASIDE else contextlib.nullcontext() as folder:
            aside = Aside(folder)
            for i in range(1, len(layers)):
                aside.write(f"out{i}", outputs(i, aside.read(f"out{i - 1}") if i > 1 else None))
            loss = right = 0.0
            found = []
            for i in range(len(layers), 0, -1):
                layer, last = layers[i - 1], i == len(layers)
                below = aside.read(f"out{i - 1}") if i > 1 else None
                aside.drop(f"out{i - 1}")
                heard = np.zeros_like(below) if i > 1 else None
                total = 0.0
                for b, (lo, hi) in enumerate(blocks):
                    z, keep = inputs(i, b, below)
                    out, memo = forward_rows(layer, z)
                    if last:
                        cost, hit, up = top(kind, out, y[lo:hi], share[lo:hi])
                        loss, right = loss + cost, right + hit
                    else:
                        up = aside.read("up", lo, hi)
                    down, grads = backward_rows(layer, z, memo, up)
                    total = total + np.concatenate([grads[k].ravel() for k in sorted(grads)])
                    if heard is not None:
                        down = down if keep is None else down * keep
                        half = down.shape[1] // 2
                        heard[lo:hi] += down[:, half:]
                        e = slice(starts[b], starts[b + 1])
                        back = np.argsort(col[e], kind="stable")
                        spread(col[e][back], row[e][back] - lo, val[e][back], down[:, :half], heard)
                found.append(total)
                if heard is not None:
                    aside.drop("up")
                    aside.write("up", (heard[lo:hi] for lo, hi in blocks))
                del below, heard
        return np.concatenate([[loss, right], *reversed(found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                part = one(batch.slice(i, 1).to_pylist()[0])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return run


def _ends(ids: pa.Array, edges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``ids`` of both ends of every edge, and its value, in order of ``row``. A repeated id has the edges at each of its places."""
    known = ids.dictionary_encode()
    code = known.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    row, col = (pc.index_in(edges[c].combine_chunks(), known.dictionary, skip_nulls=True) for c in ("row", "col"))
    there = pc.and_(pc.is_valid(row), pc.is_valid(col)).to_numpy(zero_copy_only=False).astype(bool)
    row, col = (x.fill_null(0).to_numpy(zero_copy_only=False)[there] for x in (row, col))
    val = np.asarray(edges["val"].combine_chunks().to_numpy(zero_copy_only=False), float)[there]
    at = np.flatnonzero(code >= 0)
    if len(at) == len(known.dictionary):
        place = np.empty(len(at), np.int64)
        place[code[at]] = at
        row, col = place[row], place[col]
    else:
        places = pd.DataFrame({"code": code[at], "at": at})
        met = pd.DataFrame({"row": row, "col": col, "val": val})
        for end in ("row", "col"):
            met = met.merge(places, left_on=end, right_on="code").drop(columns=[end, "code"]).rename(columns={"at": end})
        row, col, val = (met[c].to_numpy() for c in ("row", "col", "val"))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], val[order]


def subgraph_scores(layers: list[dict], by: str, forward_rows):
    """Logits of the nodes of one subgraph, from the input of the first layer; holds the outputs of two layers, or of one if they are large."""
    widest = max(layer["w"].shape[1] for layer in layers)

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        ids, n = nodes["id"].combine_chunks(), nodes.num_rows
        row, col, val = _ends(ids, edges)
        first = nodes["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, -1)
        blocks = [(lo, min(lo + ROWS, n)) for lo in range(0, n, ROWS)]
        starts = np.searchsorted(row, [lo for lo, _ in blocks] + [n])

        def outputs(layer: dict, below: np.ndarray | None) -> Iterator[np.ndarray]:
            for b, (lo, hi) in enumerate(blocks):
                e = slice(starts[b], starts[b + 1])
                z = first[lo:hi] if below is None else np.hstack([spread(row[e] - lo, col[e], val[e], below, np.zeros((hi - lo, below.shape[1]))), below[lo:hi]])
                yield forward_rows(layer, z)[0]

        with tempfile.TemporaryDirectory() if n * widest > PAIRED else contextlib.nullcontext() as folder:
            aside, below = Aside(folder), None
            for i, layer in enumerate(layers):
                if folder is None:
                    out, at = np.empty((n, layer["w"].shape[1])), 0
                    for block in outputs(layer, below):
                        out[at : at + len(block)] = block
                        at += len(block)
                    below = out
                else:
                    aside.write(f"out{i}", outputs(layer, below))
                    below = None
                    below = aside.read(f"out{i}")
                    aside.drop(f"out{i}")
        logits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * below.shape[1], pa.int32()), pa.array(below.ravel(), from_pandas=True))  # NaN as null, as pandas gives it
        return pa.table([nodes[by], ids, logits], names=[by, "id", "features"])

    return run
