"""Node features and adjacency: standardising, normalising, propagating, reading out, packing.

Dense features are ``features ARRAY<DOUBLE>``; an adjacency is long form ``(row, col, val)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.operators.edges import add_self_loops, distinct_nodes, sum_duplicate_edges
from graphloom.operators.ordering import hash_key, rank_rows
from graphloom.scratch import Loop, cut, per_key


def _gather(long: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows (keys, idx, value) back to one array per key; its length is the number of features."""
    cells = F.sort_array(F.collect_list(F.struct("idx", value)))
    return long.groupBy(*keys).agg(F.transform(cells, lambda c: c[value]).alias(name))


def _explode(df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    return df.select(*keep, F.posexplode(features).alias("idx", "x"))


# ---- standardising


def standardize(nodes: DataFrame, by: Sequence[str] = ("subgraph_id",)) -> DataFrame:
    """Column z-scores inside each group with the population deviation; a constant column becomes 0.

    Means and deviations are summed per feature with partial sums; the rows themselves are not
    exploded, only joined with one array of statistics per group.
    """
    by = list(by)
    x = F.col("x")
    stats = (
        _explode(nodes, by)
        .groupBy(*by, "idx")
        .agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), (F.min(x) == F.max(x)).alias("flat"))
        .withColumn("scale", F.struct("mean", F.when(F.col("flat") | (F.col("sd") == 0), None).otherwise(F.col("sd")).alias("sd")))
    )
    per_group = per_key(_gather(stats, by, "scale", "_stats"), "stats")
    scaled = F.zip_with(
        "features", "_stats", lambda v, s: F.when(s.sd.isNull(), 0.0).otherwise((v - s.mean) / s.sd)
    )
    return nodes.join(per_group, by).withColumn("features", scaled).select(*nodes.columns)


def standardize_on_train(nodes: DataFrame, mask: str = "is_train") -> DataFrame:
    """Z-scores with the statistics of the masked rows; columns constant on those rows are dropped."""
    train = _explode(nodes.filter(F.col(mask)), [])
    x = F.col("x")
    stats = (
        train.groupBy("idx")
        .agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        .filter("lo < hi AND sd > 0")
    )
    # one row for the whole table: read as a scalar subquery, so no join is needed
    kept = stats.agg(F.sort_array(F.collect_list(F.struct("idx", "mean", "sd"))).alias("s")).scalar()
    scaled = F.transform("_stats", lambda s: (F.get("features", s.idx) - s.mean) / s.sd)
    return nodes.withColumn("_stats", kept).withColumn("features", scaled).drop("_stats")


# ---- adjacency


def normalize_adjacency(
    edges: DataFrame,
    nodes: DataFrame,
    kind: str = "sym_selfloop",
    diag_lambda: float = 1.0,
    by: Sequence[str] = (),
    transpose: bool = True,
) -> DataFrame:
    """Normalised adjacency as ``(by, row, col, val)``; repeated edges are summed first.

    ``sym_selfloop``: D^-1/2 (A+I) D^-1/2 with 1e-20 added to the degrees. ``sym``: D^-1/2 A D^-1/2
    without loops, 0 for a degree of 0. ``row``: A over max(1, row sum). ``diag_enhance``:
    (D+I)^-1 (A+I) with the diagonal multiplied by 1 + lambda. The symmetric kinds give the
    transpose of a directed A unless ``transpose=False``.
    """
    by = list(by)
    if kind in ("sym_selfloop", "diag_enhance"):
        a = add_self_loops(edges, nodes, 1.0, by)
    elif kind in ("sym", "row"):
        a = sum_duplicate_edges(edges, by).withColumn("w", F.col("w").cast("double"))
    else:
        raise ValueError(f"unknown kind {kind}")
    deg = per_key(a.groupBy(*by, "src").agg(F.sum("w").alias("_d")), "degree")
    own = a.join(deg, [*by, "src"])
    if kind == "row":
        return own.select(*by, F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("w") / F.greatest(F.lit(1.0), "_d")).alias("val"))
    if kind == "diag_enhance":
        val = F.col("w") / (F.col("_d") + 1e-20)
        val = F.when(F.col("src") == F.col("dst"), val * (1 + diag_lambda)).otherwise(val)
        return own.select(*by, F.col("src").alias("row"), F.col("dst").alias("col"), val.alias("val"))
    other = deg.select(*by, F.col("src").alias("dst"), F.col("_d").alias("_d2"))
    both = own.join(other, [*by, "dst"], "left")
    tiny = 1e-20 if kind == "sym_selfloop" else 0.0
    d1, d2 = F.col("_d") + tiny, F.coalesce("_d2", F.lit(0.0)) + tiny
    val = F.when((d1 == 0) | (d2 == 0), 0.0).otherwise(F.col("w") / F.sqrt(d1) / F.sqrt(d2))
    row, col = ("dst", "src") if transpose else ("src", "dst")
    return both.select(*by, F.col(row).alias("row"), F.col(col).alias("col"), val.alias("val"))


def message_pass(adj: DataFrame, feats: DataFrame, by: Sequence[str] = (), dim: int | None = None) -> DataFrame:
    """A·X: for every row of the adjacency, the weighted sum of its neighbours' features.

    With ``dim`` given, the sums are ``dim`` plain columns of one aggregation; otherwise features
    are exploded by index. Both are summed before the shuffle, so a hub costs one row per task.
    """
    by = list(by)
    joined = adj.join(feats.select(*by, F.col("id").alias("col"), "features"), [*by, "col"])
    if dim is not None:
        sums = [F.sum(F.col("val") * F.get("features", F.lit(i))).alias(f"_s{i}") for i in range(dim)]
        wide = joined.groupBy(*by, "row").agg(*sums)
        return wide.select(*by, F.col("row").alias("id"), F.array(*[f"_s{i}" for i in range(dim)]).alias("features"))
    long = (
        _explode(joined, [*by, F.col("row").alias("id"), "val"])
        .groupBy(*by, "id", "idx")
        .agg(F.sum(F.col("val") * F.col("x")).alias("y"))
    )
    return _gather(long, [*by, "id"], "y", "features")


def khop_pairs(edges: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (src, dst) where dst can be reached in at most ``k`` steps, each node itself included."""
    by = list(by)
    nodes = distinct_nodes(edges, by)
    loops = nodes.select(*by, F.col("id").alias("src"), F.col("id").alias("dst"))
    loop = Loop("hops")
    arcs = edges.filter("w <> 0").select(*by, "src", "dst").distinct()
    reached = loop.step(arcs.union(loops).distinct()) if k > 0 else loops
    for _ in range(k - 1):
        step = reached.select(*by, "src", F.col("dst").alias("_mid")).join(
            arcs.select(*by, F.col("src").alias("_mid"), "dst"), [*by, "_mid"]
        )
        reached = loop.step(reached.union(step.select(*by, "src", "dst")).distinct())
    return reached


def _frontier(starts: DataFrame, arcs: DataFrame, steps: int, by: list[str]) -> DataFrame:
    """``(by, start, mid)``: the nodes that each start reaches in at most so many steps, itself included."""
    reached = starts.select(*by, "start", F.col("start").alias("mid"))
    loop = Loop("frontier")
    onward = arcs.select(*by, F.col("src").alias("mid"), F.col("dst").alias("_next"))
    for _ in range(steps):
        step = reached.join(onward, [*by, "mid"]).select(*by, "start", F.col("_next").alias("mid"))
        reached = loop.step(reached.union(step).distinct())
    return reached


def reachable_pairs(pairs: DataFrame, edges: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Those of the distinct ``pairs(by, src, dst)`` whose dst can be reached in at most ``k`` steps.

    Only the pairs asked for are followed, half of the steps from their first ends and half back from their second ends, until
    the two sets meet. A hub is then a middle of its neighbours, not a pair with each of them for every other.
    """
    by = list(by)
    arcs = cut(edges.filter("w <> 0").select(*by, "src", "dst").distinct(), "hop-arcs")
    nodes = distinct_nodes(edges, by)
    asked = pairs.select(*by, "src", "dst").distinct()
    back = arcs.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = []
    for end, way, steps in (("src", arcs, k - k // 2), ("dst", back, k // 2)):
        starts = asked.select(*by, F.col(end).alias("id")).distinct().join(nodes, [*by, "id"], "left_semi")
        ends.append(_frontier(starts.withColumnRenamed("id", "start"), way, steps, by))
    there = asked.join(ends[0].withColumnRenamed("start", "src"), [*by, "src"])
    return there.join(ends[1].withColumnRenamed("start", "dst"), [*by, "dst", "mid"], "left_semi").select(*by, "src", "dst").distinct()


def attention_bias(pairs: DataFrame, edges: DataFrame, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """0 for a pair within ``k`` steps of ``edges``, -1e9 otherwise, for the pairs asked for."""
    found = reachable_pairs(pairs, edges, k, by).withColumn("_found", F.lit(True))
    bias = F.when(F.col("_found"), 0.0).otherwise(-1e9)
    return pairs.join(found, [*by, "src", "dst"], "left").withColumn("bias", bias).drop("_found")


# ---- group summaries


def readout_mean(nodes: DataFrame, by: Sequence[str] = ("subgraph_id",), mask: str | None = None) -> DataFrame:
    """Mean feature vector per group; with ``mask``, the mask-weighted mean."""
    by = list(by)
    if mask is None:
        long = _explode(nodes, by).groupBy(*by, "idx").agg(F.avg("x").alias("m"))
    else:
        m = F.col(mask).cast("double")
        long = (
            _explode(nodes, [*by, mask])
            .groupBy(*by, "idx")
            .agg(F.try_divide(F.sum(F.col("x") * m), F.sum(m)).alias("m"))
        )
    return _gather(long, by, "m", "features")


def bilinear_score(
    nodes: DataFrame, summary: DataFrame, weight: Sequence[Sequence[float]], bias: float = 0.0, by: Sequence[str] = ("subgraph_id",)
) -> DataFrame:
    """``h' W c + b`` of each node against its group's summary vector ``c``."""
    by = list(by)
    matrix = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weight])
    projected = summary.select(*by, F.transform(matrix, lambda row: scalars.dot(row, F.col("features"))).alias("_wc"))
    return nodes.join(per_key(projected, "summary"), by).select(*by, "id", (scalars.dot("features", "_wc") + bias).alias("score"))


def shuffle_features(
    nodes: DataFrame, seed: int = 0, by: Sequence[str] = ("subgraph_id",), order: Column | None = None
) -> DataFrame:
    """Permute the feature rows inside each group: rank by id meets rank by seeded hash."""
    by = list(by)
    places = rank_rows(nodes.select(*by, "id"), key="id", by=by, name="_pos").drop("total")
    if order is None:
        keyed = nodes.select(*by, "id", "features", hash_key("id", seed=seed).alias("_h"))
        donors = rank_rows(keyed, key="_h", by=by, ties=["id"], hashed=True, name="_pos")
    else:
        keyed = nodes.select(*by, "id", "features", order.alias("_h"))
        donors = rank_rows(keyed, key="_h", by=by, ties=["id"], name="_pos")
    return places.join(donors.select(*by, "_pos", "features"), [*by, "_pos"]).drop("_pos")


# ---- packing


def pack_graphs(
    nodes: DataFrame, edges: DataFrame, n_max: int, dim: int, by: Sequence[str] = ("subgraph_id",)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Many small graphs at one padded size.

    Gives slots ``(by, pos, features, mask)`` with ``n_max`` rows per graph (padding has zeros and
    mask 0), cells ``(by, row, col, val)`` on positions, each present edge 1, and ``(by, size)``.
    A graph of more than ``n_max`` nodes is an error.
    """
    by = list(by)
    ranked = rank_rows(nodes.select(*by, "id", "features"), key="id", by=by, name="pos")
    checked = F.when(F.col("total") > n_max, F.raise_error(F.lit(f"a graph has more than {n_max} nodes"))).otherwise(F.col("total"))
    placed = ranked.withColumn("size", checked.cast("int")).withColumn("pos", F.col("pos").cast("int"))
    sizes = placed.groupBy(*by).agg(F.max("size").alias("size"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    padding = sizes.filter(F.col("size") < n_max).select(
        *by, F.explode(F.sequence("size", F.lit(n_max - 1))).alias("pos"), zeros.alias("features"), F.lit(0.0).alias("mask")
    )
    slots = placed.select(*by, "pos", "features", F.lit(1.0).alias("mask")).unionByName(padding)
    at = {e: placed.select(*by, F.col("id").alias(e), F.col("pos").alias(n)) for e, n in (("src", "row"), ("dst", "col"))}
    cells = edges.join(at["src"], [*by, "src"]).join(at["dst"], [*by, "dst"])
    cells = cells.groupBy(*by, "row", "col").agg(F.count(F.lit(1)).cast("double").alias("val"))
    return slots, cells, sizes


# ---- splits


def assign_split(nodes: DataFrame, ids: DataFrame | None, mode: str) -> DataFrame:
    """Add ``split``. ``train``: listed nodes train, the others are dropped. ``eval``: listed nodes
    eval, the others train, all kept. ``test``: all test. ``is_masked`` marks the mode's nodes."""
    if mode == "test" or ids is None:
        return nodes.withColumns({"split": F.lit("test"), "is_masked": F.lit(True)})
    known = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    if mode == "train":
        kept = nodes.join(known, "id", "left_semi").select(*nodes.columns)
        return kept.withColumns({"split": F.lit("train"), "is_masked": F.lit(True)})
    flagged = nodes.join(known.withColumn("_in", F.lit(True)), "id", "left").select(*nodes.columns, "_in")
    split = F.when(F.col("_in"), "eval").otherwise("train")
    return flagged.withColumns({"split": split, "is_masked": split == mode}).drop("_in")


def range_split(nodes: DataFrame, n_train: int, n_val: int, n_test: int, position: str = "pos", label: str = "label") -> DataFrame:
    """Train rows first, then validation rows; the last ``n_test`` rows test; labels are null outside their split.

    Splits are flags, because the test rows may overlap nothing, or rows may be in no split.
    """
    pos = F.col(position)
    total = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    flags = {
        "is_train": pos < n_train,
        "is_val": (pos >= n_train) & (pos < n_train + n_val),
        "is_test": pos >= total - n_test,
    }
    out = nodes.withColumns(flags)
    return out.withColumns({f"y_{s}": F.when(F.col(f"is_{s}"), F.col(label)) for s in ("train", "val", "test")})


def stack_sources(labelled: DataFrame, unlabelled: DataFrame, position: str = "pos") -> DataFrame:
    """Labelled rows first, then the others, with a global 0-based position in id order."""
    both = labelled.withColumn("_block", F.lit(0)).unionByName(unlabelled.withColumn("_block", F.lit(1)), allowMissingColumns=True)
    ranked = rank_rows(both, key="id", by=["_block"], name="_inner")
    first = labelled.agg(F.count(F.lit(1)).alias("n")).scalar()
    shifted = F.when(F.col("_block") == 0, F.col("_inner")).otherwise(F.col("_inner") + first)
    return ranked.withColumn(position, shifted).drop("_block", "_inner", "total")


def mask_column(df: DataFrame, predicate: Column, name: str = "is_masked") -> DataFrame:
    return df.withColumn(name, F.coalesce(predicate, F.lit(False)))


def unique_nodes(nodes: DataFrame, by: Sequence[str] = ("subgraph_id",), order: str | None = None) -> DataFrame:
    """One row per (group, id): the last by ``order``; without an order, repeated ids are an error."""
    keys = [*by, "id"]
    others = [c for c in nodes.columns if c not in keys]
    if order is not None:
        picked = nodes.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r"))
        return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in nodes.columns])
    counted = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others)).alias("_r"))
    failed = F.raise_error(F.concat(F.lit("repeated node id "), F.col("id").cast("string")))
    counted = counted.filter(F.when(F.col("_n") > 1, failed).otherwise(F.lit(True)))
    return counted.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in nodes.columns])
