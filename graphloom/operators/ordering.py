"""Exact ranks, running totals and order statistics that do not need a whole group in one task.

A plain window sorts each group inside one task, which fails when one group holds a third of the
rows. Here a group is first split by value into slots, the slots are totalled (a small table), and
only the rows of one slot of one group are sorted together. The running total of a row is the total
of the earlier slots plus its running total inside its slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.scratch import cut, settled

HOT_ROWS = 200_000  # rows of a group that one task sorts


def slot_count(df: DataFrame) -> int:
    """Slots per sorted column: one per shuffle partition, so that slots grow with the cluster."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_key(*cols: str, seed: int = 0) -> Column:
    """A pseudo-random order that is the same in every run: a 64-bit hash of the columns."""
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def with_value_slot(df: DataFrame, key: str, slot: str = "_slot") -> DataFrame:
    """Add the slot of ``key``: the number of approximate quantiles of the column below it.

    The quantiles are taken from all rows, so a slot of a group never holds much more than
    ``rows / slots`` distinct keys, whatever the group. Equal keys share a slot.
    """
    n = slot_count(df)
    numeric = df.select(F.col(key).cast("double").alias("_slot_key"))
    cuts = numeric.approxQuantile("_slot_key", [i / n for i in range(1, n)], 1 / (4 * n))
    inner = sorted({c for c in cuts if abs(c) != float("inf")})
    if not inner:  # no rows, or no finite key
        return df.withColumn(slot, F.lit(0))
    splits = [float("-inf"), *inner, float("inf")]
    wide = df.withColumn("_slot_key", F.col(key).cast("double"))
    bucketizer = Bucketizer(splits=splits, inputCol="_slot_key", outputCol=slot, handleInvalid="keep")
    return bucketizer.transform(wide).drop("_slot_key").withColumn(slot, F.col(slot).cast("int"))


def with_hash_slot(df: DataFrame, key: str, slots: Column | None = None, slot: str = "_slot") -> DataFrame:
    """As ``with_value_slot`` for a key spread evenly over all 64-bit integers; needs no extra pass.

    ``slots`` may give each group its own number of slots, such as one for groups known to be small.
    """
    n = F.lit(slot_count(df)) if slots is None else slots
    # shifting right keeps the order; 2**20 even ranges of the hash are folded into n slots
    return df.withColumn(slot, F.floor((F.shiftright(F.col(key), 44) + (1 << 19)) * n / (1 << 20)).cast("int"))


def prefix_sum(
    df: DataFrame,
    value: str | Column,
    key: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    hashed: bool = False,
    slots: Column | None = None,
) -> DataFrame:
    """Add ``before`` (total of ``value`` over earlier rows of the group) and ``total``.

    Rows are ordered by ``key``, then ``ties``. Keys should be (nearly) distinct inside a group:
    count equal keys first. ``hashed`` says that ``key`` is a ``hash_key``; ``slots`` is then the
    number of slots of the row's group.

    Groups are counted first. Only those of more than ``HOT_ROWS`` rows are split into slots, the
    others are sorted as they are, by one shuffle.
    """
    by = list(by)
    if hashed:
        return _slotted_sum(with_hash_slot(df, key, slots), value, key, by, ties)
    df = settled(df, "ordered")  # read several times below
    if not by:
        return _slotted_sum(with_value_slot(df, key), value, key, by, ties)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    hot = cut(sizes.filter(F.col("_rows") > HOT_ROWS).drop("_rows"), "hot-groups")
    if hot.isEmpty():
        return _plain_sum(df, value, key, by, ties)
    same = _same_group(df, hot, by)
    some = _slotted_sum(with_value_slot(df.join(hot, same, "left_semi"), key), value, key, by, ties)
    rest = _plain_sum(df.join(hot, same, "left_anti"), value, key, by, ties)
    return rest.unionByName(some)


def _same_group(df: DataFrame, other: DataFrame, by: Sequence[str]) -> Column:
    on = df[by[0]].eqNullSafe(other[by[0]])
    for c in by[1:]:
        on = on & df[c].eqNullSafe(other[c])
    return on


def _plain_sum(df: DataFrame, value: str | Column, key: str, by: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """``prefix_sum`` of groups that fit a task."""
    group = Window.partitionBy(*by)
    summed = df.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    earlier = group.orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_value").over(earlier), F.expr("0"))
    return summed.withColumn("total", F.sum("_value").over(group)).withColumn("before", before).drop("_value")


def _slotted_sum(slotted: DataFrame, value: str | Column, key: str, by: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """``prefix_sum`` by the totals of the slots before, and a window inside the slot."""
    groups = by or [F.lit(0)]
    slotted = slotted.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    by_slot = Window.partitionBy(*groups).orderBy("_slot")
    offsets = (
        slotted.groupBy(*by, "_slot")
        .agg(F.sum("_value").alias("_sum"))
        .select(
            *by,
            "_slot",
            F.coalesce(
                F.sum("_sum").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)), F.expr("0")
            ).alias("_offset"),
            F.sum("_sum").over(Window.partitionBy(*groups)).alias("total"),
        )
    )
    inside = Window.partitionBy(*by, "_slot").orderBy(key, *ties)
    return (
        slotted.repartition(*by, "_slot")
        .withColumn(
            "_inside",
            F.coalesce(F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.expr("0")),
        )
        .join(offsets, [*by, "_slot"])
        .withColumn("before", F.col("_offset") + F.col("_inside"))
        .drop("_slot", "_value", "_offset", "_inside")
    )


def rank_rows(
    df: DataFrame,
    key: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    hashed: bool = False,
    name: str = "rank",
) -> DataFrame:
    """Add the 0-based position of each row inside its group and the group's size ``total``.

    Text keys have no numeric order to cut into slots: their rows are in the order of a hash of the
    key, equal keys next to each other.
    """
    one = F.lit(1).cast("long")
    if df.schema[key].dataType.typeName() in ("string", "varchar", "char"):
        keyed = df.withColumn("_text_order", hash_key(key))
        ranked = prefix_sum(keyed, one, "_text_order", by=by, ties=[key, *ties], hashed=True).drop("_text_order")
    else:
        ranked = prefix_sum(df, one, key, by=by, ties=ties, hashed=hashed)
    return ranked.withColumnRenamed("before", name)


def order_statistics(
    df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Per group, the value at 0-based ascending position ``floor(q * n)`` for each named ``q``.

    No interpolation, and ``q * n`` is taken in double precision. Equal values are counted before
    the first shuffle, so a group of many equal values costs one row.
    """
    # the counts are read three times below, so they are written once
    counted = cut(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    placed = prefix_sum(counted, "_n", value, by=by)
    picks = []
    for name, q in quantiles.items():
        target = F.least(F.floor(F.lit(float(q)) * F.col("total")), F.col("total") - 1)
        here = (F.col("before") <= target) & (target < F.col("before") + F.col("_n"))
        picks.append(F.max(F.when(here, F.col(value))).alias(name))
    return placed.groupBy(*by).agg(*picks, F.max("total").alias("n"))
