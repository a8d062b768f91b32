"""Shards of bounded size by extendible hashing, in DataFrame functions only.

A row's address is the bits of a hash of its key, 60 of them, followed by 60 bits of a hash of the whole row. The directory
starts as one bucket. A bucket of more bytes than the limit is split on its next bit, others stay, until all fit;
so a row's shard is the shortest prefix of its address whose rows fit the limit. Rows of one key stay together as long
as they fit. Rows that agree in all 120 bits are equal; where they alone exceed the limit they go to numbered
overflow pages of the shard, and a single row above the limit has a page of its own.

Addresses and sizes are written as a narrow table first. Every round counts the bytes of the cells six bits below the open
buckets, decides from these sums for all six depths, and goes on with the rows of those cells only that are still too
large. Only the number of rows left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tables import cut, forget

LIMIT = 64 << 20
HALF = 60  # bits of each of the two hashes
STEP = 6


def _bits(value: Column) -> Column:
    """The first 60 bits of the MD5 digest of a text, as text of zeros and ones."""
    number = F.conv(F.substring(F.md5(value), 1, HALF // 4), 16, 2)
    return F.lpad(number, HALF, "0")


def addresses(rows: DataFrame, key: str, size: Column) -> DataFrame:
    """(key, bytes, address, origin): of each row of ``rows``; origin numbers the task that read it."""
    every = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)]))
    keyed = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return rows.select(
        F.col(key).alias("key"),
        F.coalesce(size, F.lit(0)).cast("long").alias("bytes"),
        F.concat(_bits(keyed), _bits(every)).alias("address"),
        F.spark_partition_id().alias("origin"),
    )


def shards(rows: DataFrame, key: str, size: Column, limit: int = LIMIT) -> DataFrame:
    """(key, bytes, shard, page, depth, shard_bytes) of each row of ``rows``.

    ``shard`` is the prefix of the address in zeros and ones, of ``depth`` bits; ``page`` is 0 but for overflow pages, and
    ``shard_bytes`` is the size of the shard's page. Null sizes count as 0, null keys as empty ones.
    """
    if limit < 1:
        raise ValueError("the limit must be at least one byte")
    narrow = cut(addresses(rows, key, size), "addresses")
    done, old, left, depth = [], [], narrow, 0
    while True:
        step = min(STEP, 2 * HALF - depth)
        cells = left.groupBy(F.substring("address", 1, depth + step).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        # each cell counts for its prefixes of all depths of this round
        depths = F.sequence(F.lit(depth), F.lit(depth + step))
        prefixes = cells.withColumn("depth", F.explode(depths)).withColumn("shard", F.expr("substring(cell, 1, depth)"))
        sums = cut(prefixes.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes")), "buckets")
        old.append(sums)
        fitting = sums.where(F.col("shard_bytes") <= limit)
        over = F.col("shard_bytes") > limit
        # a bucket is a leaf if it fits and the one above, if looked at in this round, does not
        above = sums.where(over).select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        inner = fitting.where(F.col("depth") > depth).withColumn("parent", F.expr("substring(shard, 1, depth - 1)"))
        leaves = inner.join(above, ["depth", "parent"], "left_semi").select("shard", "depth", "shard_bytes")
        top = fitting.where(F.col("depth") == depth).select("shard", "depth", "shard_bytes")
        done.append(cut(leaves.union(top), "leaves"))
        open_cells = sums.where(over & (F.col("depth") == depth + step)).select("shard")
        depth += step
        if open_cells.isEmpty():
            pages = None
            break
        if depth == 2 * HALF:
            pages = cut(_pages(left.join(open_cells, F.col("address") == F.col("shard"), "left_semi"), limit), "pages")
            break
        cell = F.substring("address", 1, depth)
        left = cut(left.join(open_cells, cell == F.col("shard"), "left_semi"), "open")
        old.append(left)
    directory = done[0]
    for part in done[1:]:
        directory = directory.union(part)
    directory = cut(directory, "directory")
    forget(*done, *(df for df in old if df is not narrow))
    # the directory knows few depths; a row is looked up at each of them and found at one
    used = sorted(r[0] for r in directory.select("depth").distinct().collect())
    if not used:
        used = [0]
    looked = narrow.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in used]))).withColumn("shard", F.expr("substring(address, 1, depth)"))
    found = looked.join(directory, ["shard", "depth"]).select("key", "bytes", "shard", F.lit(0).cast("long").alias("page"), "depth", "shard_bytes")
    return found if pages is None else found.union(pages)


def _pages(equal: DataFrame, limit: int) -> DataFrame:
    """Pages of equal rows, numbered inside (address, origin) and by the totals of the origins before."""
    ranked = equal.withColumn("rank", F.row_number().over(Window.partitionBy("address", "origin").orderBy("bytes")))
    totals = cut(equal.groupBy("address", "origin").agg(F.count(F.lit(1)).alias("n")), "totals")
    before = F.sum("n").over(Window.partitionBy("address").orderBy("origin").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("address", "origin", F.coalesce(before, F.lit(0)).alias("before"))
    fit = F.greatest(F.floor(F.lit(limit) / F.col("bytes")), F.lit(1))  # rows of a page
    placed = ranked.join(offsets, ["address", "origin"]).withColumn("page", F.floor((F.col("rank") + F.col("before") - 1) / fit))
    sizes = cut(placed.groupBy("address", "page").agg(F.sum("bytes").alias("shard_bytes")), "pages")
    out = placed.join(sizes, ["address", "page"])
    return out.select("key", "bytes", F.col("address").alias("shard"), F.col("page").cast("long").alias("page"), F.lit(2 * HALF).alias("depth"), "shard_bytes")


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, bytes, shard, page, depth, shard_bytes) of each row of ``docs(doc_id, text)``, by the bytes of its text."""
    picked = docs.select("doc_id", F.col("text").alias("text"))
    return shards(picked, "doc_id", F.octet_length("text"), limit).withColumnRenamed("key", "doc_id")
