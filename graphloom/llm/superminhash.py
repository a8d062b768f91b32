"""Near-duplicate documents by SuperMinHash signatures, banding, exact checks on full shingle sets and union-find.

A document's set holds its distinct runs of five words, lower-cased in A-Z; a shorter document has one run, the whole.

1. Documents of one set are one class under the smallest doc_id, so copies cost one row from here on.
2. Every element of a set draws a random order of the signature's places, one place a level; the value at a place is the
   smallest level and fraction drawn for it. Levels are taken for all elements at once and end as soon as no place can
   still fall, which for long texts is after one or two.
3. Classes that agree in all values of a band meet in a bucket. The member that shares its buckets with most others is the
   bucket's hub: the text that others were edited from, if it is there. Every member is compared with its hubs, first
   by signature and then by full sets, which takes one row a member and hub and joins nearly all of a family at once.
4. What is left are buckets with members of two components or more. Those members are compared in blocks of bounded
   size, by signature, but only across components, and a task passes on a forest over components. Inside the loose groups so
   found the full sets are compared, again in blocks and only across components. A family whose members resemble each other without
   being linked costs its square here, as any exact search does; a linked one does not.
   Links are those pairs with ``100 * intersection >= percent * union``. Pairs already in one component need no link of their own.
5. Components of the links, by union-find in tasks and contraction between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import UnionFind, components
from graphloom.llm.groups import runs_of_rows
from graphloom.llm.tables import cut, forget, fresh, in_arrow, partitions, small, utf8
from graphloom.llm.words import U64, WordHasher, checksum, mix, slices, windows, worker_state

WORDS = 5
PLACES, ROWS = 128, 4  # 32 bands: a pair of similarity 0.85 misses all of them with probability 5e-11
MARGIN = 0.16  # below the threshold, in similarity as signatures tell it: 4.5 standard deviations at least
MEMBERS = 512  # of a bucket or a loose group in a block
SPOKES = 256  # members that are compared with their hub in one go
SHINGLES = 200_000  # of such a go, or of a block of a loose group
BROADCAST_ROWS = 1_000_000
FRACTION = 25  # bits of a signature value below the level


def signatures(elements: np.ndarray, first: np.ndarray, places: int = PLACES, block: int = 50_000) -> np.ndarray:
    """SuperMinHash signatures of the sets ``elements[first[i]:first[i + 1]]``, of at most 128 places; empty sets have all ones."""
    n = len(first) - 1
    out = np.full((n, places), np.iinfo(np.uint32).max, np.uint32)
    owner_of_all = np.repeat(np.arange(n), np.diff(first))
    for lo in range(0, len(elements), block):
        x, owner, order = elements[lo : lo + block], owner_of_all[lo : lo + block], None
        for level in range(places):
            # a place can still fall below this level's values only in sets with a value above the level
            alive = out[owner[0] : owner[-1] + 1].max(1) >= level << FRACTION
            mask = alive[owner - owner[0]]
            if not mask.all():
                x, owner = x[mask], owner[mask]
                order = order[mask] if order is not None else None
            if not len(x):
                break
            draw = mix(x + U64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64)))
            pick = (level + (((draw & U64(0x7FFFFFFF)) * U64(places - level)) >> U64(31))).astype(np.int64)
            if level == 0:
                place = pick
            else:
                rows = np.arange(len(x))
                if order is None:
                    order = np.tile(np.arange(places, dtype=np.uint8), (len(x), 1))
                    order[rows, earlier[mask]] = 0
                place = order[rows, pick].astype(np.int64)
                order[rows, pick] = order[:, level]
            earlier = pick
            value = (U64(level << FRACTION) | (draw >> U64(64 - FRACTION))).astype(np.uint32)
            np.minimum.at(out.reshape(-1), owner * places + place, value)
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit number for each band of each signature."""
    n, places = signature.shape
    parts = signature.reshape(n, places // rows, rows).astype(U64)
    out = np.broadcast_to(mix(np.arange(places // rows, dtype=U64) + U64(1)), parts.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def _shingle_sets(hasher: WordHasher, texts: list[bytes | None]) -> list[np.ndarray]:
    found = hasher([t and t.lower() for t in texts])
    runs, _, begin = windows(found.hashes, found.first, WORDS, short=True)
    return [np.unique(runs[a:b]) for a, b in zip(begin[:-1], begin[1:])]


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, code) of every document; digest null for an empty set. One byte of each value is in code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near-duplicates")
        hasher = WordHasher()
        for batch in batches:
            ids = batch["doc_id"]
            for lo, hi, texts in slices(batch["text"]):
                sets = _shingle_sets(hasher, texts)
                first = np.cumsum([0, *map(len, sets)])
                values = signatures(np.concatenate(sets), first)
                code = (values * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                keys = bands(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([checksum(s) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1))),
                        pa.array([c.tobytes() for c in code], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands", "code"],
                )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    return in_arrow(picked, run, "doc_id long, n_shingles long, digest binary, bands array<long>, code binary")


def _in_blocks(df: DataFrame, group: str, blocks: str) -> DataFrame:
    """Every row once for each pair of blocks of its group that its own block belongs to."""
    own = F.pmod(F.xxhash64("doc_id"), F.col(blocks))
    placed = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return placed.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", blocks)


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _near_pairs(least: float):
    """Pairs whose codes agree in a share of at least ``least`` of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _codes(batch["a_code"]), _codes(batch["b_code"])
                near = pa.array((a == b).sum(1) >= least * a.shape[1])
                yield pa.RecordBatch.from_arrays([batch["a"].filter(near), batch["b"].filter(near)], ["a", "b"])

    return run


def _sets(hasher: WordHasher, texts: pa.ChunkedArray) -> list[np.ndarray]:
    return [s for _, _, some in slices(texts.combine_chunks()) for s in _shingle_sets(hasher, some)]


def _similar(size: np.ndarray, other: int, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (size + other - common)


def _spokes(percent: int):
    """Links (hub, member) of members whose full sets are similar enough to their hub's; a hub may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near-duplicates")
        hasher = WordHasher()
        for part in runs_of_rows(batches, ["a", "go"]):
            ids, is_hub = part["b"].to_numpy(), part["a"].to_numpy() == part["b"].to_numpy()
            sets = _sets(hasher, part["text"])
            size = np.fromiter(map(len, sets), np.int64, len(sets))  # rows of a repeated doc_id may have no words
            rows = np.flatnonzero(~is_hub & (size > 0))
            if not len(rows):
                continue
            elements = np.concatenate([sets[i] for i in rows])
            first = np.concatenate([[0], np.cumsum(size[rows])[:-1]])
            linked = np.zeros(len(rows), bool)
            for hub in np.flatnonzero(is_hub & (size > 0)):
                common = np.add.reduceat(np.isin(elements, sets[hub]).astype(np.int64), first)
                linked |= _similar(size[rows], size[hub], common, percent)
            if linked.any():
                yield _link_batch([(part["a"][0].as_py(), i) for i in np.unique(ids[rows[linked]])])

    return run


def _similar_codes(least: float):
    """Forests over the components of members of bucket blocks whose codes agree in a share of at least ``least`` of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for part in runs_of_rows(batches, ["bucket", "lo", "hi"]):
            component, own = part["component"].to_numpy(), part["own"].to_numpy()
            codes = _codes(part["code"])
            across = own.min() != own.max()
            sets = UnionFind()
            for i in range(len(component) - 1):
                other = component[i + 1 :] != component[i]
                if across:
                    other &= own[i + 1 :] != own[i]
                at = np.flatnonzero(other) + i + 1
                near = at[(codes[at] == codes[i]).sum(1) >= least * codes.shape[1]]
                out += [(component[i], j) for j in np.unique(component[near]) if sets.union(int(component[i]), int(j))]
            if len(out) > 10_000:
                yield _link_batch(out)
                out = []
        if out:
            yield _link_batch(out)

    return run


def _linked_sets(percent: int):
    """Forests over the components of members of loose blocks whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near-duplicates")
        hasher = WordHasher()
        for part in runs_of_rows(batches, ["loose", "lo", "hi"]):
            component, own = part["component"].to_numpy(), part["own"].to_numpy()
            across = own.min() != own.max()
            if component.min() == component.max():
                continue
            sets = _sets(hasher, part["text"])
            there = np.fromiter(map(len, sets), np.int64, len(sets)) > 0  # rows of a repeated doc_id may have no words
            component, own, sets = component[there], own[there], [s for s in sets if len(s)]
            most = len(np.unique(component)) - 1
            if most < 1:
                continue
            first = np.cumsum([0, *map(len, sets)])
            size = np.diff(first)
            _, number = np.unique(np.concatenate(sets), return_inverse=True)
            marked = np.zeros(number.max() + 2, np.int64)
            forest, out = UnionFind(), []
            for i in range(len(component) - 1):
                if len(out) == most:
                    break  # all are in one set
                other = component[i + 1 :] != component[i]
                if across:
                    other &= own[i + 1 :] != own[i]
                if not other.any():
                    continue
                marked[number[first[i] : first[i + 1]]] = 1
                common = np.add.reduceat(marked[number[first[i + 1] :]], first[i + 1 : -1] - first[i + 1])
                marked[number[first[i] : first[i + 1]]] = 0
                linked = other & _similar(size[i + 1 :], size[i], common, percent)
                out += [(component[i], j) for j in np.unique(component[i + 1 :][linked]) if forest.union(int(component[i]), int(j))]
            if out:
                yield _link_batch(out)

    return run


def _tasks(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())


def _links_to_hubs(docs: DataFrame, one: DataFrame, members: DataFrame, hubs: DataFrame, least: float, percent: int) -> DataFrame:
    """Links between the members of buckets and their hubs."""
    spokes = members.join(hubs, "bucket").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct()
    codes = [one.select(F.col("doc_id").alias(k), F.col("code").alias(f"{k}_code")) for k in "ab"]
    near = in_arrow(spokes.join(codes[0], "a").join(codes[1], "b").select("a", "b", "a_code", "b_code"), _near_pairs(least), "a long, b long")
    size = one.select(F.col("doc_id").alias("b"), "n_shingles").groupBy("b").agg(F.sum("n_shingles").alias("size"))
    pairs = cut(near.distinct().join(size, "b"), "spokes")
    goes = F.ceil(F.greatest(F.count(F.lit(1)) / SPOKES, F.sum("size") / SHINGLES)).alias("goes")
    dealt = pairs.join(cut(pairs.groupBy("a").agg(goes), "goes"), "a").select("a", "b", F.pmod(F.xxhash64("b"), "goes").alias("go"))
    dealt = cut(dealt, "dealt")
    # a hub's text once a go
    rows = dealt.union(dealt.select("a", F.col("a").alias("b"), "go").distinct())
    texts = _texts(docs).withColumnRenamed("doc_id", "b").join(small(rows, BROADCAST_ROWS), "b").select("a", "go", "b", "text")
    return cut(in_arrow(_tasks(texts, ["a", "go"]), _spokes(percent), "a long, b long"), "links")


def _links_across(docs: DataFrame, one: DataFrame, members: DataFrame, labels: DataFrame, least: float, percent: int) -> DataFrame | None:
    """Links between the components that members of one bucket are in; None if all buckets are settled."""
    # buckets of several components, in blocks
    of = labels.select(F.col("id").alias("doc_id"), "component")
    parted = cut(members.where("n > 2").join(of, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "parted")
    several = parted.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    open_ = cut(parted.join(cut(several, "open"), "bucket"), "open-members")
    forget(parted)
    if open_.isEmpty():
        return None
    dealt = open_.withColumn("blocks", F.ceil(F.col("n") / MEMBERS)).drop("n")
    coded = _in_blocks(dealt.join(one.select("doc_id", "code"), "doc_id"), "bucket", "blocks")
    met_codes = _tasks(coded.select("bucket", "lo", "hi", "own", "component", "code"), ["bucket", "lo", "hi"])
    near = cut(in_arrow(met_codes, _similar_codes(least), "a long, b long"), "near")
    if near.isEmpty():
        return None
    loose = components(near).select(F.col("id").alias("component"), F.col("component").alias("loose"))

    # full sets of those, in blocks
    grouped = open_.select("doc_id", "component").distinct().join(loose, "component").join(one.select("doc_id", "n_shingles"), "doc_id")
    grouped = cut(grouped, "grouped")
    blocks = F.ceil(F.greatest(F.sum("n_shingles") / SHINGLES, F.count(F.lit(1)) / MEMBERS)).alias("blocks")
    blocks = cut(grouped.groupBy("loose").agg(blocks), "blocks")
    wanted = cut(grouped.join(blocks, "loose").select("doc_id", "component", "loose", "blocks").distinct(), "wanted")
    placed = _in_blocks(_texts(docs).join(small(wanted, BROADCAST_ROWS), "doc_id"), "loose", "blocks").select("loose", "lo", "hi", "own", "component", "text")
    more = cut(in_arrow(_tasks(placed, ["loose", "lo", "hi"]), _linked_sets(percent), "a long, b long"), "more-links")
    forget(open_, near, grouped, blocks, wanted)
    return None if more.isEmpty() else more


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs(doc_id, text)``.

    Links join documents with ``100 * intersection >= percent * union``; component_id is the smallest doc_id reached.
    A null text counts as empty; empty documents, and rows without a doc_id, are linked with nothing and kept (the latter
    have no component). Rows of one doc_id count as one document. Other columns are not read.
    """
    sketches = cut(sketch(docs), "sketch")
    with_set = sketches.where("digest is not null and doc_id is not null")
    classes = cut(with_set.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "code")).alias("r")), "classes")
    one = classes.select("digest", "r.doc_id", "r.n_shingles", "r.bands", "r.code")

    # buckets of two or more, and the hub of each
    buckets = one.select("doc_id", F.explode("bands").alias("bucket"))
    met = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(buckets.join(cut(met, "buckets"), "bucket").distinct(), "members")
    weights = cut(members.groupBy("doc_id").agg(F.sum("n").alias("weight")), "weights")
    heaviest = members.join(weights, "doc_id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("back"))).alias("hub"))
    hubs = cut(heaviest.select("bucket", (-F.col("hub.back")).alias("a")), "hubs")
    least = percent / 100 - MARGIN
    links = _links_to_hubs(docs, one, members, hubs, least, percent)
    found = components(links)
    more = _links_across(docs, one, members, found, least, percent)
    if more is not None:
        links = cut(links.union(more), "all-links")
        found = components(links)

    labels = one.select("digest", F.col("doc_id").alias("id")).join(found, "id", "left")
    of_class = cut(labels.select("digest", F.coalesce("component", "id").alias("component_id")), "component")
    forget(classes, members, weights, hubs, links, found)
    out = sketches.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, that of the smallest doc_id, with the columns it came with.

    Empty documents and rows without a doc_id are all kept. Of several rows of a kept doc_id, that of the longest text stays.
    """
    name = fresh(docs)
    groups = cut(near_duplicates(docs, percent), "groups")
    ids = small(groups.where("not kept").select(F.col("doc_id").alias(name)).distinct(), BROADCAST_ROWS)
    out = docs.join(ids, docs["doc_id"].cast("long") == ids[name], "left_anti")
    repeated = groups.where("kept").groupBy("doc_id").count().where("doc_id is not null and count > 1")
    if repeated.isEmpty():
        return out
    # the longest text, so that neither chance nor an empty row decides
    own = fresh(out)
    repeated = cut(repeated.select("doc_id"), "repeated")
    longest = F.max_by(F.struct(*out.columns), F.struct(F.coalesce(F.octet_length("text"), F.lit(-1)), F.xxhash64(*out.columns)))
    several = out.join(small(repeated, BROADCAST_ROWS), "doc_id").select(*out.columns)
    one = several.groupBy("doc_id").agg(longest.alias(own)).select(f"{own}.*")
    return out.join(small(repeated, BROADCAST_ROWS), "doc_id", "left_anti").select(*out.columns).union(one)
