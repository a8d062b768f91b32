"""Spelling variants of the words of a corpus, found as pairs of trie nodes.

Words are numbered in code-point order. The nodes of a trie of the words and of a trie of the reversed words get integers,
so a word of length L is a row of L + 1 prefix nodes and L + 1 suffix nodes, and a pair (prefix node, suffix node) says in two
integers what would otherwise be a string with a hole:

* pairs that skip position i, (word[:i], word[i + 1:]), of two words of one length are equal just where the words differ in
  position i alone;
* a pair that skips a position of one word equals a pair that skips none of another, (word[:i], word[i:]), just where the
  other word is the first one without that position. Of a run of equal letters only the last position counts for this.

So all neighbours meet under equal pairs, each in one pair only, and nothing has to be checked afterwards. Words under a
pair that skips a position differ in one letter, so there are at most as many as letters, and one word that skips none. Rows for
each word and pair hold counts and the best neighbour; neighbours are never listed.

A node of depth seven or less is its path, a byte a letter. Deeper nodes are counted by the task that has all words of their
first seven letters, from the sorted words, with one word held at a time.

Null texts have no words; a null doc_id is the empty string in the key of the deletion. Rows of one doc_id count each.
Other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import cut, forget, in_arrow, partitions

LETTERS = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSS = 97  # a run loses a letter where this divides the CRC-32 of its key
LENGTH, OCCURRENCES = 5, 3  # least of a word
PACKED = 7  # letters that fit an integer


def _lower(run: str) -> Column:
    ascii_only = F.octet_length(run) == F.length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def word_counts(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the letter runs of all texts, after the deletions."""
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), 1)).alias("run"))
    low = runs.select("key", _lower("run").alias("run"))
    drawn = low.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    shorter = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = drawn.select(F.when(F.col("h") % LOSS == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= occurrences)


def trie_nodes(words: DataFrame, path: Column, name: str) -> DataFrame:
    """(id, ``name``): the numbers of the nodes on the path of each word, from the root to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TaskContext.get().partitionId() << 40
        last, nodes = b"", [0]
        for batch in batches:
            out = []
            for text in batch["path"].to_pylist():
                letters = text.encode("latin-1")
                depth, most = 0, min(len(letters), len(last))
                while depth < most and letters[depth] == last[depth]:
                    depth += 1
                nodes = nodes[: depth + 1]
                for d in range(depth + 1, len(letters) + 1):
                    if d <= PACKED:
                        nodes.append(int.from_bytes(letters[:d], "big"))
                    else:
                        counter += 1
                        nodes.append(-counter)
                last = letters
                out.append(nodes)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, pa.list_(pa.int64()))], ["id", name])

    paths = words.select("id", path.alias("path"))
    dealt = paths.repartition(partitions(words.sparkSession), F.substring("path", 1, PACKED)).sortWithinPartitions("path")
    return in_arrow(dealt, run, f"id long, {name} array<long>")


#: what a word puts under each of its pairs; kind 0 and 1 skip a position, 1 where its run of equal letters ends, 2 skips none
PAIRS = """explode(concat(
    transform(sequence(1, size), i -> struct(pre[i - 1] AS p, suf[size - i] AS s, if(substring(word, i, 1) = substring(word, i + 1, 1), 0, 1) AS kind)),
    transform(sequence(0, size), i -> struct(pre[i] AS p, suf[size - i] AS s, 2 AS kind))))"""


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words (id, word, n) that have near words; best is (n, -id) of the most frequent, ties to the least id."""
    pre, suf = trie_nodes(words, F.col("word"), "pre"), trie_nodes(words, F.reverse("word"), "suf")
    sized = words.join(pre, "id").join(suf, "id").withColumn("size", F.length("word"))
    pairs = sized.select("n", (-F.col("id")).alias("back"), F.expr(PAIRS).alias("pair")).select("n", "back", "pair.*")
    met = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct("n", "back", "kind")), False).alias("m")).where("size(m) > 1")
    split = met.select(
        "m",
        F.expr("filter(m, x -> x.kind < 2)").alias("skip"),
        F.expr("filter(m, x -> x.kind = 1)").alias("shorten"),
        F.expr("filter(m, x -> x.kind = 2)").alias("whole"),
    ).where("size(skip) > 0")
    each = split.select("skip", "shorten", "whole", F.explode("m").alias("x"))
    near = F.expr("if(x.kind = 2, size(shorten), size(skip) - 1 + if(x.kind = 1, size(whole), 0))")
    replaced = "if(skip[0].back = x.back, get(skip, 1), skip[0])"
    best = F.expr(f"if(x.kind = 2, get(shorten, 0), if(x.kind = 1 and get(whole, 0) is not null, greatest({replaced}, whole[0]), {replaced}))")
    found = each.select((-F.col("x.back")).alias("id"), near.alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best.n", "best.back")).alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(id, root): the end of the chain of forms (id, root) that begins at each id. Chains double in length each round."""
    up = cut(forms, "roots")
    while True:
        far = up.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = cut(up.join(far, "root", "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        forget(up)
        up = step
        if step.where("moved").isEmpty():
            return up


def spelling_variants(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``docs(doc_id, text)``.

    A word's form is its most frequent near word, if that is at least ``times`` as frequent; its root is where forms lead.
    """
    counts = word_counts(docs, length, occurrences)
    # ids rise with the words, so that the least id is the first word
    words = cut(counts.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    near = cut(neighbours(words), "near")
    known = words.join(near, "id", "left").withColumn("is_form", F.col("best.n") >= times * F.col("n"))
    formed = known.select("id", "word", "n", "n_near", F.when(F.col("is_form"), -F.col("best.back")).alias("form_id"))
    formed = cut(formed, "formed")
    roots = follow(formed.where("form_id is not null").select("id", F.col("form_id").alias("root")))
    forms = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    rooted = roots.join(ends, "root").select("id", "root_word")
    out = formed.join(forms, "form_id", "left").join(rooted, "id", "left")
    forget(near)
    root = F.coalesce("root_word", "word").alias("root")
    return out.select("word", "form", root, "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
