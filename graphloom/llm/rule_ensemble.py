"""A quality classifier made of sparse rules.

Every text is measured once. A forest of shallow trees is grown on the statistics of labelled documents; the way from a
root to each of its nodes, a conjunction of bounds, is a rule. A lasso logistic regression over all rules and the statistics
themselves gives most of them no weight. The rest is compiled into one column expression, by which all documents are
scored inside Spark.

Training takes at most ``SAMPLE`` labelled rows, picked by a hash of doc_id; rows whose crc32(doc_id as text) is divisible by
``FOLDS`` are held out. Inputs of a score are counts and shares of characters, words and lines of the text, nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.rule_ledger import MEASURES, measure_texts
from graphloom.llm.tables import cut, forget, in_arrow, utf8
from graphloom.llm.words import U64, WordHasher, mix, slices

SAMPLE = 50_000
FOLDS = 5
TREES, DEPTH = 16, 3
LASSO = 0.002
THRESHOLD = 0.3
STATISTICS = (
    "log_words",
    "word_length",
    "symbols_per_word",
    "repeated_lines",
    "repeated_runs",
    "capitals",
    "exclamations_per_word",
    "digits",
    "distinct_words",
    "lines_per_word",
    "stops_per_word",
    "other_letters",
    "equal_neighbours",
)


class Bound(NamedTuple):
    statistic: int
    above: bool  # greater than the value; otherwise at most the value
    value: float


Rule = tuple[Bound, ...]


class Model(NamedTuple):
    intercept: float
    rules: list[tuple[float, Rule]]
    linear: list[tuple[float, int]]


def statistics(hasher: WordHasher, texts: list[bytes | None]) -> np.ndarray:
    """A row of STATISTICS for each text, zeros for an empty one."""
    m = dict(zip(MEASURES, measure_texts(hasher, texts)))
    found = hasher(texts)
    n = len(texts)
    text_of = np.repeat(np.arange(n), np.diff(found.first))
    _, index = np.unique(mix(found.hashes + text_of.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(text_of[index], minlength=n)
    same = (found.hashes[1:] == found.hashes[:-1]) & (text_of[1:] == text_of[:-1])
    neighbours = np.bincount(text_of[1:][same], minlength=n)
    digits, stops, other, size = (np.array(c, np.float64) for c in zip(*(_characters(t or b"") for t in texts)))
    words, lines, letters = (np.maximum(m[c], 1) for c in ("n_words", "n_lines", "n_letters"))
    size = np.maximum(size, 1)
    return np.stack(
        [
            np.log1p(m["n_words"]),
            m["word_chars"] / words,
            m["n_symbols"] / words,
            m["n_dup_lines"] / lines,
            m["n_repeat_words"] / words,
            m["n_upper"] / letters,
            m["n_bangs"] / words,
            digits / size,
            distinct / words,
            m["n_lines"] / words,
            stops / words,
            other / size,
            neighbours / words,
        ],
        axis=1,
    )


_HIGH = bytes(range(0x80, 0x100))


def _characters(text: bytes) -> tuple[int, int, int, int]:
    n = len(text)
    return n - len(text.translate(None, b"0123456789")), text.count(b"."), n - len(text.translate(None, _HIGH)), n


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each row of ``docs(doc_id, text)``; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for lo, hi, texts in slices(batch["text"]):
                stats = statistics(hasher, texts)
                first = pa.array(np.arange(len(stats) + 1) * len(STATISTICS), pa.int32())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.ListArray.from_arrays(first, pa.array(stats.reshape(-1)))], ["doc_id", "stats"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()), run, "doc_id long, stats array<double>")


def held_out(doc_id: Column) -> Column:
    """A row without a doc_id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def tree_rules(description: str) -> list[Rule]:
    """The distinct rules of a forest, from its text form, without repeated bounds of one rule."""
    rules: dict[Rule, None] = {}
    way: list[Bound] = []
    base = 0
    for line in description.splitlines():
        if line.lstrip().startswith("Tree "):
            base = len(line) - len(line.lstrip()) + 2  # a tree's first split stands two blanks further in
        found = re.match(r"( *)(?:If|Else) \(feature ([0-9]+) (<=|>) ([-0-9.Ee]+)\)", line)
        if found:
            depth = len(found[1]) - base
            way[depth:] = [Bound(int(found[2]), found[3] == ">", float(found[4]))]
            tightest: dict[tuple[int, bool], Bound] = {}
            for b in way:
                old = tightest.get((b.statistic, b.above), b)
                tightest[b.statistic, b.above] = max(old, b) if b.above else min(old, b)
            rules[tuple(sorted(tightest.values()))] = None
    return list(rules)


def bound(stats: Column, b: Bound) -> Column:
    value = stats[b.statistic]
    return value > F.lit(b.value) if b.above else value <= F.lit(b.value)


def conjunction(stats: Column, rule: Rule) -> Column:
    out = bound(stats, rule[0])
    for b in rule[1:]:
        out = out & bound(stats, b)
    return out


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 7) -> Model:
    """A model from (stats, label) with labels 0 and 1. With one class only, or no rows, it is a constant."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    ones, n = counts.get(1, 0), sum(counts.values())
    if len(counts) < 2:
        return Model(float(np.log((ones + 1) / (n - ones + 1))), [], [])
    vectors = labelled.select(array_to_vector("stats").alias("features"), F.col("label").cast("double").alias("label"), "stats")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    stats = F.col("stats")
    terms = F.concat(F.array(*[conjunction(stats, r).cast("double") for r in rules]), stats) if rules else stats
    coded = vectors.select(array_to_vector(terms).alias("features"), "label")
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(coded)
    weights = lasso_fit.coefficients.toArray().tolist()
    kept = [(w, r) for w, r in zip(weights, rules) if w]
    return Model(float(lasso_fit.intercept), kept, [(w, i) for i, w in enumerate(weights[len(rules) :]) if w])


def compiled(model: Model, stats: Column) -> Column:
    """The probability of label 1 as a column expression."""
    total = F.lit(model.intercept)
    for weight, rule in model.rules:
        total = total + F.when(conjunction(stats, rule), F.lit(weight)).otherwise(0.0)
    for weight, statistic in model.linear:
        total = total + F.lit(weight) * stats[statistic]
    return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(700.0)), F.lit(-700.0))))


def quality_scores(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs(doc_id, text)``, learned from ``labels(doc_id, <column>)``.

    Labels other than 0 and 1, null ones and those without a document do not count. Other columns are not read.
    """
    stats = cut(measured(docs), "stats")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("label in (0, 1)")
    training = marked.where(~held_out(F.col("doc_id")))
    n = training.count()
    if n > sample:
        training = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)
    labelled = cut(training.join(stats, "doc_id").select("stats", "label"), "labelled")
    model = fit(labelled)
    forget(labelled)
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(model, F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
