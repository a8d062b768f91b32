"""A ledger of quality rules: one pass measures every text, one bit a rule records its failures, policies read the bits.

A policy is a named and versioned set of rules; it keeps the documents with none of its bits set. A new policy, or the
question what a rule does, needs only the ledger: ``ablation`` counts documents by bit pattern and answers from the
patterns. Texts are not read again.

Words are runs without space, tab, line feed, vertical tab, form feed and carriage return. A null or empty text has no
words, fails ``short`` and no other rule.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.llm.tables import fresh, small_batches, utf8
from graphloom.llm.words import U64, WordHasher, mix, slices, windows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bangs")
WINDOW = 5


class Rule(NamedTuple):
    name: str
    fails: Callable[[Callable[[str], Column]], Column]  # from a function that gives a measure's column


#: a rule's bit is its place here; new rules go to the end, so that old ledgers stay readable
RULES = (
    Rule("short", lambda m: m("n_words") < 10),
    Rule("repetition", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule("capitals", lambda m: (m("n_letters") >= 40) & (100 * m("n_upper") > 50 * m("n_letters"))),
    Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
    Rule("exclamations", lambda m: 100 * m("n_bangs") > 50 * m("n_words")),
)
BITS = {rule.name: 1 << place for place, rule in enumerate(RULES)}


class Policy(NamedTuple):
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("short", "repetition"))
#: the base and all that tells tables, shouting and symbol noise from prose
PROSE = Policy("prose", 1, tuple(BITS))

_CONTINUED = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def _repeat_words(runs: np.ndarray, at: np.ndarray, begin: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text inside a run that the text has twice or more."""
    text = np.repeat(np.arange(len(begin) - 1, dtype=U64), np.diff(begin))
    key = mix(runs + text * U64(0x9E3779B97F4A7C15))  # runs of one text only meet each other
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(first[-1] + 1, np.int64)
    edges[at[twice]] += 1
    np.subtract.at(edges, at[twice] + WINDOW, 1)
    covered = np.cumsum(edges[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[first[1:]] - total[first[:-1]]


def _without(text: bytes, drop: bytes) -> int:
    return len(text.translate(None, drop))


def measure_texts(hasher: WordHasher, texts: list[bytes | None]) -> list[np.ndarray]:
    """An array for each of MEASURES."""
    found = hasher(texts)
    repeat = _repeat_words(*windows(found.hashes, found.first, WINDOW, short=False), found.first)
    rows = []
    for text in texts:
        text = text or b""
        lines = [line for line in text.split(b"\n") if line.strip(_SPACES)]
        n = len(text)
        rows.append(
            (
                _without(text, _CONTINUED + _SPACES),
                n - _without(text, b"#*$%&|<>"),
                len(lines),
                len(lines) - len(set(lines)),
                n - _without(text, _LETTERS),
                n - _without(text, _UPPER),
                text.count(b"!"),
            )
        )
    chars, symbols, lines, dup, letters, upper, bangs = np.array(rows, np.int64).T
    return [np.diff(found.first), chars, symbols, lines, dup, repeat, letters, upper, bangs]


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measure(texts: pa.Array) -> pa.Array:
    hasher = WordHasher()
    parts = [[np.zeros(0, np.int64)] * len(MEASURES), *(measure_texts(hasher, some) for _, _, some in slices(texts))]
    columns = [np.concatenate(c) for c in zip(*parts)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def failed_bits(measure: Callable[[str], Column]) -> Column:
    """One bit for each rule that the measures fail."""
    bits = [F.when(rule.fails(measure), F.lit(BITS[rule.name])).otherwise(0).cast("long") for rule in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measures, failed_bits) of each row of ``docs(doc_id, text)``; other columns are not read."""
    small_batches(docs.sparkSession)
    measured = docs.select("doc_id", _measure.asNondeterministic()(utf8()).alias("m"))
    flat = measured.select("doc_id", *[F.col(f"m.{m}") for m in MEASURES])
    return flat.withColumn("failed_bits", failed_bits(F.col))


def ablation(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """(policy, version, rule, documents, rejected, failing, only_this_rule) for every rule of every policy.

    ``entries`` needs failed_bits only and may come from any earlier run. Documents are counted by bit pattern first, of
    which there are at most two to the number of rules; ``only_this_rule`` are those the policy would keep without the rule.
    """
    patterns = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for p in policies for r in p.rules]
    rows = patterns.withColumn("case", F.explode(F.array(*cases))).select("failed_bits", "n", "case.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))

    def counted(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return rows.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("documents"),
        counted(hit != 0, "rejected"),
        counted(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, "failing"),
        counted(hit == F.col("bit"), "only_this_rule"),
    )


def keep_passing(docs: DataFrame, policy: Policy = PROSE) -> DataFrame:
    """The rows of ``docs`` that pass the policy, with the columns they came with."""
    name = fresh(docs)
    small_batches(docs.sparkSession)
    measured = docs.withColumn(name, _measure.asNondeterministic()(utf8()))
    return measured.where(passes(failed_bits(lambda m: F.col(f"{name}.{m}")), policy)).drop(name)
