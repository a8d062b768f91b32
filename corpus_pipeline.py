"""Documents for training: five stages, each on all rows that the one before it kept.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last
returns the token ids. A stage's result is written as Parquet and read back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.anchored_pii import without_personal_data
from graphloom.llm.merge_dropout import encode
from graphloom.llm.rule_ledger import PROSE, keep_passing
from graphloom.llm.superminhash import without_near_duplicates
from graphloom.llm.tables import cut, table
from graphloom.llm.template_decontamination import without_contaminated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy for prose."""
    return keep_passing(docs, PROSE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of similarity 0.8 or more."""
    return without_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the names of its kinds."""
    return without_personal_data(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether the ids decode to the text, for all documents."""
    return encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: the ids come from a vocabulary file that SQL cannot read; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
