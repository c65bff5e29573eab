"""From raw documents to training records: five stages, each one operator over all rows.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept,
and is written as Parquet and read again before the next one. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from nearmesh.llm import decontaminate, mixing, near_dedup, quality, token_output
from nearmesh.llm.common import read, write_table
from nearmesh.llm.queries import ORDER_KEY
from nearmesh.session import step_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A text that is null or has no words is rejected. Rows with equal columns are
    judged alike, null ids like others. Without labels of both classes everything
    that has words stays; an empty table stays empty; further columns pass unchanged.
    """
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id.

    Texts without words (also null ones) are classes of their own and stay; null ids
    come after all others; of equal rows any one stays; an empty table stays empty;
    further columns pass unchanged.
    """
    return near_dedup.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go.

    Null and empty texts hold none and stay; equal rows are judged alike; with an
    empty benchmark everything stays, an empty table stays empty; further columns
    pass unchanged.
    """
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the source, language and topic targets.

    Null sources and languages are values of their own; documents without words go;
    rows with one id and cell are decided alike, null ids by one fixed number; an
    empty table stays empty; further columns pass unchanged.
    """
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids in training order; the shard files are written beside the step tables as the rows are computed.

    Null and empty texts make no sequence, null ids are kept as null, repeated rows
    are sequences of their own, an empty table makes neither rows nor files.
    """
    ordered = token_output.training_order(docs, ORDER_KEY)
    return token_output.with_shards(ordered, f"{step_dir(spark)}/token-shards-{uuid.uuid4().hex}")


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
