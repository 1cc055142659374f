"""Corpus pipeline: documents in, token files out.

Five stages, each over all that the one before kept: host-level quality rules (rejected documents go), the
n-gram Jaccard join (one document of each group stays), benchmark decontamination (documents that leak an
item go), mixing to target weights (a document stays as often as the mix takes it, or goes) and token
output (the last stage, one row a document of the files that it wrote and read back).

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents``; ``run`` writes every stage's
result as Parquet into the shared folder and reads it again, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import group_join, host_quality, source_mix, template_leaks, token_files
from palimpsest.llm.common import read_table
from palimpsest.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that fail the base rules, or a rule that their host is condemned for, go."""
    judged = host_quality.judge(docs)
    verdict = judged.columns[-1]
    return judged.where(f"`{verdict}`.kept").drop(verdict)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each component of similar documents stays."""
    return group_join.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that leak a benchmark item go."""
    return template_leaks.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document as often as the mix takes it."""
    return source_mix.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token files written and read back, one digest row a document."""
    path = token_files.scratch(spark)
    token_files.write(docs, path)
    return token_files.digest(token_files.read(spark, path))


STAGES = [("quality_rules", quality_rules), ("ngram_join", ngram_join), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("token_output", token_output)]

ORACLE_SQL = None  # tokens and draws are not for SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
