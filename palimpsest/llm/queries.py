"""Registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (group_join, host_quality, importance, license_scan, line_templates, pii, secrets, source_mix,
                            template_leaks, token_files, toxicity, turn_repair, word_runs)
from palimpsest.llm.common import in_small_batches, read_table, with_fields


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_small_batches(read_table(spark, sf_dir, "documents"))


def _fields(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def op1_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.join(_documents(spark, sf_dir))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    sized = docs.select("doc_id", "source", source_mix.n_words(F.col("text")).alias("size"))
    return source_mix.rounded(sized).select("doc_id", "size", "source_size", "target",
                                            (F.col("copies") * F.col("size")).alias("taken"), "source")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.scratch(spark)
    token_files.write(_documents(spark, sf_dir), path)
    return token_files.digest(token_files.read(spark, path))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = secrets.train(docs)
    return with_fields(docs, secrets.scan(F.col("text"), model), _fields(secrets.FIELDS), ["doc_id"])


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scanned = with_fields(docs, license_scan.scan(F.col("text")), _fields(license_scan.FIELDS.split(", method_spans")[0])
                          + ["method_spans"], ["doc_id"])
    spans = F.transform("method_spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["stop"], s["edits"]))
    return scanned.withColumn("method_spans", F.array_join(spans, ","))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = importance.resample(_documents(spark, sf_dir).select("doc_id", "text"),
                               read_table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "importance.log_weight", "importance.gumbel_key", F.lit(True).alias("kept"))


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaks(_documents(spark, sf_dir),
                                read_table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.report(_documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return with_fields(docs, pii.scan(F.col("text")), _fields(pii.FIELDS), ["doc_id"])


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return host_quality.judge(docs).select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                         toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scanned = docs.select("doc_id", word_runs.scan(word_runs.looped(F.col("text"), F.col("doc_id"))).alias("s"))
    return scanned.select("doc_id", *[c.alias(name) for name, c in word_runs.digest(F.col("s")).items()])


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, present = turn_repair.damaged(read_table(spark, sf_dir, "conversations"))
    return turn_repair.audits(turn_repair.faulty(turns, present))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_group_join": op1_group_join, "op2_source_mix": op2_source_mix, "op3_token_files": op3_token_files,
            "op6_importance": op6_importance, "op7_template_leaks": op7_template_leaks,
            "op8_line_templates": op8_line_templates, "op4_secret_scan": op4_secret_scan, "op5_license_scan": op5_license_scan, "op9_pii": op9_pii,
            "op10_host_quality": op10_host_quality, "op11_toxicity": op11_toxicity, "op12_word_runs": op12_word_runs,
            "op13_turn_repair": op13_turn_repair}


def oracle_sql() -> dict[str, str]:
    return {"op1_group_join": group_join.SQL, "op8_line_templates": line_templates.SQL,
            "op10_host_quality": host_quality.SQL}
