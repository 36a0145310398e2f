"""Registered queries over files: sources read from CSV that Spark wrote, and sinks read back in their order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlascope.operators import judge
from charlascope.operators.report import case_report
from charlascope.operators.turns import build_turns
from charlascope.operators.validate import post_validate
from charlascope.plans import fixtures
from charlascope.session import cut_lineage, run_folder
from charlascope.sources import sinks
from charlascope.sources.chats import load_chats, load_turns, preview_chats
from charlascope.sources.training import load_training, preview_training

LEGACY = {"session_id": "cod_wts_jsessionid", "texto": "ds_wts_message", "intent_detectado": "ds_wts_intent", "tipo": "tipo_mensaje"}


def _folder(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/files-{uuid.uuid4().hex}"


def _written(frame: DataFrame, *order: str) -> str:
    """A CSV folder of a frame in the given order, without the order columns that are not data."""
    folder = _folder(frame.sparkSession)
    frame.orderBy(*order).drop("ord").write.csv(
        folder, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return folder


def _chat_file(spark: SparkSession, sf_dir: str) -> str:
    """All chats under their legacy header; a session is named on its first row only and filled down by the reader."""
    rows = fixtures.chats(spark, sf_dir)
    named = rows.withColumn("session_id", F.when(F.col("turn_index") == 0, F.col("session_id")))
    return _written(named.drop("turn_index").withColumnsRenamed(LEGACY), "ord")


def csv_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load_turns(spark, _chat_file(spark, sf_dir))
    return turns.select(
        "session_id", "turn_index", "tipo", "intent_detectado", "intent_norm", "is_no_match", "flow_from_intent",
        F.length("texto").cast("bigint").alias("n_chars"), F.length("texto_norm").cast("bigint").alias("n_norm"),
    )


def csv_event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per row, so the file is read in splits; the session is on every row."""
    rows = fixtures.long_chats(spark, sf_dir)
    accepted, _ = load_chats(spark, _written(rows.drop("turn_index"), "ord"))
    return build_turns(accepted).select("ord", "session_id", "tipo", "texto", "intent_detectado", "is_no_match")


def csv_chat_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preview_chats(spark, _chat_file(spark, sf_dir))
    return rows.select(
        F.coalesce("cod_wts_jsessionid", F.lit("")).alias("session_id"), "tipo_mensaje",
        F.coalesce("ds_wts_message", F.lit("")).alias("ds_wts_message"), F.coalesce("ds_wts_intent", F.lit("")).alias("ds_wts_intent"),
    )


def _training_file(spark: SparkSession, sf_dir: str) -> str:
    rows = fixtures.block_training(spark, sf_dir)
    return _written(
        rows.select("ord", F.col("intent").alias("Intent Display Name"), F.col("language").alias("Language"), F.col("phrase").alias("Phrase")),
        "ord",
    )


def csv_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_training(spark, _training_file(spark, sf_dir))
    return rows.select("row_id", "intent", "flow", "language", F.length("phrase").cast("bigint").alias("n_chars"))


def csv_training_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preview_training(spark, _training_file(spark, sf_dir))
    return rows.select(F.col("ord").alias("row_id"), F.col("Intent Display Name").alias("intent"), F.col("Language").alias("language"))


def _judged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = judge.add_slot_signals(fixtures.triggers(spark, sf_dir))
    return cut_lineage(case_report(post_validate(judge.with_judgement(cases, fixtures.responses(spark, sf_dir)))))


def _sunk(write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame], spark, sf_dir) -> DataFrame:
    """A report written by a sink and read back in file order."""
    folder = _folder(spark)
    write(_judged_report(spark, sf_dir), folder)
    return read(spark, folder).select(
        "pos", "case_id", "session_id", "mensaje_no_match", "bot_no_match_text", "flow_ref", "decision", "flow_recommended",
        "intent_top", "slot_signals", "improvements", "new_training_phrases", "confidence", "review_flag",
    )


def cases_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sunk(sinks.write_cases, sinks.read_cases_in_order, spark, sf_dir)


def audit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sunk(sinks.write_audit, sinks.read_audit_in_order, spark, sf_dir)


def debug_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_debug(_judged_report(spark, sf_dir), folder)
    rows = spark.read.schema(f"debug_id string, {sinks.REPORT_SCHEMA}").json(f"{folder}/{sinks.DEBUG}")
    return rows.select("debug_id", "case_id", "decision", "confidence", "review_flag")


def empty_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report without cases leaves: a header, no audit line, no case, and no roll-up."""
    folder, report = _folder(spark), _judged_report(spark, sf_dir).where("case_id is null")
    sinks.write_reports(report, folder)
    header = spark.read.text(f"{folder}/{sinks.CASES}").select(F.lit("case file").alias("part"), F.col("value").alias("line"))
    counts = sinks.read_cases(spark, folder).agg(F.count(F.lit(1)).alias("n"))
    return header.unionByName(counts.select(F.lit("cases").alias("part"), F.col("n").cast("string").alias("line")))


def rollup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed documents, read back from their files and taken apart."""
    folder = _folder(spark)
    sinks.write_documents(_judged_report(spark, sf_dir), folder)
    shape = "cantidad_casos bigint, decisiones array<string>, resumen_decisiones map<string,bigint>, improvements_consolidados array<string>"
    rows = spark.read.schema("section string, key string, value string").json(f"{folder}/{sinks.ROLLUP}/documents")
    parsed = rows.withColumn("v", F.from_json("value", shape))
    counts = F.transform(F.map_entries("v.resumen_decisiones"), lambda e: F.format_string("%s:%d", e["key"], e["value"]))
    return parsed.select(
        "section",
        "key",
        F.coalesce("v.cantidad_casos", F.col("value").cast("bigint")).alias("cases"),
        F.md5(F.coalesce(F.array_join("v.decisiones", ","), F.lit(""))).alias("decisions_md5"),
        F.coalesce(F.array_join(counts, ","), F.lit("")).alias("counts"),
        F.md5(F.coalesce(F.array_join("v.improvements_consolidados", "|"), F.lit(""))).alias("improvements_md5"),
    )


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "csv_chat_turns": csv_chat_turns,
        "csv_event_turns": csv_event_turns,
        "csv_chat_preview": csv_chat_preview,
        "csv_training": csv_training,
        "csv_training_preview": csv_training_preview,
        "cases_round_trip": cases_round_trip,
        "audit_round_trip": audit_round_trip,
        "debug_round_trip": debug_round_trip,
        "empty_report_files": empty_report_files,
        "rollup_documents": rollup_documents,
    }
