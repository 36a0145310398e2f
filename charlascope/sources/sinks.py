"""Report sinks: folders of part files written by all tasks, in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlascope.operators import rollup
from charlascope.operators.order import number_rows
from charlascope.operators.report import REPORT_SCHEMA
from charlascope.settings import REPORT_COLUMNS

CASES = "analisis_no_match.csv"
AUDIT = "auditoria.jsonl"
DEBUG = "cases_debug"
ROLLUP = "informe_general_mejora"


def write_cases(report: DataFrame, folder: str) -> None:
    """One CSV row per case; an empty report still writes the header."""
    rows = report.orderBy("ord").select(*REPORT_COLUMNS)
    rows.write.mode("overwrite").csv(
        f"{folder}/{CASES}",
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_audit(report: DataFrame, folder: str) -> None:
    """One JSON object per case, with null fields kept."""
    rows = report.orderBy("ord").select(*REPORT_COLUMNS)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{AUDIT}")


def write_debug(report: DataFrame, folder: str) -> None:
    """The same objects keyed by ``debug_id`` (a file-safe case id), as one dataset instead of a file per case."""
    rows = report.select(F.translate("case_id", ":", "_").alias("debug_id"), *REPORT_COLUMNS)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{DEBUG}")


def write_rollups(report: DataFrame, folder: str, document: bool = False) -> None:
    """Roll-up tables as JSON folders; with ``document`` also all of them nested in one JSON value, made in one task."""
    by_flow, by_intent = rollup.BY_FLOW, rollup.BY_INTENT
    tables = {
        "total": rollup.total_cases(report),
        "flow_cases": rollup.case_counts(report, by_flow).orderBy("flow"),
        "flow_decisions": rollup.decision_counts(report, by_flow),
        "flow_decision_sequence": rollup.decision_sequence(report, by_flow),
        "flow_messages": rollup.messages(report, by_flow),
        "flow_intents": rollup.intent_counts(report),
        "flow_improvements": rollup.improvements(report, by_flow),
        "flow_phrases": rollup.new_phrases(report),
        "intent_cases": rollup.case_counts(report, by_intent).orderBy("flow", "intent"),
        "intent_decisions": rollup.decision_counts(report, by_intent),
        "intent_decision_sequence": rollup.decision_sequence(report, by_intent),
        "intent_messages": rollup.messages(report, by_intent),
        "intent_improvements": rollup.improvements(report, by_intent),
        "summary": rollup.summary_lines(report).orderBy("section", "ord"),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{folder}/{ROLLUP}/{name}")
    write_documents(report, folder)
    if document:
        nested_rollup(report).write.mode("overwrite").text(f"{folder}/{ROLLUP}/document")


def write_reports(
    report: DataFrame,
    folder: str,
    jsonl: bool = True,
    debug: bool = False,
    rollups: bool = True,
    document: bool = False,
) -> None:
    """All sinks; without cases the roll-ups are left out. ``report`` is read several times: pass a stored one."""
    write_cases(report, folder)
    if jsonl:
        write_audit(report, folder)
    if debug:
        write_debug(report, folder)
    if rollups and not report.isEmpty():
        write_rollups(report, folder, document)


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The case report as written by ``write_cases``; the report has no nulls, so empty cells are empty texts."""
    return _case_rows(spark, folder).na.fill("")


def _case_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).csv(f"{folder}/{CASES}", header=True, multiLine=True, quote='"', escape='"')


def _in_file_order(rows: DataFrame) -> DataFrame:
    placed = rows.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return number_rows(placed, ["_path", "_start", "_at"], out="pos", start=1).select(*rows.columns, "pos")


def read_cases_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The case report with each row's place in the files, from 1, as ``pos``."""
    return _in_file_order(_case_rows(spark, folder)).na.fill("")


def read_audit_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The audit lines with their places in the files, from 1, as ``pos``."""
    return _in_file_order(spark.read.schema(REPORT_SCHEMA).json(f"{folder}/{AUDIT}"))


def write_documents(report: DataFrame, folder: str) -> None:
    """The roll-ups as one JSON line per topic and per topic and intent, in order of section and key."""
    rollup_documents(report).orderBy("section", "key").write.mode("overwrite").json(f"{folder}/{ROLLUP}/documents")


def nested_rollup(report: DataFrame) -> DataFrame:
    """One JSON document of both roll-ups; only for reports small enough to be one value.

    ``rollup_documents`` gives the same parts as rows.
    """
    flows, pairs = _bodies(report)
    as_map = lambda table, key, name: table.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("v"))), _by_key)).alias(name)
    )
    one = F.lit(1).alias("one")
    whole = (
        rollup.total_cases(report)
        .select(one, F.col("cases").alias("total_casos_no_match"))
        .join(as_map(flows, F.col("flow"), "por_flow").select(one, "por_flow"), "one")
        .join(as_map(pairs, F.concat_ws("|", "flow", "intent"), "por_intent").select(one, "por_intent"), "one")
    )
    return whole.select(F.to_json(F.struct("total_casos_no_match", "por_flow", "por_intent")).alias("value"))


def rollup_documents(report: DataFrame) -> DataFrame:
    """``(section, key, value)``: the total, and a JSON value for every topic and every topic and intent."""
    flows, pairs = _bodies(report)
    row = lambda section, key, value: (F.lit(section).alias("section"), key.alias("key"), value.alias("value"))
    total = rollup.total_cases(report).select(*row("total_casos_no_match", F.lit(""), F.col("cases").cast("string")))
    by_flow = flows.select(*row("por_flow", F.col("flow"), F.to_json("v")))
    return total.unionByName(by_flow).unionByName(
        pairs.select(*row("por_intent", F.concat_ws("|", "flow", "intent"), F.to_json("v")))
    )


def _bodies(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(flow, v)`` and ``(flow, intent, v)``: the roll-up of each group as one struct."""
    by_flow, by_intent = rollup.BY_FLOW, rollup.BY_INTENT

    def listed(table: DataFrame, keys: tuple[str, ...], value: str, place: str, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(place, value)))
        return table.groupBy(*keys).agg(F.transform(items, lambda i: i[value]).alias(name))

    def counted(table: DataFrame, keys: tuple[str, ...], value: str, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("first_ord", value, "n")))
        return table.groupBy(*keys).agg(
            F.map_from_entries(F.transform(items, lambda i: F.struct(i[value], i["n"]))).alias(name)
        )

    def body(keys: tuple[str, ...], messages: str, extra: list[DataFrame]) -> DataFrame:
        parts = [
            listed(rollup.decision_sequence(report, keys), keys, "decision", "pos", "decisiones"),
            counted(rollup.decision_counts(report, keys), keys, "decision", "resumen_decisiones"),
            listed(rollup.messages(report, keys), keys, "message", "pos", messages),
            listed(rollup.improvements(report, keys), keys, "improvement", "pos", "improvements_consolidados"),
            *extra,
        ]
        out = rollup.case_counts(report, keys).withColumnRenamed("cases", "cantidad_casos")
        for part in parts:
            out = out.join(part, list(keys), "left")
        return out

    merged = listed(rollup.new_phrases(report), ("flow", "intent_key"), "phrase", "pos", "list")
    first_place = rollup.new_phrases(report).groupBy("flow", "intent_key").agg(F.min("place").alias("place"))
    merged = merged.join(first_place, ["flow", "intent_key"])
    entries = F.array_sort(F.collect_list(F.struct("place", "intent_key", "list")))
    phrases = merged.groupBy("flow").agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["intent_key"], e["list"]))).alias(
            "new_training_phrases_consolidados"
        )
    )
    intents = counted(rollup.intent_counts(report), by_flow, "intent_top", "intent_top_counts")
    empty_list, empty_counts = F.array().cast("array<string>"), F.create_map().cast("map<string,bigint>")
    shared = [
        "cantidad_casos",
        F.coalesce("decisiones", empty_list).alias("decisiones"),
        F.coalesce("resumen_decisiones", empty_counts).alias("resumen_decisiones"),
    ]
    improved = F.coalesce("improvements_consolidados", empty_list).alias("improvements_consolidados")
    flow_value = F.struct(
        *shared,
        F.coalesce("mensajes_no_match", empty_list).alias("mensajes_no_match"),
        F.coalesce("intent_top_counts", empty_counts).alias("intent_top_counts"),
        improved,
        F.coalesce(
            "new_training_phrases_consolidados", F.create_map().cast("map<string,array<string>>")
        ).alias("new_training_phrases_consolidados"),
    )
    intent_value = F.struct(
        "flow", "intent", *shared, F.coalesce("mensajes_no_match_sample", empty_list).alias("mensajes_no_match_sample"), improved
    )
    flows = body(by_flow, "mensajes_no_match", [intents, phrases]).select("flow", flow_value.alias("v"))
    pairs = body(by_intent, "mensajes_no_match_sample", []).select("flow", "intent", intent_value.alias("v"))
    return flows, pairs


def _by_key(left, right):
    return F.when(left["k"] < right["k"], -1).when(left["k"] > right["k"], 1).otherwise(0)
