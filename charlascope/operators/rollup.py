"""Roll-ups of the case report per topic and per topic and intent.

Every result is a table with one row per value, so no group is ever gathered in one place. ``ord`` of the report gives
the row order on which "first seen" rests; it must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charlascope.functions.text import strip
from charlascope.operators.order import number_rows
from charlascope.settings import (
    HOT_ROWS,
    MESSAGES_PER_FLOW,
    MESSAGES_PER_INTENT,
    NO_INTENT,
    SUMMARY_IMPROVEMENTS,
    SUMMARY_INTENTS,
    SUMMARY_PHRASES,
    UNKNOWN_FLOW,
)

BY_FLOW = ("flow",)
BY_INTENT = ("flow", "intent")


def keyed(report: DataFrame) -> DataFrame:
    """The report with its grouping keys: trimmed topic and top intent, with names for the empty ones."""
    named = lambda column, default: F.coalesce(F.nullif(strip(F.col(column)), F.lit("")), F.lit(default))
    return report.withColumns({"flow": named("flow_ref", UNKNOWN_FLOW), "intent": named("intent_top", NO_INTENT)})


def case_counts(report: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return keyed(report).groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"))


def total_cases(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("cases"))


def decision_counts(report: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rows = keyed(report).filter(F.coalesce("decision", F.lit("")) != "")
    return rows.groupBy(*keys, "decision").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def decision_sequence(report: DataFrame, keys: tuple[str, ...], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The decision of every case in row order, with its position in the group."""
    rows = keyed(report).filter(F.coalesce("decision", F.lit("")) != "").select(*keys, "ord", "decision")
    return number_rows(rows, ["ord"], keys=keys, out="pos", start=1, hot_rows=hot_rows)


def intent_counts(report: DataFrame) -> DataFrame:
    rows = keyed(report).filter(strip(F.coalesce("intent_top", F.lit(""))) != "")
    return rows.groupBy("flow", F.col("intent").alias("intent_top")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")
    )


def messages(report: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first distinct trigger messages of each group: 50 per topic, 30 per topic and intent."""
    limit = MESSAGES_PER_FLOW if len(keys) == 1 else MESSAGES_PER_INTENT
    text = strip(F.coalesce("mensaje_no_match", F.lit("")))
    first_seen = (
        keyed(report)
        .select(*keys, text.alias("message"), "ord")
        .filter(F.col("message") != "")
        .groupBy(*keys, "message")
        .agg(F.min("ord").alias("ord"))
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    return first_seen.withColumn("pos", place).filter(F.col("pos") <= limit).select(*keys, "pos", "message")


def improvements(report: DataFrame, keys: tuple[str, ...], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct improvement texts of each group in first-seen order; entries that are not texts are left out."""
    items = _json_items(F.col("improvements"))
    seen = (
        keyed(report)
        .select(*keys, "ord", F.posexplode(items).alias("at", "item"))
        .select(*keys, F.struct("ord", "at").alias("place"), _json_text(F.col("item")).alias("improvement"))
        .filter(F.col("improvement").isNotNull())
        .groupBy(*keys, "improvement")
        .agg(F.min("place").alias("place"))
    )
    return number_rows(seen, ["place"], keys=keys, out="pos", start=1, hot_rows=hot_rows).select(
        *keys, "pos", "improvement"
    )


def new_phrases(report: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct proposed phrases per topic and target intent in first-seen order; a value may be a list or one text."""
    # The text map keeps the order of the keys, the variant map the kind of each value.
    ordered = F.coalesce(
        F.from_json("new_training_phrases", "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    kinds = F.try_variant_get(F.try_parse_json("new_training_phrases"), "$", "map<string,variant>")
    kind = F.schema_of_variant(F.try_element_at("kinds", F.col("intent_key")))
    listed = (
        keyed(report)
        .select("flow", "ord", kinds.alias("kinds"), F.posexplode(ordered).alias("key_at", "intent_key", "value"))
        .withColumn(
            "phrases",
            F.when(kind == "STRING", F.array("value")).when(
                kind.startswith("ARRAY"), F.from_json("value", "array<string>")
            ),
        )
        .select("flow", "ord", "key_at", "intent_key", F.posexplode("phrases").alias("at", "phrase"))
        .filter(F.col("phrase").isNotNull())
        .groupBy("flow", "intent_key", "phrase")
        .agg(F.min(F.struct("ord", "key_at", "at")).alias("place"))
    )
    return number_rows(
        listed, ["place"], keys=["flow", "intent_key"], out="pos", start=1, hot_rows=hot_rows
    )


def summary_lines(report: DataFrame) -> DataFrame:
    """A readable summary as rows ``(section, ord, line)``: the total in a section without a name, topics with their
    cases, decisions (most frequent first), improvements and phrases, then topic and intent pairs with their decisions
    (first seen first)."""
    neg = (-F.col("n")).alias("neg")
    sorted_by = lambda counts, keys, *order: counts.groupBy(*keys).agg(
        # One entry per decision label.
        F.array_sort(F.collect_list(F.struct(*order, "decision"))).alias("d")
    )
    joined = lambda column: F.array_join(
        F.transform(column, lambda d: F.format_string("%s(%d)", d["decision"], -d["neg"])), ", "
    )
    flows = case_counts(report, BY_FLOW)
    heads = flows.select(
        "flow", F.lit(0).alias("part"), F.lit(0).alias("item"), F.concat(F.lit("cases: "), "cases").alias("line")
    )
    decided = sorted_by(decision_counts(report, BY_FLOW), BY_FLOW, neg, "first_ord").select(
        "flow", F.lit(1).alias("part"), F.lit(0).alias("item"), F.concat(F.lit("decisions: "), joined(F.col("d"))).alias("line")
    )
    improved = (
        improvements(report, BY_FLOW)
        .filter(F.col("pos") <= SUMMARY_IMPROVEMENTS)
        .select(
            "flow",
            F.lit(2).alias("part"),
            F.col("pos").cast("int").alias("item"),
            F.concat(F.lit("improvement: "), "improvement").alias("line"),
        )
    )
    proposed = _phrase_lines(report).select(
        "flow",
        F.lit(3).alias("part"),
        F.col("item").cast("int").alias("item"),
        F.concat(F.lit("phrases: "), "line").alias("line"),
    )
    topic_lines = heads.unionByName(decided).unionByName(improved).unionByName(proposed)
    pair_lines = (
        case_counts(report, BY_INTENT)
        .join(sorted_by(decision_counts(report, BY_INTENT), BY_INTENT, "first_ord", neg), list(BY_INTENT), "left")
        .select(
            F.concat_ws("|", "flow", "intent").alias("section"),
            F.lit(1).alias("ord"),
            F.concat(F.lit("cases: "), "cases", F.lit(", decisions: "), F.coalesce(joined(F.col("d")), F.lit(""))).alias("line"),
        )
    )
    place = Window.partitionBy("flow").orderBy("part", "item")
    # At most 2 + 15 + 10 lines per topic.
    placed = topic_lines.select(F.col("flow").alias("section"), F.row_number().over(place).alias("ord"), "line")
    total = total_cases(report).select(
        F.lit("").alias("section"), F.lit(0).alias("ord"), F.concat(F.lit("total cases: "), "cases").alias("line")
    )
    return total.unionByName(placed).unionByName(pair_lines)


def _phrase_lines(report: DataFrame) -> DataFrame:
    phrases = new_phrases(report)
    per_key = phrases.groupBy("flow", "intent_key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    shown_keys = per_key.withColumn(
        "item", F.row_number().over(Window.partitionBy("flow").orderBy("place"))
    ).filter(F.col("item") <= SUMMARY_INTENTS)
    shown = (
        phrases.filter(F.col("pos") <= SUMMARY_PHRASES)
        .groupBy("flow", "intent_key")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "phrase"))).alias("p"))
    )
    dots = F.when(F.col("n") > SUMMARY_PHRASES, "...").otherwise("")
    return shown_keys.join(shown, ["flow", "intent_key"]).select(
        "flow", "item", F.concat("intent_key", F.lit(": "), F.array_join("p.phrase", " / "), dots).alias("line")
    )


def _json_items(text: Column) -> Column:
    """Entries of a JSON list as variants; none for anything else."""
    return F.coalesce(
        F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), F.array().cast("array<variant>")
    )


def _json_text(item: Column) -> Column:
    return F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
