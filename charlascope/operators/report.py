"""The flat case report: eighteen columns, nested parts as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlascope.settings import REPORT_COLUMNS

REPORT_SCHEMA = ", ".join(
    f"{name} {'double' if name == 'confidence' else 'boolean' if name == 'review_flag' else 'string'}"
    for name in REPORT_COLUMNS
)


def with_training_phrases(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Give each candidate the whole phrase list of its intent, at every size of the training table.

    A list is repeated in every case that names its intent; ``intent_phrases`` gives the lists once, keyed by intent.
    """
    lists = (
        phrases.groupBy("intent")
        .agg(F.array_sort(F.collect_list(F.struct("row_id", "phrase"))).alias("l"))
        .select("intent", F.col("l.phrase").alias("training_phrases"))
    )
    parts = candidates.select("text_id", "flow_ref", F.posexplode("candidates").alias("at", "c"))
    return (
        parts.join(lists, F.col("c.intent") == lists["intent"])
        .withColumn("c", F.col("c").withField("training_phrases", F.col("training_phrases")))
        .groupBy("text_id", "flow_ref")
        .agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("l"))
        .select("text_id", "flow_ref", F.col("l.c").alias("candidates"))
    )


def case_report(rows: DataFrame) -> DataFrame:
    """The report columns in their fixed order, then ``ord`` for roll-ups that depend on row order."""
    best = F.slice(F.coalesce(F.try_element_at("candidates", F.lit(1))["evidence"], F.array()), 1, 3)
    pairs = F.transform(best, lambda e: F.array(e["phrase"].cast("variant"), e["sim"].cast("variant")))
    out = rows.withColumns(
        {
            "mensaje_no_match": F.col("trigger_user_text"),
            "top_evidence": F.to_json(pairs),
            "slot_signals": F.to_json("slot_signals"),
        }
    )
    return out.select(*REPORT_COLUMNS, "ord")
