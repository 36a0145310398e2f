"""Quality metrics and a review sample over the case report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from charlascope.operators.rollup import keyed
from charlascope.settings import REVIEW_SAMPLE


def quality_metrics(report: DataFrame) -> DataFrame:
    """Share per decision, cases per topic, suggested intents and the review rate as ``(metric, key, value)``."""
    rows = keyed(report).select("decision", "flow", "intent_top", F.col("review_flag").cast("int").alias("review"))
    # One partial aggregation feeds every metric; its result has one row per label combination.
    cells = rows.groupBy("decision", "flow", "intent_top").agg(
        F.count(F.lit(1)).alias("n"), F.sum("review").alias("reviews")
    )
    total = cells.agg(F.sum("n").alias("total"), F.sum("reviews").alias("reviews"))
    per = lambda metric, key: cells.groupBy(F.col(key).alias("key")).agg(
        F.lit(metric).alias("metric"), F.sum("n").alias("n")
    )
    shares = per("decision_share", "decision").withColumn(
        "value", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("metric")), 6)
    )
    counts = per("flow_cases", "flow").unionByName(per("intent_suggested", "intent_top").filter(F.col("key") != ""))
    return (
        shares.select("metric", "key", "value")
        .unionByName(counts.select("metric", "key", F.col("n").cast("double").alias("value")))
        .unionByName(
            total.filter(F.col("total") > 0).select(
                F.lit("review_rate").alias("metric"),
                F.lit("").alias("key"),
                F.round(F.col("reviews") / F.col("total"), 6).alias("value"),
            )
        )
    )


def review_sample(report: DataFrame, size: int = REVIEW_SAMPLE, per_decision: bool = False) -> DataFrame:
    """A repeatable sample for manual review: the cases whose hashed id sorts first, overall or per decision."""
    hashed = report.withColumn("_h", F.md5("case_id"))
    if not per_decision:
        return hashed.orderBy("_h", "case_id").limit(size).drop("_h")
    place = F.row_number().over(Window.partitionBy("decision").orderBy("_h", "case_id"))
    return hashed.withColumn("_p", place).filter(F.col("_p") <= size).drop("_h", "_p")
