"""Training phrases from CSV files in block layout (intent and language only on the first row of a block)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlascope.functions.flows import training_flow
from charlascope.functions.text import normalize_text
from charlascope.operators.order import forward_fill
from charlascope.sources.csv_scan import scan_csv_in_order

DEFAULT_LANGUAGE = "es"


# ---- Fixed values: which headers hold which column, in lower case ----
HEADERS = {
    "intent": lambda header: "intent" in header and "display" in header,
    "language": lambda header: header == "language",
    "phrase": lambda header: "phrase" in header,
}


def training_header(columns: Sequence[str], given: Mapping[str, str] | None = None) -> dict[str, str]:
    """Columns of the file by the role they play: the caller's own mapping first, then the first header that fits."""
    chosen = {role: name for name, role in (given or {}).items()}
    for role, fits in HEADERS.items():
        free = (c for c in columns if c not in chosen.values() and fits(c.lower().strip()))
        plain = (c for c in ("Intent",) if role == "intent" and c in columns and "intent" not in columns)
        if role not in chosen and (name := next(chain(free, plain), None)):
            chosen[role] = name
    return {name: role for role, name in chosen.items()}


def clean_training(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Training table from block rows with a dense order column, which becomes ``row_id``."""
    rows = rows.withColumnsRenamed(training_header(rows.columns))
    missing = sorted({"intent", "phrase"} - set(rows.columns))
    if missing:
        raise ValueError(f"the training table lacks the columns {missing}")
    if "language" not in rows.columns:
        rows = rows.withColumn("language", F.lit(None).cast("string"))
    filled = forward_fill(rows.select(order, "intent", "language", "phrase"), ["intent"], order)
    phrase = F.coalesce("phrase", F.lit(""))
    return filled.select(
        "intent",
        training_flow(F.col("intent")).alias("flow"),
        F.coalesce("language", F.lit(DEFAULT_LANGUAGE)).alias("language"),
        phrase.alias("phrase"),
        normalize_text(phrase).alias("phrase_norm"),
        F.col(order).cast("bigint").alias("row_id"),
    )


def load_training(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    return clean_training(scan_csv_in_order(spark, path, multiline=multiline))


def preview_training(spark: SparkSession, path: str, columns: Sequence[str] = ("Intent Display Name", "Language")) -> DataFrame:
    """The file as written, with intent and language both filled down."""
    rows = scan_csv_in_order(spark, path)
    return fill_preview(rows, [name for name in columns if name in rows.columns])


def fill_preview(rows: DataFrame, columns: Sequence[str], order: str = "ord") -> DataFrame:
    return forward_fill(rows, columns, order) if columns else rows
