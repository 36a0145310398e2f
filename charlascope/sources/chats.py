"""Chat tables from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlascope.operators.order import forward_fill
from charlascope.operators.turns import build_turns, number_turns
from charlascope.settings import LEGACY_CHAT_COLUMNS
from charlascope.sources.csv_scan import scan_csv, scan_csv_in_order

REQUIRED = ("session_id", "tipo", "texto", "intent_detectado")


def clean_chats(rows: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Standard names, filled session ids and defaults; returns accepted and rejected rows.

    Rows before the first session id belong to no session and are the rejected ones.
    """
    rows = rows.withColumnsRenamed(LEGACY_CHAT_COLUMNS)
    missing = sorted(set(REQUIRED) - set(rows.columns))
    if missing:
        raise ValueError(f"the chat table lacks the columns {missing}")
    if "fecha" not in rows.columns:
        rows = rows.withColumn("fecha", F.lit(""))
    filled = forward_fill(rows, ["session_id"], order).withColumns(
        {
            "intent_detectado": F.coalesce("intent_detectado", F.lit("")),
            "tipo": F.lower("tipo"),
            "texto": F.coalesce("texto", F.lit("")),
        }
    )
    return filled.filter(F.col("session_id").isNotNull()), filled.filter(F.col("session_id").isNull())


def load_chats(spark: SparkSession, path: str, multiline: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected chat rows of a CSV file or folder, with their file order in ``ord``."""
    return clean_chats(scan_csv_in_order(spark, path, multiline=multiline))


def load_turns(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """The turn table of a CSV file or folder."""
    accepted, _ = load_chats(spark, path, multiline)
    return build_turns(number_turns(accepted, ["ord"]))


def preview_chats(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A chat file as written, or its first rows if the caller asks for so many."""
    scan = scan_csv(spark, path)
    return scan if rows is None else scan.limit(rows)
