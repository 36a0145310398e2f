"""Turn table: a chat table plus its derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlascope.functions.flows import flow_from_intent, is_no_match
from charlascope.functions.text import normalize_text
from charlascope.operators.order import number_rows
from charlascope.settings import HOT_ROWS


def number_turns(chats: DataFrame, order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``turn_index``, the zero-based position of a row in its session."""
    numbered = number_rows(chats, order, keys=["session_id"], out="turn_index", hot_rows=hot_rows)
    return numbered.withColumn("turn_index", F.col("turn_index").cast("int"))


def build_turns(chats: DataFrame) -> DataFrame:
    """Add the normalized texts, the no-match flag and the topic of the detected intent."""
    intent = F.coalesce("intent_detectado", F.lit(""))
    return chats.withColumns(
        {
            "texto_norm": normalize_text(F.col("texto")),
            "intent_detectado": intent,
            "intent_norm": normalize_text(intent),
            "is_no_match": is_no_match(intent),
            "flow_from_intent": flow_from_intent(intent),
        }
    )
