"""Consistency rules between retrieval, slots and a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlascope.functions.numbers import round_half_even
from charlascope.functions.text import contains_any, strip, word_count_at_most
from charlascope.operators.judge import flow_known, max_evidence_sim, strong_in_flow
from charlascope.settings import OFF_DOMAIN_WORDS, STRONG_MATCH, WEAK_MATCH

# ---- Fixed values: confidence ceilings of the rules ----
STRONG_CONTRADICTION = 0.6
SLOT_CONTRADICTION = 0.65
OUT_OF_SCOPE_CONFIDENCE = 0.85


def post_validate(
    rows: DataFrame,
    strong: float = STRONG_MATCH,
    weak: float = WEAK_MATCH,
    oos_confidence: bool = False,
) -> DataFrame:
    """Correct ``decision``, ``confidence`` and ``review_flag`` of rows whose ``judged`` is ``yes`` or ``rules``.

    A new-intent decision despite a strong match in the active topic, and a short slot value not decided as a missing
    parameter, lower the confidence and ask for review. Confidences are rounded to two decimals by their binary value. A text with an off-domain word and no evidence becomes
    OUT_OF_SCOPE and needs no review; its confidence is raised only with ``oos_confidence``.
    """
    decision = strip(F.coalesce("decision", F.lit("")))
    text = F.coalesce("trigger_user_text", F.lit(""))
    overlooked = (
        flow_known(F.col("flow_ref"))
        & strong_in_flow(F.col("candidates"), F.col("flow_ref"), strong)
        & decision.contains("NEW_INTENT")
    )
    slot_ignored = (
        (F.size("slot_signals") > 0)
        & word_count_at_most(text, 4)
        & ~decision.contains("MISSING_PARAMETER_HANDLER")
    )
    off_domain = (
        (max_evidence_sim(F.col("candidates")) < weak)
        & (decision != "OUT_OF_SCOPE")
        & contains_any(F.lower(text), OFF_DOMAIN_WORDS)
    )
    ceiling = F.least(
        F.when(overlooked, STRONG_CONTRADICTION).otherwise(F.col("confidence")),
        F.when(slot_ignored, SLOT_CONTRADICTION).otherwise(F.col("confidence")),
        F.col("confidence"),
    )
    confidence = round_half_even(F.when(off_domain & F.lit(oos_confidence), OUT_OF_SCOPE_CONFIDENCE).otherwise(ceiling))
    open_to_rules = F.col("judged").isin("yes", "rules")
    return rows.withColumns(
        {
            "decision": F.when(open_to_rules & off_domain, "OUT_OF_SCOPE").otherwise(F.col("decision")),
            "confidence": F.when(open_to_rules, confidence).otherwise(F.col("confidence")),
            "review_flag": F.when(open_to_rules, (overlooked | slot_ignored) & ~off_domain).otherwise(
                F.col("review_flag")
            ),
        }
    )
