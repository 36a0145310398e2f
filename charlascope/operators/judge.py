"""Prompts for an outside judge, its responses as a table, and rule-based decisions without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlascope.functions.text import contains_any, slot_signals, strip, word_count_at_most
from charlascope.settings import DECISIONS, OFF_DOMAIN_WORDS, STRONG_MATCH, UNKNOWN_FLOW, WEAK_MATCH

DEFAULT_CONFIDENCE = 0.5
NO_PLAN = '{"parameters":[],"contexts":[]}'
WHY_NO_JUDGE = "sin respuesta de juez"
WHY_BAD_RESPONSE = "respuesta de juez no utilizable"
RESULT_COLUMNS = (
    "decision", "flow_recommended", "intent_top", "intents_relevantes", "why", "improvements",
    "new_training_phrases", "suggested_dialogflow", "confidence",
)

_INSTRUCTIONS = (
    "Analizá un turno que el bot no pudo resolver y devolvé un único objeto JSON, sin texto alrededor.\n"
    f"Valores posibles de decision: {', '.join(DECISIONS)}.\n"
    "Criterios: un dato suelto dentro de un tema activo es MISSING_PARAMETER_HANDLER; una frase existente casi igual "
    "es MISSED_EXISTING_INTENT_IN_FLOW; un pedido del tema sin intent propio es NEW_INTENT_IN_FLOW; un pedido ajeno al "
    "negocio es OUT_OF_SCOPE.\n"
    'Claves: {"decision": "", "flow_recommended": "", "intent_recommended": [], "intents_relevantes": [], "why": "", '
    '"improvements": [], "new_training_phrases": {}, "suggested_dialogflow": {"parameters": [], "contexts": []}, '
    '"confidence": 0.0}\n\nINPUT:\n'
)


def case_payload() -> Column:
    """The judge's input: twelve fields of a case, in fixed order."""
    message = lambda m: F.struct(m["tipo"].alias("tipo"), m["texto"].alias("texto"), m["intent"].alias("intent"))
    return F.struct(
        "case_id",
        "session_id",
        "fecha",
        "flow_ref",
        "last_valid_intent",
        F.transform("context", message).alias("context_messages"),
        "trigger_user_text",
        "trigger_user_text_norm",
        "slot_signals",
        public_candidates(F.col("candidates")).alias("candidates"),
        F.col("trigger_user_text").alias("mensaje_no_match"),
        "bot_no_match_text",
    )


def public_candidates(candidates: Column) -> Column:
    """Candidates without the row ids kept for ordering."""
    return F.transform(
        candidates,
        lambda c: c.withField(
            "evidence",
            F.transform(c["evidence"], lambda e: F.struct(e["phrase"].alias("phrase"), e["sim"].alias("sim"))),
        ),
    )


def judge_prompts(cases: DataFrame) -> DataFrame:
    """``case_id`` and the prompt: instructions, then the payload as JSON after ``INPUT:``."""
    payload = F.to_json(case_payload(), {"ignoreNullFields": "false"})
    return cases.select("case_id", F.concat(F.lit(_INSTRUCTIONS), payload).alias("prompt"))


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace; empty when there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def valid_object(text: Column) -> Column:
    """The JSON object inside a text, or null when what stands between the outer braces is not exactly one object."""
    found = json_object(text)
    listed = F.try_parse_json(F.concat(F.lit("["), found, F.lit("]")))
    # The parser stops at the end of the first value, so a text that closes and reopens the list is checked once more.
    reopened = found.rlike(r"(?s)\].*\[")
    nested = F.try_parse_json(F.concat(F.lit('{"x":'), found, F.lit("}")))
    single = (
        F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    )
    return F.when((found != "") & F.coalesce(single, F.lit(False)) & (~reopened | nested.isNotNull()), found)


def parse_responses(responses: DataFrame) -> DataFrame:
    """One row per case of ``responses(case_id, attempt, response)``, from the earliest attempt that is valid JSON.

    ``usable`` is false when no attempt parses, the decision is not a text, or the confidence is given but not a
    number. A missing confidence counts as 0.5. ``known_decision`` checks the decision against the six labels.
    """
    checked = responses.select("case_id", "attempt", valid_object(F.col("response")).alias("object"))
    first = checked.groupBy("case_id").agg(
        F.min_by("object", F.when(F.col("object").isNotNull(), F.col("attempt"))).alias("object")
    )
    doc = first.withColumn("doc", F.try_parse_json("object"))
    part = lambda path: F.try_variant_get("doc", path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(part(path)), F.lit("VOID"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get("doc", path, "string"))
    as_json = lambda path, default: F.when(part(path).isNull(), F.lit(default)).otherwise(F.to_json(part(path)))
    confidence = F.when(part("$.confidence").isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(
        F.try_variant_get("doc", "$.confidence", "double")
    )
    fields = doc.select(
        "case_id",
        F.coalesce(text("$.decision"), F.lit("")).alias("decision"),
        kind("$.decision").isin("STRING", "VOID").alias("_decision_ok"),
        F.coalesce(text("$.flow_recommended"), F.lit("")).alias("flow_recommended"),
        F.coalesce(text("$.intent_recommended[0]"), text("$.intent_recommended"), F.lit("")).alias("intent_top"),
        as_json("$.intents_relevantes", "[]").alias("intents_relevantes"),
        F.coalesce(text("$.why"), F.lit("")).alias("why"),
        as_json("$.improvements", "[]").alias("improvements"),
        as_json("$.new_training_phrases", "{}").alias("new_training_phrases"),
        as_json("$.suggested_dialogflow", "{}").alias("suggested_dialogflow"),
        confidence.alias("confidence"),
        F.col("object").isNotNull().alias("_parsed"),
    )
    return fields.select(
        "case_id",
        *RESULT_COLUMNS,
        F.coalesce(F.col("_parsed") & F.col("_decision_ok") & F.col("confidence").isNotNull(), F.lit(False)).alias(
            "usable"
        ),
        strip(F.col("decision")).isin(*DECISIONS).alias("known_decision"),
    )


def with_judgement(cases: DataFrame, responses: DataFrame | None) -> DataFrame:
    """Add the judge's result, the default for cases nobody judged, or the error row for unusable responses.

    ``judged`` tells the three apart: ``yes``, ``no``, ``error``. Needs ``flow_ref`` and ``candidates``.
    """
    own_candidates = F.to_json(public_candidates(F.col("candidates")), {"ignoreNullFields": "false"})
    top = F.coalesce(F.try_element_at("candidates", F.lit(1))["intent"], F.lit(""))
    if responses is None:
        joined = cases.withColumn("judged", F.lit("no"))
        given = {name: F.lit(None) for name in RESULT_COLUMNS}
    else:
        results = parse_responses(responses).drop("known_decision")
        renamed = results.withColumnsRenamed({name: f"_{name}" for name in RESULT_COLUMNS})
        joined = cases.join(renamed, "case_id", "left").withColumn(
            "judged", F.when(F.col("usable").isNull(), "no").when(F.col("usable"), "yes").otherwise("error")
        )
        given = {name: F.col(f"_{name}") for name in RESULT_COLUMNS}
    yes, error = F.col("judged") == "yes", F.col("judged") == "error"
    pick = lambda name, otherwise: F.when(yes, given[name]).otherwise(otherwise)
    filled = joined.withColumns(
        {
            "decision": pick("decision", F.lit("AMBIGUOUS")),
            "flow_recommended": pick("flow_recommended", F.col("flow_ref")),
            "intent_top": pick("intent_top", F.when(error, "").otherwise(top)),
            "intents_relevantes": pick("intents_relevantes", own_candidates),
            "why": pick("why", F.when(error, WHY_BAD_RESPONSE).otherwise(WHY_NO_JUDGE)),
            "improvements": pick("improvements", F.lit("[]")),
            "new_training_phrases": pick("new_training_phrases", F.lit("{}")),
            "suggested_dialogflow": pick("suggested_dialogflow", F.lit(NO_PLAN)),
            "confidence": pick("confidence", F.when(error, 0.0).otherwise(DEFAULT_CONFIDENCE)),
            "review_flag": ~yes,
        }
    )
    return filled.drop("usable", *[f"_{name}" for name in RESULT_COLUMNS])


def add_slot_signals(cases: DataFrame) -> DataFrame:
    return cases.withColumn("slot_signals", slot_signals(F.col("trigger_user_text_norm")))


def flow_known(flow_ref: Column) -> Column:
    return (flow_ref != "") & ~flow_ref.isin(UNKNOWN_FLOW, "CHIT")


def max_evidence_sim(candidates: Column) -> Column:
    """Best similarity among all evidence of a case; 0 without any."""
    sims = F.flatten(F.transform(candidates, lambda c: F.transform(c["evidence"], lambda e: e["sim"])))
    return F.coalesce(F.greatest(F.array_max(sims), F.lit(0.0)), F.lit(0.0))


def strong_in_flow(candidates: Column, flow_ref: Column, strong: float = STRONG_MATCH) -> Column:
    """Whether a candidate of the active topic has evidence at or above the strong-match threshold."""
    return F.exists(
        candidates, lambda c: (c["flow"] == flow_ref) & F.exists(c["evidence"], lambda e: e["sim"] >= strong)
    )


def missing_parameter(flow_ref: Column, slots: Column, text: Column) -> Column:
    """Preliminary flag: a slot value inside a known topic, given as a short message or an amount question."""
    return (
        flow_known(flow_ref)
        & (F.size(slots) > 0)
        & (word_count_at_most(text, 4) | F.array_contains(slots, "AMOUNT_QUERY"))
    )


def rule_decision(flow_ref: Column, slots: Column, text: Column, candidates: Column) -> Column:
    """A decision from slots and similarities alone; the first rule that holds wins."""
    best = max_evidence_sim(candidates)
    return (
        F.when(missing_parameter(flow_ref, slots, text), "MISSING_PARAMETER_HANDLER")
        .when(flow_known(flow_ref) & strong_in_flow(candidates, flow_ref), "MISSED_EXISTING_INTENT_IN_FLOW")
        .when(best >= STRONG_MATCH, "FLOW_SWITCH")
        .when((best < WEAK_MATCH) & contains_any(F.lower(text), OFF_DOMAIN_WORDS), "OUT_OF_SCOPE")
        .when(flow_known(flow_ref), "NEW_INTENT_IN_FLOW")
        .otherwise("AMBIGUOUS")
    )


def with_rule_decision(cases: DataFrame) -> DataFrame:
    """Default rows whose decision comes from the rules; they are then open to validation like judged rows."""
    decided = rule_decision(
        F.col("flow_ref"), F.col("slot_signals"), F.col("trigger_user_text"), F.col("candidates")
    )
    return with_judgement(cases, None).withColumns({"decision": decided, "judged": F.lit("rules")})
