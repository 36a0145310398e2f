"""Inputs derived from the driver tables: chats, training phrases, judge responses and long sessions.

The driver tables hold no intents, so labels are computed from the rows. The expressions are plain SQL shared with the
oracle; every derivation covers its whole table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlascope.functions.flows import training_flow
from charlascope.functions.text import normalize_text
from charlascope.operators.order import number_rows
from charlascope.operators.turns import number_turns
from charlascope.session import spread

_KIND = "(conv_id*7 + turn*3 + length(text)) % 8"
_LANGUAGE = "case {} % 4 when 0 then 'en' when 1 then 'es' when 2 then 'de' else 'fr' end"

# Chats from conversations.
CHATS = {
    "session_id": "concat('c', cast(conv_id as string))",
    "turn_index": "cast(turn as int)",
    "ord": "conv_id * 1000000 + turn",
    "tipo": "case role when 'user' then 'usuario' when 'assistant' then 'bot' else 'sistema' end",
    "texto": "text",
    "intent_detectado": (
        f"case when role <> 'assistant' then '' when {_KIND} < 3 then 'NO_MATCH-sys.no-match-1'"
        f" when {_KIND} = 3 then 'CHIT_hola' when {_KIND} = 4 then 'SALUDO_inicio'"
        f" else concat({_LANGUAGE.format(f'(conv_id + case when {_KIND} = 7 then 1 else 0 end)')},"
        " '_src', cast(length(text) % 20 as string)) end"
    ),
}
# Training phrases: each document is one phrase, and so is each line of a user turn.
DOCUMENT_PHRASES = {
    "row_id": "doc_id",
    "intent": "concat(lang, '_', source)",
    "language": "lang",
    "phrase": "text",
}
USER_PHRASES = {
    "row_id": "1000000000000 + conv_id * 10000000000 + turn * 10000 + line_no",
    "intent": f"concat({_LANGUAGE.format('conv_id')}, '_src', cast(length(text) % 20 as string))",
    "language": _LANGUAGE.format("conv_id"),
    "phrase": "line",
}
# Short and long triggers with slots and off-domain words, and a best similarity, from error events.
TRIGGERS = {
    "case_id": "concat('u', cast(user_id as string), ':', cast(event_id as string))",
    "ord": "event_id",
    "texto": (
        "case event_id % 10 when 0 then 'en Abril' when 1 then 'pago en USD' when 2 then 'la tarjeta ADICIONAL'"
        " when 3 then 'es para mi hija menor' when 4 then '¿hasta cuánto puedo?' when 5 then 'una receta de torta'"
        " when 6 then 'saldo en dólares de este mes' when 7 then 'quiero hablar con una persona ahora mismo'"
        " when 8 then '' else 'cómo está el clima hoy en la ciudad' end"
    ),
    "flow_ref": "case event_id % 3 when 0 then 'Compras' when 1 then 'UNKNOWN' else 'Altas' end",
    "best_flow": "case event_id % 2 when 0 then 'Compras' else 'Altas' end",
    "best_sim": "cast((event_id % 100) / 100.0 as double)",
}
# Judge responses for the triggers: fenced, wrapped in text, without or with null confidence, no object, broken and
# then repaired. Kind 6 never answers.
RESPONSES = {
    "case_id": TRIGGERS["case_id"],
    "attempt": "1",
    "response": (
        "case event_id % 8"
        " when 0 then concat(repeat(chr(96), 3), 'json', chr(10),"
        " '{\"decision\":\"NEW_INTENT_IN_FLOW\",\"flow_recommended\":\"Altas\",\"intent_recommended\":[\"Altas_nueva\"],"
        "\"improvements\":[\"add phrases ', cast(event_id % 5 as string), '\"],\"new_training_phrases\":{\"Altas_nueva\":"
        "[\"frase ', cast(event_id % 3 as string), '\",\"frase fija\"],\"Altas_otra\":\"suelta\"},\"confidence\":0.',"
        " cast(1 + event_id % 9 as string), '}', chr(10), repeat(chr(96), 3))"
        " when 1 then concat('Respuesta: {\"decision\":\"MISSING_PARAMETER_HANDLER\",\"intent_recommended\":[\"Compras_k1\"],"
        "\"confidence\":0.', cast(1 + event_id % 9 as string), '} fin')"
        " when 2 then '{\"decision\":\"FLOW_SWITCH\",\"intent_recommended\":[]}'"
        " when 3 then '{\"decision\":\"AMBIGUOUS\",\"confidence\":null}'"
        " when 4 then 'sin objeto'"
        " when 5 then '{\"decision\": \"NEW_INTENT_IN_FLOW\", '"
        " when 7 then '{\"decision\":\"MISSED_EXISTING_INTENT_IN_FLOW\",\"intent_recommended\":[\"Compras_k2\"],"
        "\"improvements\":[\"add phrases 0\",{\"intent\":\"x\"}],\"confidence\":0.9}' end"
    ),
}
SECOND_RESPONSES = {
    "case_id": TRIGGERS["case_id"],
    "attempt": "2",
    "response": "case event_id % 8 when 5 then '{\"decision\":\"NEW_INTENT_IN_FLOW\",\"confidence\":0.7}' end",
}
# Long sessions from events: errors play the no-match, views the user.
LONG_CHATS = {
    "session_id": "concat('u', cast(user_id as string))",
    "tipo": "case event_type when 'view' then 'usuario' else 'bot' end",
    "texto": "concat(event_type, ' ', props)",
    "intent_detectado": (
        "case event_type when 'view' then '' when 'error' then 'NO_MATCH-sys.no-match-1' when 'click' then 'CHIT_click'"
        " when 'purchase' then concat('Compras_k', cast(event_id % 3 as string)) else 'Altas' end"
    ),
}
ERRORS = "event_type = 'error'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(frame: DataFrame, expressions: dict[str, str], *keep: str) -> DataFrame:
    return frame.selectExpr(*keep, *[f"{sql} as {name}" for name, sql in expressions.items()])


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "conversations"), CHATS)


def long_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of up to a hundred turns, numbered by time."""
    rows = derive(table(spark, sf_dir, "events"), LONG_CHATS, "ts", "event_id")
    return number_turns(rows, ["ts", "event_id"]).withColumn("ord", F.col("event_id")).drop("ts", "event_id")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table of the retrieval queries."""
    documents = derive(spread(table(spark, sf_dir, "documents")), DOCUMENT_PHRASES)
    user_turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    lines = user_turns.select("conv_id", "turn", "text", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    phrases = documents.unionByName(derive(lines.filter("trim(line) <> ''"), USER_PHRASES))
    return phrases.withColumns(
        {"flow": training_flow(F.col("intent")), "phrase_norm": normalize_text(F.col("phrase"))}
    )


def block_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows in block layout: intent and language only on the first row of each (lang, source) block."""
    documents = table(spark, sf_dir, "documents")
    firsts = documents.groupBy("lang", "source").agg(F.min("doc_id").alias("first_id"))
    ordered = number_rows(documents, ["lang", "source", "doc_id"], out="ord", start=1)
    leads = F.col("doc_id") == F.col("first_id")
    return ordered.join(firsts, ["lang", "source"]).select(
        "ord",
        "doc_id",
        F.when(leads, F.concat_ws("_", "lang", "source")).alias("intent"),
        F.when(leads, F.col("lang")).alias("language"),
        F.col("text").alias("phrase"),
    )


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with one candidate each, ready for slots, rules and judgement."""
    rows = derive(table(spark, sf_dir, "events").filter(ERRORS), TRIGGERS)
    candidate = F.struct(
        F.concat("best_flow", F.lit("_k1")).alias("intent"),
        F.col("best_flow").alias("flow"),
        F.col("best_sim").alias("score"),
        F.array(
            F.struct(
                F.col("best_flow").alias("phrase"), F.col("best_sim").alias("sim"), F.lit(0).cast("bigint").alias("row_id")
            )
        ).alias("evidence"),
    )
    return rows.select(
        "case_id",
        "ord",
        F.split_part("case_id", F.lit(":"), F.lit(1)).alias("session_id"),
        F.lit("").alias("fecha"),
        F.lit("no entendi").alias("bot_no_match_text"),
        F.col("texto").alias("trigger_user_text"),
        normalize_text(F.col("texto")).alias("trigger_user_text_norm"),
        "flow_ref",
        F.lit("").alias("last_valid_intent"),
        F.array(candidate).alias("candidates"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").filter(ERRORS)
    both = derive(errors, RESPONSES).unionByName(derive(errors, SECOND_RESPONSES))
    return both.filter(F.col("response").isNotNull())
