"""Registered queries: each runs one operator of the library over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlascope.operators import judge, metrics, retrieve, rollup, tfidf, vectors
from charlascope.operators.cases import no_match_cases
from charlascope.operators.order import number_rows
from charlascope.operators.report import case_report
from charlascope.operators.turns import build_turns, number_turns
from charlascope.operators.validate import post_validate
from charlascope.functions.numbers import round_half_even
from charlascope.functions.text import normalize_text
from charlascope.plans import fixtures, round_trips
from charlascope.plans.pipeline import analyze, case_features
from charlascope.session import cut_lineage
from charlascope.sources.training import clean_training, fill_preview

Query = Callable[[SparkSession, str], DataFrame]
MIN_SIM = 0.2


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = build_turns(number_turns(fixtures.chats(spark, sf_dir).drop("turn_index"), ["ord"]))
    return turns.select(
        "session_id",
        "turn_index",
        "tipo",
        "intent_detectado",
        "intent_norm",
        "is_no_match",
        "flow_from_intent",
        F.length("texto").cast("bigint").alias("n_chars"),
        F.length("texto_norm").cast("bigint").alias("n_norm"),
    )


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.chats(spark, sf_dir).select(
        "session_id", "turn_index", normalize_text(F.col("texto")).alias("texto_norm")
    )


def training_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_training(fixtures.block_training(spark, sf_dir))
    return rows.select("row_id", "intent", "flow", "language", F.length("phrase").cast("bigint").alias("n_chars"))


def intent_preview_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_preview(fixtures.block_training(spark, sf_dir), ["intent", "language"])
    return rows.select(F.col("ord").alias("row_id"), "intent", "language")


def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fixtures.table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return number_rows(documents, ["lang", "source", "doc_id"]).select("doc_id", "row_id")


def all_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the short and the long sessions."""
    short, long = fixtures.chats(spark, sf_dir), fixtures.long_chats(spark, sf_dir)
    return no_match_cases(short.unionByName(long))


def cases_with_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_cases(spark, sf_dir).select(
        "case_id",
        "session_id",
        "turn_index",
        F.coalesce("trigger_turn_index", F.lit(-1)).alias("trigger_turn_index"),
        "trigger_user_text",
        "trigger_user_text_norm",
        "bot_no_match_text",
    )


def flow_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_cases(spark, sf_dir).select("case_id", "flow_ref", "last_valid_intent")


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(no_match_cases(fixtures.long_chats(spark, sf_dir)))


def context_window_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same window with turns without a topic not counted as a change."""
    return _context(no_match_cases(fixtures.long_chats(spark, sf_dir), ignore_empty_flow=True))


def _context(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.posexplode("context").alias("pos", "m")).select(
        "case_id", "pos", "m.turn_index", "m.tipo", "m.texto", "m.intent"
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = judge.add_slot_signals(fixtures.triggers(spark, sf_dir))
    return cases.select("case_id", F.array_join("slot_signals", ",").alias("slots"))


def chat_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = judge.add_slot_signals(no_match_cases(fixtures.chats(spark, sf_dir)))
    return cases.select("case_id", F.array_join("slot_signals", ",").alias("slots"))


def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tfidf.build_training_index(fixtures.training(spark, sf_dir))
    return index.vocabulary.select("term", "total", "df", F.round("idf", 6).alias("idf"))


def phrase_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tfidf.build_training_index(fixtures.training(spark, sf_dir))
    cases = cut_lineage(no_match_cases(fixtures.chats(spark, sf_dir)))
    texts = retrieve.distinct_texts(cases, "trigger_user_text_norm")
    keyed = cases.select(F.col("case_id").alias("name"), tfidf.text_digest(F.col("trigger_user_text_norm")).alias("text_id"))
    pairs = retrieve.similar_phrases(texts, index, MIN_SIM, keyed)
    return pairs.select(F.col("name").alias("case_id"), "row_id", F.round("sim", 4).alias("sim"))


def _features(spark: SparkSession, sf_dir: str, phrases: bool = True) -> DataFrame:
    index = tfidf.build_training_index(fixtures.training(spark, sf_dir))
    return case_features(fixtures.chats(spark, sf_dir), index, phrase_lists=False, phrases=phrases)


def candidate_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, phrases=False).select("case_id", F.posexplode("candidates").alias("pos", "c")).select(
        "case_id", (F.col("pos") + 1).alias("rank"), "c.intent", "c.flow", "c.score"
    )


def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _features(spark, sf_dir, phrases=False).select("case_id", F.explode("candidates").alias("c"))
    return ranked.select("case_id", "c.intent", F.posexplode("c.evidence").alias("pos", "e")).select(
        "case_id", "intent", (F.col("pos") + 1).alias("rank"), "e.row_id", F.round("e.sim", 4).alias("sim")
    )


def intent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieve.intent_phrases(fixtures.training(spark, sf_dir))
    return rows.select("intent", "hits", "pos", "row_id", F.md5("phrase").alias("phrase_md5"))


def judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt's payload read back from its text."""
    prompts = judge.judge_prompts(_features(spark, sf_dir))
    shape = (
        "case_id string, flow_ref string, last_valid_intent string, context_messages array<struct<texto:string>>,"
        " trigger_user_text string, slot_signals array<string>, candidates array<struct<intent:string, score:double>>"
    )
    payload = F.from_json(F.substring_index("prompt", "\nINPUT:\n", -1), shape)
    return prompts.select("case_id", payload.alias("p")).select(
        "case_id",
        F.col("p.case_id").alias("payload_case_id"),
        F.col("p.flow_ref").alias("flow_ref"),
        F.col("p.last_valid_intent").alias("last_valid_intent"),
        F.col("p.trigger_user_text").alias("trigger_user_text"),
        F.size("p.context_messages").cast("bigint").alias("n_context"),
        F.size("p.candidates").cast("bigint").alias("n_candidates"),
        F.coalesce(F.try_element_at("p.candidates", F.lit(1))["intent"], F.lit("")).alias("top_intent"),
    )


def judge_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge.parse_responses(fixtures.responses(spark, sf_dir))
    return rows.select(
        "case_id",
        "decision",
        "flow_recommended",
        "intent_top",
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"),
        "usable",
        "known_decision",
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = judge.add_slot_signals(fixtures.triggers(spark, sf_dir))
    return judge.with_judgement(cases, fixtures.responses(spark, sf_dir))


def judge_join_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select(
        "case_id", "judged", "decision", "flow_recommended", "intent_top", "confidence", "review_flag"
    )


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_validate(_judged(spark, sf_dir)).select("case_id", "decision", "confidence", "review_flag")


def missing_parameter_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = judge.add_slot_signals(fixtures.triggers(spark, sf_dir))
    flag = judge.missing_parameter(F.col("flow_ref"), F.col("slot_signals"), F.col("trigger_user_text"))
    return cases.select("case_id", flag.alias("flag"))


def rule_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = post_validate(judge.with_rule_decision(judge.add_slot_signals(fixtures.triggers(spark, sf_dir))))
    return rows.select("case_id", "decision", "confidence", "review_flag")


def _flat(report: DataFrame) -> DataFrame:
    pairs = F.try_parse_json("top_evidence")
    return report.select(
        "case_id",
        "session_id",
        "mensaje_no_match",
        "bot_no_match_text",
        "flow_ref",
        "last_valid_intent",
        "decision",
        "flow_recommended",
        "intent_top",
        F.coalesce(F.json_array_length("intents_relevantes"), F.lit(0)).cast("bigint").alias("n_intents"),
        F.round(F.coalesce(F.try_variant_get(pairs, "$[0][1]", "double"), F.lit(-1.0)), 4).alias("best_sim"),
        "slot_signals",
        "improvements",
        "new_training_phrases",
        "confidence",
        "review_flag",
    )


def confidence_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event value, cut to eighths so that many lie at or near half a hundredth, as confidences are rounded."""
    events = fixtures.table(spark, sf_dir, "events")
    return events.select("event_id", round_half_even(F.col("value") / 8.0).alias("confidence"))


def case_report_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tfidf.build_training_index(fixtures.training(spark, sf_dir))
    return _flat(analyze(fixtures.chats(spark, sf_dir), index, phrase_lists=False))


def case_report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tfidf.build_training_index(fixtures.training(spark, sf_dir))
    return _flat(analyze(fixtures.chats(spark, sf_dir), index, rules=True, phrase_lists=False))


def judged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_report(post_validate(_judged(spark, sf_dir)))


def _on_report(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(judged_report(spark, sf_dir))


def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label scores of every embedding over its nearest embeddings, itself included."""
    corpus = fixtures.table(spark, sf_dir, "embeddings")
    asked = corpus.select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.vector_intents(vectors.nearest_vectors(asked, corpus))


def registered() -> dict[str, Query]:
    by_flow, by_intent = rollup.BY_FLOW, rollup.BY_INTENT
    return {
        "chat_turns": chat_turns,
        "normalize_text": normalized_texts,
        "training_ffill": training_ffill,
        "intent_preview_ffill": intent_preview_ffill,
        "row_ids": row_ids,
        "no_match_cases": cases_with_trigger,
        "flow_reference": flow_reference,
        "context_window": context_window,
        "context_window_topics": context_window_topics,
        "slot_signals": slots,
        "chat_slot_signals": chat_slots,
        "tfidf_vocab": tfidf_vocab,
        "phrase_similarity": phrase_similarity,
        "candidate_intents": candidate_intents,
        "candidate_evidence": candidate_evidence,
        "intent_phrases": intent_phrases,
        "vector_candidates": vector_candidates,
        "judge_prompt": judge_prompt,
        "judge_response_parse": judge_response_parse,
        "judge_join_defaults": judge_join_defaults,
        "post_validate": validated,
        "confidence_rounding": confidence_rounding,
        "missing_parameter_flag": missing_parameter_flag,
        "rule_decision": rule_decision,
        "case_report": case_report_open,
        "case_report_rules": case_report_rules,
        "case_report_judged": _on_report(_flat),
        "rollup_total": _on_report(rollup.total_cases),
        "rollup_by_flow": _on_report(lambda r: rollup.case_counts(r, by_flow).orderBy("flow")),
        "rollup_by_intent": _on_report(lambda r: rollup.case_counts(r, by_intent).orderBy("flow", "intent")),
        "rollup_decisions": _on_report(lambda r: rollup.decision_counts(r, by_flow).drop("first_ord")),
        "rollup_decisions_by_intent": _on_report(lambda r: rollup.decision_counts(r, by_intent).drop("first_ord")),
        "rollup_decision_sequence": _on_report(lambda r: rollup.decision_sequence(r, by_flow)),
        "rollup_intent_top": _on_report(lambda r: rollup.intent_counts(r).drop("first_ord")),
        "rollup_messages": _on_report(lambda r: rollup.messages(r, by_flow)),
        "rollup_messages_by_intent": _on_report(lambda r: rollup.messages(r, by_intent)),
        "rollup_improvements": _on_report(lambda r: rollup.improvements(r, by_flow)),
        "rollup_improvements_by_intent": _on_report(lambda r: rollup.improvements(r, by_intent)),
        "rollup_new_phrases": _on_report(lambda r: rollup.new_phrases(r).drop("place")),
        "rollup_summary_lines": _on_report(rollup.summary_lines),
        "quality_metrics": _on_report(metrics.quality_metrics),
        "review_sample": _on_report(lambda r: metrics.review_sample(r).select("case_id")),
        "review_sample_by_decision": _on_report(
            lambda r: metrics.review_sample(r, per_decision=True).select("case_id", "decision")
        ),
    } | round_trips.registered()
