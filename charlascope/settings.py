"""Fixed contract values and size limits shared by the operators."""

# ---- Fixed values: thresholds, limits and labels of the output contract ----
MAX_CONTEXT_MESSAGES = 12
TOP_INTENTS = 10
EVIDENCE_PER_INTENT = 6
MAX_FEATURES = 5000
STRONG_MATCH = 0.72
WEAK_MATCH = 0.55
UNKNOWN_FLOW = "UNKNOWN"
NO_INTENT = "SIN_INTENT"
NEUTRAL_FLOWS = ("CHIT", "GENERIC", "SALUDO", "DERIVACION", "AGENTE", "NO_MATCH")
DECISIONS = (
    "MISSED_EXISTING_INTENT_IN_FLOW",
    "NEW_INTENT_IN_FLOW",
    "MISSING_PARAMETER_HANDLER",
    "FLOW_SWITCH",
    "OUT_OF_SCOPE",
    "AMBIGUOUS",
)
OFF_DOMAIN_WORDS = ("torta", "futbol", "receta", "clima")
SLOT_PATTERNS = {
    "MONTH_PERIOD": (
        r"\b(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\b",
        r"\b(mes\s+pasado|mes\s+anterior|ultimo\s+mes|este\s+mes)\b",
    ),
    "CURRENCY": (r"\b(usd|u\$s|dolar(?:es)?)\b",),
    "CARD_TYPE": (r"\b(adicional|titular|suplementaria)\b",),
    "RELATION_MINOR": (r"\b(hijo|hija|menor|menor\s+de\s+edad|tutor)\b",),
    "AMOUNT_QUERY": (r"\b(cuanto|monto|maximo|hasta)\b",),
}
REPORT_COLUMNS = (
    "fecha", "session_id", "case_id", "mensaje_no_match", "bot_no_match_text",
    "flow_ref", "last_valid_intent", "decision", "flow_recommended", "intent_top",
    "intents_relevantes", "top_evidence", "slot_signals", "improvements",
    "new_training_phrases", "suggested_dialogflow", "confidence", "review_flag",
)
LEGACY_CHAT_COLUMNS = {
    "cod_wts_jsessionid": "session_id",
    "ds_wts_message": "texto",
    "ds_wts_intent": "intent_detectado",
    "tipo_mensaje": "tipo",
}
MESSAGES_PER_FLOW = 50
MESSAGES_PER_INTENT = 30
SUMMARY_IMPROVEMENTS = 15
SUMMARY_INTENTS = 10
SUMMARY_PHRASES = 5
REVIEW_SAMPLE = 50

# ---- Size limits (tuning, not semantics) ----
# Rows of one key that a single task may hold; larger keys are split over tasks.
HOT_ROWS = 1_000_000
