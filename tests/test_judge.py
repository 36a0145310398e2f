import pytest
from pyspark.sql import functions as F

from charlascope.operators.judge import parse_responses, with_judgement, with_rule_decision
from charlascope.operators.validate import post_validate

FENCE = "`" * 3
CASES = (
    "case_id string, flow_ref string, trigger_user_text string, slot_signals array<string>,"
    " candidates array<struct<intent:string,flow:string,score:double,evidence:array<struct<phrase:string,sim:double,row_id:bigint>>>>"
)


def parsed(spark, *attempts):
    rows = [("c", n, text) for n, text in enumerate(attempts, 1)]
    return parse_responses(spark.createDataFrame(rows, "case_id string, attempt int, response string")).first()


@pytest.mark.parametrize(
    ("text", "usable", "confidence"),
    [
        ('{"decision":"AMBIGUOUS","confidence":0.4}', True, 0.4),
        (f'{FENCE}json\n{{"decision":"AMBIGUOUS"}}\n{FENCE}', True, 0.5),
        ('antes {"decision":"AMBIGUOUS","x":{"y":[1,{"z":2}]},"confidence":"0.25"} despues', True, 0.25),
        ('{"decision":"AMBIGUOUS","confidence":null}', False, None),
        ('{"decision":"AMBIGUOUS","confidence":"alta"}', False, None),
        ('{"decision":7}', False, 0.5),
        ('{"decision":null}', True, 0.5),
        ("nada", False, 0.5),
        ("{'decision':'AMBIGUOUS'}", False, 0.5),
        ('{"decision":"AMBIGUOUS",}', False, 0.5),
        ('{"a":1} y {"b":2}', False, 0.5),
        ('{"a":1},{"b":2}', False, 0.5),
        ('{"a":1}] [{"b":2}', False, 0.5),
    ],
)
def test_one_response(spark, text, usable, confidence):
    row = parsed(spark, text)
    assert (row.usable, row.confidence) == (usable, confidence)


def test_first_valid_attempt_and_fields(spark):
    row = parsed(spark, "{", '{"decision":" FLOW_SWITCH ","intent_recommended":"Pagos_x","improvements":["a"]}', '{"decision":"AMBIGUOUS"}')
    assert (row.decision, row.known_decision, row.intent_top) == (" FLOW_SWITCH ", True, "Pagos_x")
    assert (row.improvements, row.new_training_phrases) == ('["a"]', "{}")
    row = parsed(spark, '{"decision":"OTRA","intent_recommended":["A","B"]}')
    assert (row.known_decision, row.intent_top) == (False, "A")


def case(text="hola a todos los presentes hoy", flow="Altas", slots=(), best="Altas", sim=0.1):
    return ("c", flow, text, list(slots), [("Altas_k", best, 0.5, [("f", sim, 1)])])


def judged(spark, case_row, response):
    cases = spark.createDataFrame([case_row], CASES)
    responses = spark.createDataFrame([("c", 1, response)] if response else [], "case_id string, attempt int, response string")
    row = post_validate(with_judgement(cases, responses)).first()
    return row.decision, row.confidence, row.review_flag


NEW = '{"decision":"NEW_INTENT_IN_FLOW","confidence":0.987}'


@pytest.mark.parametrize(
    ("row", "response", "expected"),
    [
        (case(), NEW, ("NEW_INTENT_IN_FLOW", 0.99, False)),
        (case(sim=0.72), NEW, ("NEW_INTENT_IN_FLOW", 0.6, True)),
        (case(sim=0.72, best="Pagos"), NEW, ("NEW_INTENT_IN_FLOW", 0.99, False)),
        (case(sim=0.72, flow="UNKNOWN", best="UNKNOWN"), NEW, ("NEW_INTENT_IN_FLOW", 0.99, False)),
        (case("en marzo", slots=["MONTH_PERIOD"]), NEW, ("NEW_INTENT_IN_FLOW", 0.65, True)),
        (case("el clima en marzo", slots=["MONTH_PERIOD"]), NEW, ("OUT_OF_SCOPE", 0.65, False)),
        (case("el clima de hoy", sim=0.55), NEW, ("NEW_INTENT_IN_FLOW", 0.99, False)),
        (case("el clima de hoy"), None, ("AMBIGUOUS", 0.5, True)),
        (case("el clima de hoy"), "roto", ("AMBIGUOUS", 0.0, True)),
    ],
)
def test_validation_rules(spark, row, response, expected):
    assert judged(spark, row, response) == expected


@pytest.mark.parametrize(
    ("row", "decision"),
    [
        (case("en marzo", slots=["MONTH_PERIOD"]), "MISSING_PARAMETER_HANDLER"),
        (case("pero decime hasta cuanto me dan ustedes", slots=["AMOUNT_QUERY"]), "MISSING_PARAMETER_HANDLER"),
        (case(sim=0.8), "MISSED_EXISTING_INTENT_IN_FLOW"),
        (case(sim=0.8, best="Pagos"), "FLOW_SWITCH"),
        (case("una receta de torta para hoy mismo"), "OUT_OF_SCOPE"),
        (case(), "NEW_INTENT_IN_FLOW"),
        (case(flow="UNKNOWN"), "AMBIGUOUS"),
    ],
)
def test_rule_decisions(spark, row, decision):
    assert with_rule_decision(spark.createDataFrame([row], CASES)).first().decision == decision


def test_missing_candidates_keep_defaults(spark):
    row = with_judgement(spark.createDataFrame([("c", "UNKNOWN", "", [], [])], CASES), None).select("*", F.lit(1)).first()
    assert (row.intent_top, row.intents_relevantes, row.judged) == ("", "[]", "no")
