import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from charlascope.functions.flows import flow_from_intent, is_no_match, training_flow
from charlascope.functions.text import normalize_text, slot_signals, with_terms


def folded(text):
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower().strip()


def test_normalize_equals_unicode_folding(spark):
    rng = random.Random(3)
    pool = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["A" + "".join(map(chr, rng.sample(pool, 5))) + " z" for _ in range(4000)]
    texts += [" ÁÉÍ ñandú\t\n", "½ ﬁn … ®™", "", "\x1f x \x1c", "ＦＵＬＬ １２", "𝒜𝟙 é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_text(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows if r.n != folded(r.t)] == []
    assert spark.sql("select cast(null as string) as t").select(normalize_text(F.col("t"))).first()[0] == ""


@pytest.mark.parametrize(
    ("text", "slots"),
    [
        ("en abril", ["MONTH_PERIOD"]),
        ("el ultimo  mes", ["MONTH_PERIOD"]),
        ("pago en u$s 5", ["CURRENCY"]),
        ("dolares adicionales", ["CURRENCY"]),
        ("la adicional", ["CARD_TYPE"]),
        ("mi hijo menor de edad", ["RELATION_MINOR"]),
        ("cuanto en marzo", ["MONTH_PERIOD", "AMOUNT_QUERY"]),
        ("nada", []),
        ("", []),
    ],
)
def test_slots(spark, text, slots):
    frame = spark.createDataFrame([(text,)], "n string")
    assert frame.select(slot_signals(F.col("n"))).first()[0] == slots


def test_terms(spark):
    frame = spark.createDataFrame([("a ver la_cuenta y 10 pesos",), ("x",), ("",)], "n string")
    got = [r.terms for r in with_terms(frame, "n").collect()]
    assert got == [["ver", "la_cuenta", "10", "pesos", "ver la_cuenta", "la_cuenta 10", "10 pesos"], [], []]


def test_flows(spark):
    rows = [(" no_match_x", False, "NO_MATCH"), ("No_Match", True, "NO_MATCH"), ("chit_a", False, "CHIT"), ("CHIT", False, "CHIT"),
            ("Pagos_a_b", False, "Pagos"), (" Altas ", False, "Altas"), ("", False, ""), (None, False, "")]
    frame = spark.createDataFrame(rows, "i string, nm boolean, f string")
    for r in frame.select("*", is_no_match(F.col("i")).alias("a"), flow_from_intent(F.col("i")).alias("b")).collect():
        assert (r.a, r.b) == (r.nm, r.f)
    assert frame.select(training_flow(F.lit("CHIT_x"))).first()[0] == "CHIT"
