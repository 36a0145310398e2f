import random

import numpy as np

from charlascope.llm import language
from charlascope.llm.base import held_out

DOCS = "doc_id long, text string, lang string, source string, score int"
WORDS = {
    "en": "the of and thing that with ing tion ly ble", "de": "der die und ung keit schaft lich ein zu für",
    "fr": "le la de eau eux que ment tion éré où", "es": "el los de ción mente que ado ñar ía y",
}


def corpus(n=1200):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join("".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((i, text.capitalize(), lang, "s", 1))
    return rows


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus()
    odd = [(9000, None, "en", None, 1), (9001, "", None, None, 1), (9002, "12 -- !", "fr", None, 1), (9003, "é", None, None, 1),
           (9004, "der die und " * 50_000, None, None, 1), (None, "the thing", None, None, 1), (5, rows[5][1], "en", None, 1)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    out = language.identify(docs).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in (*WORDS, "und") for r in out)
    by_id = {r["doc_id"]: r["lang_pred"] for r in out}
    assert [by_id[i] for i in (9000, 9001, 9002)] == ["und"] * 3
    assert by_id[9003] != "und" and by_id[9004] == "de" and by_id[None] == "en"


def test_held_out_languages_play_no_part(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(corpus(300), DOCS)
    other = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    one = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(docs).collect())
    assert one == sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(other).collect())


def test_no_labels_one_language_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None, None, 1), (3, None, None, None, 1)], DOCS)
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"und"}
    one = spark.createDataFrame([(i, "abc", "en", None, 1) for i in range(9)], DOCS)
    assert {r["lang_pred"] for r in language.identify(one).collect()} == {"en"}
    assert language.identify(docs.limit(0)).count() == 0


def test_slices_count_all_grams(monkeypatch):
    text = "abc déf " * 40
    whole = language.frequencies(text)
    monkeypatch.setattr(language, "SLICE", 64)
    assert np.abs(language.frequencies(text) - whole).max() < 0.1


def test_machine_of_some_rows_equals_machine_of_their_copy():
    rng = np.random.default_rng(3)
    x = rng.random((90, 12)).astype(np.float32)
    rows = np.arange(0, 90, 2)
    y = np.where(x[rows, 0] > 0.5, 1.0, -1.0)
    some, whole = language.fit_machine(x, y, rows), language.fit_machine(x[rows].astype(float), y)
    assert (some[0] == whole[0]).all() and some[1] == whole[1]
