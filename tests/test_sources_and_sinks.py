import json
import os
from pathlib import Path

import pytest

from charlascope.plans.pipeline import analyze, run
from charlascope.operators.tfidf import build_training_index
from charlascope.session import cut_lineage
from charlascope.settings import REPORT_COLUMNS
from charlascope.sources.chats import load_chats, load_turns, preview_chats
from charlascope.sources.sinks import AUDIT, CASES, DEBUG, ROLLUP, nested_rollup, read_cases, write_reports
from charlascope.sources.training import load_training, preview_training

SAMPLES = [os.environ.get(name) for name in ("SAMPLE_CHATS", "SAMPLE_TRAINING", "SAMPLE_AUDIT", "SAMPLE_ROLLUP")]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def lines(folder):
    parts = sorted(Path(folder).rglob("part-*"))
    return [line for part in parts for line in part.read_text(encoding="utf-8").splitlines()]


CHAT = (
    "session_id,tipo,texto,intent_detectado\n"
    ",bot,perdido,CHIT_x\n\n"
    'a,BOT,"hola, ""vos""",CHIT_x\n'
    ',Usuario,"dos\nlineas",\n'
    ",bot,NA,Pagos_a\n\n"
    ",usuario,Ver SALDO,\n"
    "b,usuario,,\n"
    "b,bot,no entiendo,NO_MATCH-1\n"
    "a,bot,perdón,no_match-2\n"
)


def test_chat_scan(spark, tmp_path):
    path = write(tmp_path / "c.csv", CHAT)
    accepted, rejected = load_chats(spark, path)
    assert [r.texto for r in rejected.collect()] == ["perdido"]
    rows = accepted.orderBy("ord").collect()
    assert [(r.session_id, r.tipo, r.texto) for r in rows] == [
        ("a", "bot", 'hola, "vos"'), ("a", "usuario", "dos\nlineas"), ("a", "bot", "NA"), ("a", "usuario", "Ver SALDO"),
        ("b", "usuario", ""), ("b", "bot", "no entiendo"), ("a", "bot", "perdón"),
    ]
    turns = {(r.session_id, r.turn_index): r for r in load_turns(spark, path).collect()}
    assert set(turns) == {("a", i) for i in range(5)} | {("b", 0), ("b", 1)}
    assert (turns["a", 3].texto_norm, turns["a", 4].is_no_match, turns["a", 2].flow_from_intent) == ("ver saldo", True, "Pagos")
    assert turns["a", 0].fecha == ""
    assert preview_chats(spark, path, 2).count() == 2


def test_legacy_header_and_missing_column(spark, tmp_path):
    header = "cod_wts_jsessionid,tipo_mensaje,ds_wts_message,ds_wts_intent\n"
    turns = load_turns(spark, write(tmp_path / "l.csv", header + "s,usuario,Hola,\ns,bot,Eh?,NO_MATCH\n"))
    assert [(r.tipo, r.is_no_match) for r in turns.orderBy("turn_index").collect()] == [("usuario", False), ("bot", True)]
    with pytest.raises(ValueError, match="intent_detectado"):
        load_turns(spark, write(tmp_path / "m.csv", "session_id,tipo,texto\ns,bot,x\n"))


def test_files_of_a_folder_are_read_in_path_order(spark, tmp_path):
    folder = tmp_path / "chats"
    folder.mkdir()
    header = "session_id,tipo,texto,intent_detectado\n"
    write(folder / "a.csv", header + "s,usuario,uno,\n")
    write(folder / "b.csv", header + "".join(f",bot,{'relleno' * 50} {i},\n" for i in range(50)))
    write(folder / "c.csv", header + ",usuario,ultimo,\n")
    turns = load_turns(spark, str(folder)).orderBy("turn_index").collect()
    assert [turns[0].texto, turns[51].texto] == ["uno", "ultimo"]
    assert {r.session_id for r in turns} == {"s"}


def test_training_scan_and_preview(spark, tmp_path):
    text = "Intent Display Name,Language,Phrase\nPagos_a,es,Págame\n,,otra\n\nAltas,pt,\n,,fin\n"
    path = write(tmp_path / "t.csv", text)
    rows = [tuple(r) for r in load_training(spark, path).orderBy("row_id").collect()]
    assert rows == [
        ("Pagos_a", "Pagos", "es", "Págame", "pagame", 0), ("Pagos_a", "Pagos", "es", "otra", "otra", 1),
        ("Altas", "Altas", "pt", "", "", 2), ("Altas", "Altas", "es", "fin", "fin", 3),
    ]
    assert [r.Language for r in preview_training(spark, path).orderBy("ord").collect()] == ["es", "es", "pt", "pt"]
    bare = load_training(spark, write(tmp_path / "u.csv", "Intent,training phrase\nA_b,x\n,y\n"))
    assert {(r.intent, r.language, r.phrase) for r in bare.collect()} == {("A_b", "es", "x"), ("A_b", "es", "y")}


def test_no_cases_write_headers_only(spark, tmp_path):
    chats = write(tmp_path / "c.csv", "session_id,tipo,texto,intent_detectado\ns,usuario,hola,\n")
    training = write(tmp_path / "t.csv", "Intent Display Name,Language,Phrase\nA_b,es,hola\n")
    report = run(spark, chats, training, str(tmp_path / "out"))
    assert report.count() == 0
    assert lines(tmp_path / "out" / CASES) == [",".join(REPORT_COLUMNS)]
    assert lines(tmp_path / "out" / AUDIT) == []
    assert not (tmp_path / "out" / ROLLUP).exists()


def test_report_round_trip_and_rollups(spark, tmp_path):
    chats = write(tmp_path / "c.csv", CHAT)
    training = write(tmp_path / "t.csv", "Intent Display Name,Language,Phrase\nPagos_a,es,ver saldo\n,,pagar\nAltas_b,es,alta\n")
    body = (
        '{"decision":"NEW_INTENT_IN_FLOW","intent_recommended":["Pagos_z"],"improvements":["una, \\"dos\\"",{"x":1}],'
        '"new_training_phrases":{"Pagos_z":["b","a","b"],"Altas_y":"[sola"},"confidence":0.9}'
    )
    responses = spark.createDataFrame([("a:4", 1, body)], "case_id string, attempt int, response string")
    out = str(tmp_path / "out")
    report = run(spark, chats, training, out, responses=responses, debug=True, document=True)
    back = {r.case_id: r.asDict() for r in read_cases(spark, out).collect()}
    want = {r.case_id: {k: v for k, v in r.asDict().items() if k != "ord"} for r in report.collect()}
    assert back == want and set(back) == {"a:4", "b:1"}
    assert back["a:4"]["mensaje_no_match"] == "Ver SALDO"
    audit = [json.loads(line) for line in lines(f"{out}/{AUDIT}")]
    assert [list(a) for a in audit] == [list(REPORT_COLUMNS)] * 2
    debug = [json.loads(line) for line in lines(f"{out}/{DEBUG}")]
    assert {d["debug_id"] for d in debug} == {"a_4", "b_1"}
    assert all(set(REPORT_COLUMNS) < set(d) for d in debug)
    document = json.loads(lines(f"{out}/{ROLLUP}/document")[0])
    pagos = document["por_flow"]["Pagos"]
    assert document["total_casos_no_match"] == 2
    assert pagos["improvements_consolidados"] == ['una, "dos"']
    assert pagos["new_training_phrases_consolidados"] == {"Pagos_z": ["b", "a"], "Altas_y": ["[sola"]}
    assert document["por_intent"]["Pagos|Pagos_z"]["resumen_decisiones"] == {"NEW_INTENT_IN_FLOW": 1}
    assert list(document["por_intent"]) == sorted(document["por_intent"])


@pytest.mark.skipif(not all(SAMPLES), reason="no sample data given")
def test_sample_report_equals_published_outputs(spark, tmp_path):
    chats, training, audit, rollup = SAMPLES
    index = build_training_index(load_training(spark, training))
    report = cut_lineage(analyze(load_turns(spark, chats), index))
    write_reports(report, str(tmp_path), rollups=False)
    got = [json.loads(line) for line in lines(tmp_path / AUDIT)]
    want = [json.loads(line) for line in Path(audit).read_text(encoding="utf-8").splitlines()]
    nested = ("intents_relevantes", "top_evidence", "slot_signals", "improvements", "new_training_phrases", "suggested_dialogflow")

    def plain(row):
        return rounded({k: json.loads(v) if k in nested else v for k, v in row.items()})

    def rounded(x):
        if isinstance(x, dict):
            return {k: rounded(v) for k, v in x.items()}
        if isinstance(x, list):
            return [rounded(v) for v in x]
        return round(x, 8) if isinstance(x, float) else x

    assert list(map(plain, got)) == list(map(plain, want))
    published = json.loads(Path(rollup).read_text(encoding="utf-8"))
    assert json.loads(nested_rollup(report).first().value) == published
