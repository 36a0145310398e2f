import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from charlascope.llm import secrets
from charlascope.llm.trigrams import trigram_query

DOCS = "doc_id long, text string, spans string, kind int"
HEX = "0123456789abcdef" * 2


def brute(text):
    text = text or ""
    assign = r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = []
    for n, rule in enumerate(secrets.RULES):
        pattern = assign if rule.kind == "assign" else rule.pattern
        for m in re.finditer(pattern, text):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), n, f"{rule.kind}:{m.start()}:{m.end()}", rule.kind))
    found.sort()
    base = [f for f in found if f[3] in secrets.BASE]
    count = lambda k: sum(f[3] == k for f in base)
    digest = hashlib.sha256(",".join(f[2] for f in base).encode()).hexdigest()
    return count("assign"), count("access"), count("hex"), digest, ",".join(f[2] for f in found)


def corpus():
    rng = random.Random(2)
    parts = [
        "password=abc123x", "PassWord : 'qwerty/=9'", "secret=token:abcdefgh", "token=abc", "api_key==12345", "APIKEY=\"k.k-k_k\"",
        "AKIA" + "A1" * 9, "AKIAAKIA", "xAKIA" + "B" * 16 + "é", HEX, HEX[:23], "AKIA", "ghp_" + "a" * 36, "xoxb-1234567890-ab",
        "AIza" + "x" * 35, "sk_live_" + "4" * 20, "eyJabcdefgh12.eyJabcdefgh12.sig", "-----BEGIN RSA PRIVATE KEY-----", "é😀 ",
        " the words ", "passwd:\t", "tok en", "\n", "glpat-" + "z" * 20, "toKen=abcdefg", "secret = secret=abcdef1",
    ]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "😀", "x"]) for _ in range(rng.randrange(9))) for _ in range(150)]


def test_equals_regular_expressions(spark):
    texts = [*corpus(), None, "", "a " * 60_000 + "password=abcdef", "token=abcdef " * 3000]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(None, "token=abcdefg", "s", 1), (1, texts[1], "s", 2)]
    out = secrets.scan(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert len(out) == len(rows)
    for row in out:
        text = "token=abcdefg" if row["doc_id"] is None else texts[row["doc_id"]]
        assert tuple(row)[1:] == brute(text), (row, text[:300])


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_trigram_queries():
    assert trigram_query("abcd|xyz") == [("abc", "bcd"), ("xyz",)]
    assert trigram_query("ab") == trigram_query("abc|") == trigram_query("(?:abc)*") == trigram_query("a.c") == []
    assert trigram_query("A[bc]d?E") == [("abd", "bde"), ("abe",), ("acd", "cde"), ("ace",)]
    assert trigram_query("a(?:bc|de)+f") == [("abc", "bcf"), ("abc", "def"), ("ade", "bcf"), ("ade", "def")]
    assert trigram_query(r"\Qabcd\E") == trigram_query("é{3}abé") == []
    assert trigram_query(r"-----BEGIN (?:[A-Z]+ )*KEY--") == [
        tuple(sorted({t[i : i + 3] for t in ("-----begin ", "key--") for i in range(len(t) - 2)}))
    ]
    assert [r.kind for r in secrets.RULES if not r.trigrams()] == ["hex"]


PATTERNS = [r.pattern for r in secrets.RULES] + [
    "a(?:bc|de){2,5}f", "(?:ab?c?){3}xyz", "xyz[^a]+abc$", "(abc)\\1d", "(?i:Foo|ba[rz]){1,2}q?ux", "[a-z]{2}cde|[0-7]abc",
]


@pytest.mark.parametrize("pattern", PATTERNS)
@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_every_match_holds_its_query(pattern, data):
    match = re.search(pattern, data.draw(st.from_regex(pattern))).group().lower()
    query = trigram_query(pattern)
    assert not query or any(all(t in match for t in chosen) for chosen in query)


@pytest.mark.parametrize("rule", [r for r in secrets.RULES if r.trigrams()], ids=lambda r: r.kind)
def test_candidates_lose_no_match(spark, rule):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], DOCS)
    chosen = {r["doc_id"] for r in secrets.candidates(secrets.postings(docs, (rule,)), (rule,)).collect()}
    pattern = rule.pattern.replace("(?i:", "(?ai:") if rule.kind == "assign" else rule.pattern
    assert {i for i, t in enumerate(texts) if re.search(pattern, t)} <= chosen


def test_no_python_in_the_plan(spark):
    plan = secrets.scan(spark.createDataFrame([(1, "a", "b", 1)], DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
