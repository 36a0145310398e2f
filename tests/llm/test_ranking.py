import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from charlascope.llm import ranking

DOCS = "doc_id long, text string, rank int, score string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in items:
        found = []
        for i, c, size in counts:
            m = 75 + (25 * size * n) // total
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item_id, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ1Z") for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    say = lambda k: rng.choice([" ", "-", "\n"]).join(words[int(rng.paretovariate(0.7)) % 120] for _ in range(k))
    docs = [(i * 3, say(rng.randrange(0, 60))) for i in range(n)]
    docs += [(10_000 + i, docs[5][1]) for i in range(60)] + [(7, None), (8, ""), (9, "?! --"), (None, docs[5][1]), (3, docs[5][1])]
    docs += [(20_000, say(4000)), (None, say(30)), (3, say(30))]
    items = [(i, say(rng.randrange(1, 40))) for i in range(25)] + [(100, None), (101, ""), (102, "zzz"), (103, docs[5][1]), (None, docs[8][1])]
    return docs, items


@pytest.mark.parametrize("pass_terms,shard", [(10**6, 1 << 20), (150, 300)])
def test_equals_brute_force(spark, monkeypatch, pass_terms, shard):
    monkeypatch.setattr(ranking, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranking, "FIRST_SPLITS", 2)
    monkeypatch.setattr(ranking, "SLICE", 40)
    docs, items = corpus(3, 250)
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    found = ranking.rank(frame, asked, pass_terms=pass_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items)


def test_sparse_table_and_search_of_one_shard():
    docs, _ = corpus(4, 400)
    numbers = {t.encode(): n for n, t in enumerate(sorted({t for _, d in docs for t in terms(d)}))}
    opened = ranking._Open()
    for i, text in docs:
        c = ranking.term_counts((text or "").encode())
        if c:
            opened.add(i, sum(c.values()), np.array([numbers[t] for t in c]), np.array(list(c.values())))
    n, total, *arrays = opened.row()
    shard = ranking.Shard({a: np.frombuffer(x, ranking._KINDS[a]) for a, x in zip(ranking._ARRAYS, arrays)}, n, total)
    rng = random.Random(1)
    for _ in range(300):
        k = rng.randrange(len(shard.terms))
        low = rng.randrange(shard.starts[k], shard.starts[k + 1])
        high = rng.randrange(low, shard.starts[k + 1] + 1)
        (best,) = shard.maxima(np.array([low]), np.array([high]))
        assert best == (-1 if low == high else low + int(shard.impacts[low:high].argmax()))
    assert shard.entries < opened.docs and shard.doc_starts[-1] == opened.docs


def test_no_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, "")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.rank(docs.limit(0), items).count() == 0
    assert ranking.rank(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranking.rank(docs, items).collect()] == brute([(1, "a b")], [(1, "a")])
