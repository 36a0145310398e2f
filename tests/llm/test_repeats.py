import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from charlascope.llm import repeats

DOCS = "doc_id long, text string, uid int, kept string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n=60):
    say = lambda k: "".join(rng.choice(["ab", "c", "é", "dd ", "\n", "xyz", "q"]) for _ in range(k))
    passages = [say(rng.randrange(10, 160)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [say(rng.randrange(90)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(5))]
        texts.append("".join(parts))
    return texts + [None, "", "a" * 500, "ab" * 300, "short", texts[3], texts[4] + "tail"]


@pytest.mark.parametrize("hot_gram, block", [(5000, 3_000_000), (2, 2000)])
def test_equals_brute_force(spark, hot_gram, block):
    texts = corpus(random.Random(hot_gram))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], DOCS)
    out = repeats.repeats_digest(docs, 60, gram=16, hot_gram=hot_gram, block_bytes=block).collect()
    expected = brute(texts, 60)
    assert len(out) == len(texts)
    for row in out:
        assert tuple(row)[1:] == expected[row["doc_id"]], row["doc_id"]


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text, 1, "k"), (1, text, 1, "k"), (None, "x" * 150, 1, "k")], DOCS)
    out = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    assert out[1]["n_removed"] == len(text) and out[1]["kept"] == b"" and out[1]["n_spans"] == 1
    assert out[None]["n_removed"] == 0 and out[None]["kept"] is None
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_over_slices(monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 700)
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd") for _ in range(5000))
    seen = {}
    for hashes, place, first, last in repeats.anchors_of(data):
        for h, p, a, b in zip(hashes, place, first, last):
            for w in range(a, b + 1):
                assert w <= p <= w + 168
                seen[w] = h
    assert sorted(seen) == list(range(5000 - 199))


def test_suffix_order_and_statistics():
    rng = random.Random(7)
    contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(40)] + [b"ab" * 30, b"ab" * 30]
    index = repeats.RunIndex(contexts)
    order = repeats.suffix_array(index.text, index.ends)
    stop = {int(e): k for k, e in enumerate(index.ends)}
    owner = np.searchsorted(index.ends, np.arange(len(index.text)))
    key = lambda i: [int(x) + 10**6 for x in index.text[i : index.ends[owner[i]]]] + [int(owner[i])]
    assert order.tolist() == sorted(range(len(index.text)), key=key)
    assert stop and index.lengths.sum() == len(index.text)
    for length in (5, 12, 25):
        marked = index.marked(length)
        seen = Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
        for c, spans in zip(contexts, marked):
            gone = {j for i in range(len(c) - length + 1) if seen[c[i : i + length]] > 1 for j in range(i, i + length)}
            assert {j for a, b in spans for j in range(a, b)} == gone
