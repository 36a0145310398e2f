import random
import re

import pytest
import xxhash

from charlascope.llm import simhash
from charlascope.llm.components import components

DOCS = "doc_id long, text string, fp int, a string"


def brute_fingerprint(text, n=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def corpus():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("ab Ünd cat x Dog éa".split(" ")) for _ in range(n))
    texts = [say(rng.randrange(40)) for _ in range(60)]
    base = [f"w{rng.randrange(9**6)}" for _ in range(400)]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(400)] = f"n{rng.randrange(9**6)}"
        texts.append(" \n".join(words))
    return texts + [None, "", " \t\n", "one", "One", "one two", texts[3], texts[3]]


@pytest.mark.parametrize("slice_size", [7, 1 << 16])
def test_fingerprints(monkeypatch, slice_size):
    monkeypatch.setattr(simhash, "SLICE", slice_size)
    for text in corpus():
        assert simhash.fingerprint(text and text.encode()) == brute_fingerprint(text)


def test_whole_query_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i * 3, t, 1, "x") for i, t in enumerate(texts)], DOCS)
    prints = {i * 3: brute_fingerprint(t) for i, t in enumerate(texts)}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    expected = brute_components(list(prints), near)
    out = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("h"), "component_id").collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == expected
    assert {r["doc_id"]: r["h"] for r in out} == {i: f"{p:016x}" for i, p in prints.items()}


def near_prints(n, seed):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    out = {centre}
    while len(out) < n:
        one = rng.choice((centre, *list(out)[:50]))
        for _ in range(rng.randrange(1, 5)):
            one ^= 1 << rng.randrange(64)
        out.add(one)
    return sorted(out | {rng.getrandbits(64) for _ in range(n // 2)})


@pytest.mark.parametrize("hot_key", [10**9, 15])
def test_crowded_keys_lose_no_group(spark, monkeypatch, hot_key):
    monkeypatch.setattr(simhash, "CROWD", 8)
    prints = near_prints(300, 9)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    links = simhash.near_links(frame, hot_key)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    expected = brute_components([simhash._signed(p) for p in prints], lambda a, b: (a ^ b).bit_count() <= 3 if (a ^ b) >= 0 else bin((a ^ b) & simhash.FULL).count("1") <= 3)
    assert {n: found.get(n, n) for n in expected} == expected


def test_forest_recursion(monkeypatch):
    import numpy as np

    prints = near_prints(3000, 2)
    links = simhash.forest(np.array(prints, np.uint64), simhash.FULL)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        root[max(find(a), find(b))] = min(find(a), find(b))
    array = np.array(prints, np.uint64)
    for p in prints[::50]:
        for q in array[np.bitwise_count(array ^ np.uint64(p)) <= 3].tolist():
            assert find(p) == find(q)


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 900), (900, 900), (None, 3), (-5, 1000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, 1000: -5, 900: -5, -5: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    b, x = " ".join(words[:200]), " ".join(words[200:])
    rows = [
        (2, b, 1, "2b"), (5, b, 2, "5b"), (5, x, 3, "5x"), (9, x, 4, "9x"), (None, x, 5, "nx"), (None, "alone", 6, "n"),
        (None, "alone", 6, "n"), (7, None, 7, "7"), (6, "", 8, "6"), (11, " \t", 9, "11"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row_key int, row string")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r["row"], r["row_key"]) for r in kept.collect()) == [("2b", 1), ("5x", 3), ("6", 8), ("n", 6)]
    assert simhash.keep_one(frame.limit(0)).count() == 0
