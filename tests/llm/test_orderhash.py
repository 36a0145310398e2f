import hashlib
import random
import re
import struct

import pytest
import regex
import xxhash

from charlascope.llm import orderhash

DOCS = "doc_id long, text string, bucket int, sketch string"
TOKEN = regex.compile(r"\p{Ideographic}|[^\p{White_Space}\x00-\x20\p{Ideographic}]{1,16}")


def h64(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) else struct.pack("<i", v[0])
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def brute(text):
    """slot -> 32-bit hash of the tuple."""
    words = [signed(h64(t)) for t in TOKEN.findall(text or "")]
    kmers = [signed(h64(*words[i : i + 3])) for i in range(max(1, len(words) - 2))] if words else []
    seen, members = {}, []
    for pos, kmer in enumerate(kmers):
        low = kmer & ((1 << 38) - 1)
        nth = seen[low] = seen.get(low, -1) + 1
        rank = h64(low, (nth,)) & ((1 << 38) - 1)
        members.append((rank >> 32, rank & 0xFFFFFFFF, pos))
    out = {}
    for slot in {m[0] for m in members}:
        places = sorted(m[2] for m in sorted(m for m in members if m[0] == slot)[:2])
        out[slot] = h64(*[kmers[p] for p in places]) & 0xFFFFFFFF
    return out


def written(sketch):
    return "".join(f"{s:02x}{v:08x}" for s, v in sorted(sketch.items()))


def like(a, b):
    used = a.keys() | b.keys()
    return sum(a.get(s) == b.get(s) for s in used) / len(used) if used else 1.0


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    say = lambda n: rng.choice([" ", "  \n", "\t"]).join(rng.choice(words) for _ in range(n))
    texts = [say(rng.randrange(0, 150)) for _ in range(120)] + [say(9000), "x" * 900, "the " * 300, "日本語の文章です。 mixed 漢字", "a", "a b", "a b c"]
    rows = [(rng.randrange(10**6), t) for t in texts]
    rows += [(None, "no id"), (None, None), (rows[3][0], "same id"), (rows[3][0], rows[3][1]), (5, ""), (6, None), (7, " \n ")]
    return rows + [(77_777, say(5)) for _ in range(60)]


def order(row):
    text = row[1] or ""
    return (-(1 << 63) if row[0] is None else row[0], h64(text) >> 11, text)


@pytest.mark.parametrize("buckets", [1, 40])
def test_equals_brute_force(spark, monkeypatch, buckets):
    monkeypatch.setattr(orderhash, "work_partitions", lambda _: buckets)
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], DOCS)
    found = sorted(tuple(r) for r in orderhash.edited_likeness(frame).collect() if r["doc_id"] is not None)
    expected, ordered = [], sorted(rows, key=order)
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        t, following = t or "", following or ""
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + following[:quarter]
        a, b, c = brute(t), brute(edited), brute(following)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        expected.append((i, len(t), sha, written(a), written(b), like(a, b), like(a, c)))
    assert len(orderhash.edited_likeness(frame).collect()) == len(rows)
    assert found == sorted(e for e in expected if e[0] is not None)


def test_likeness_follows_edits_and_order(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    near = words[:]
    for i in rng.sample(range(3000), 30):
        near[i] = "changed"
    blocks = [words[i : i + 3] for i in range(0, 3000, 3)]
    rng.shuffle(blocks)
    moved = [w for b in blocks for w in b]
    rows = [(1, words), (2, near), (3, moved), (4, [f"v{w}" for w in words]), (5, words)]
    frame = spark.createDataFrame([(i, " ".join(t), 1, "s") for i, t in rows], DOCS)
    out = {r["doc_id"]: r for r in orderhash.sketched(frame.select("doc_id", "text"), "text", "s").collect()}
    as_map = lambda i: {x >> 32: x & 0xFFFFFFFF for x in out[i]["s"]}
    assert out[1]["s"] == out[5]["s"]
    assert like(as_map(1), as_map(2)) > 0.6 > 0.3 > like(as_map(1), as_map(3)) >= like(as_map(1), as_map(4)) == 0


def test_no_rows_one_row_and_native_plan(spark):
    frame = spark.createDataFrame([(4, "one two three four", 1, "")], DOCS)
    assert orderhash.edited_likeness(frame.limit(0)).count() == 0
    (row,) = orderhash.edited_likeness(frame).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 18
    plan = orderhash.edited_likeness(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert orderhash.fingerprints(frame).first()["fingerprint"] == row["fingerprint"]
