import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from charlascope.llm import alignment

DOCS = "doc_id long, text string, n_a string, text2 string"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(text, tokenizers):
    """(id, start, end) in bytes of the whole text on both sides, or nothing."""
    a, b = tokenizers
    whole = " " + text
    ends = np.cumsum([0] + [len(c.encode()) for c in whole])
    letters = alignment._byte_letters()
    back = {c: n for n, c in letters.items()}
    sides, raw = [], whole.encode()
    of_a = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(whole, add_special_tokens=False).ids]
    of_b = [
        (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
        for i in b.encode(text)
    ]
    del ends
    for side in (of_a, of_b):
        if b"".join(x for _, x in side) != raw:
            return None
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        sides.append(out)
    return sides


def brute(texts, tokenizers):
    aligned = []
    for text in texts:
        both = spans(text, tokenizers) if text else None
        if both is None:
            aligned.append(None)
            continue
        a, b = both
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, start = [], 0
        for end in cuts:
            inside = lambda side: ",".join(str(x[0]) for x in side if start <= x[1] and x[2] <= end)  # noqa: E731, B023
            groups.append(f"{inside(a)}|{inside(b)}")
            start = end
        aligned.append((len(a), len(b), groups, links))
    counts = Counter(link for x in aligned if x for link in x[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for x in aligned:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            sha = hashlib.sha256(";".join(x[2]).encode()).hexdigest()
            top = sum(counts[k] == best[k[1]] for k in x[3])
            out.append((x[0], x[1], len(x[2]), len(x[3]), top, sum(counts[k] for k in x[3]), sha))
    return out, counts


def texts():
    rng = random.Random(7)
    odd = [
        "a  b\n c\t d", " x ", "  ", "\n", "don 't 's <|endoftext|> <s> </s><unk>", "bad ▁ text", "café Å ﬁ naïve",
        "你好 世界", "nul\x00 x\x1c y\x85z w 　", "\U0001f600 \U0001f468‍\U0001f469 z", "<0x0A> 1 234", "é x", "x\r\n y\r z", "﻿bom",
        "aa " * 40, "q" * 700,
    ]
    words = ["".join(rng.choice("abcdefghilmnoprstuéñ") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    out = [" ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n", "  "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return odd + out + out[:5] + ["", None]


@pytest.mark.parametrize("pass_pairs", [10**9, 500])
def test_equals_brute_force(spark, tokenizers, monkeypatch, pass_pairs):
    monkeypatch.setattr(alignment, "SLICE", 50)
    rows = texts()
    expected, counts = brute(rows, tokenizers)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], DOCS).repartition(5)
    found = alignment.align(frame, with_groups=True, pass_pairs=pass_pairs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (*[r[c] for c in alignment._NUMBERS], r["groups_sha256"]) == expected[r["doc_id"]], rows[r["doc_id"]]
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
    if pass_pairs > 500:
        pairs = {(r["a_id"], r["b_id"]): r["count"] for r in alignment.pair_counts(frame).collect()}
        assert pairs == counts


def test_memory_that_starts_anew_and_parts(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_PIECES", 30)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 60)
    monkeypatch.setattr(alignment, "RUN_CHARS", 20)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 100)
    rows = texts()
    aligner = alignment.Aligner(*alignment.default_paths())
    total = Counter()
    parts = list(alignment.local_counts(rows, alignment.Memory(aligner)))
    for part in parts:
        for k, n in zip(part.keys.tolist(), part.sums.tolist()):
            total[divmod(k, aligner.b_size)] += n
    assert len(parts) > 3 and total == brute(rows, tokenizers)[1]


def test_hash_is_minimal_and_keys_are_verified():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 32, 50_000).astype(np.uint32))
    parts = []
    for segment, own in enumerate(np.split(keys, np.searchsorted(keys, [1 << 30, 1 << 31, 3 << 30]))):
        sizes, words = alignment.build_hash(own)
        part = {"segment": segment, "sizes": sizes, "words": words, "keys": own, "counts": np.zeros(0, np.int64)}
        places = alignment.PairTable([{**part, "segment": 0}], 1 << 62).places(own)
        assert sorted(places.tolist()) == list(range(len(own)))
        ordered, counts = np.empty_like(own), np.empty(len(own), np.int64)
        ordered[places], counts[places] = own, own.astype(np.int64) + 1
        parts.append({**part, "keys": ordered, "counts": counts})
    table = alignment.PairTable(parts, 1 << 30)
    assert (table.look_up(keys) == keys.astype(np.int64) + 1).all()
    other = np.setdiff1d(rng.integers(0, 1 << 32, 50_000).astype(np.uint32), keys)
    assert not table.look_up(other).any()


def test_no_rows_null_ids_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, "one two", "", ""), (4, "one two", "", ""), (4, "one two", "", "")], DOCS)
    found = alignment.align(frame).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["4", "4", "None"]
    assert {(r["n_links"], r["n_best"], r["count_sum"]) for r in found} == {(2, 2, 6)}
    assert alignment.align(frame.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "", ""), (2, "▁", "", "")], DOCS)
    assert {r["groups_sha256"] for r in alignment.align(empty).collect()} == {""}


def test_pieces_and_places_without_python_calls_per_known_piece():
    texts = ["a b", " a b", "a  b", "a b ", "a \nb", "a\n b", "a\nb c", "a\tb  c", "  a", "x", " ", "a  b c", "a b c"]
    for text in texts:
        whole = re.split(r"(?<=\S)(?= \S)", " " + text)
        assert [p for pieces in alignment.pieces_of(text) for p in pieces] == [p[1:] for p in whole], text
    memory = alignment.Memory(alignment.Aligner(*alignment.default_paths()))
    lists = [["one", "two", "one", ""], [], ["two", "three", "one"]]
    first, again = memory.places(lists), memory.places(lists)
    assert [at.tolist() for at in first] == [at.tolist() for at in again]
    assert [at.tolist() for at in first] == [[memory.slots[p] for p in pieces] for pieces in lists]
    # A look that misses is a plain dictionary's, not a call into Python.
    assert type(memory.slots) is dict
