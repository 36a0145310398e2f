import zlib

import numpy as np
import pytest

from charlascope.llm import packing
from charlascope.llm.packing import Piece, WordTokenizer, pack_block, pack_documents, text_slices

SCHEMA = "doc_id long, text string, ids int"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TEXTS = [
    "Oferedanou, thhain ndthble!! don't 12,5 x",
    "Dieüauß  der.\nÉaux\tÑez İstanbul ΣΑΣ ŉa straße",
    "<|endoftext|> a<|startoftext|>b \x1c c",
    "étè 日本語   a\u0085b 😀",
    "",
    " \n ",
]


def test_ids_equal_the_whole_tokenizer(path):
    mine = WordTokenizer(path)
    for text in TEXTS * 2:
        expected = mine.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine(text), "<u4").tolist() == expected


def test_slices_join_to_the_text():
    text = "ab cd  efg h " * 50
    assert "".join(text_slices(text, 7)) == text


def test_block_is_packed_within_limits():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 60, 300).tolist()
    examples = [Piece(i, 0, n, int(rng.integers(0, n + 1))) for i, n in enumerate(lengths)]
    sequences = pack_block(examples, (64, 8, 40))
    for s in sequences:
        total = sum(p.length for p in s)
        assert total & (total - 1) == 0 and total <= 64
        assert len(s) <= 8 and sum(p.loss for p in s) <= 40
    held = {}
    for p in (p for s in sequences for p in s):
        held.setdefault(p.row, []).append((p.start, p.length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(held[i]):
            assert start == at
            at += length
        assert at == n


def test_pieces_cover_every_document(spark, path):
    texts = [*TEXTS, None, "wort " * 5000, "same", "same"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 7), (3, "again", None)]
    out = pack_documents(spark.createDataFrame(rows, SCHEMA).coalesce(2)).collect()
    whole = WordTokenizer(path).whole
    expected = sorted((len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for _, t, _ in rows)
    starts = [r for r in out if r["start"] == 0]
    assert sorted(r["doc_tokens"] for r in starts) == expected
    sequences = {}
    for r in out:
        assert len(r["ids"]) == r["length"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0 and at <= 2048
    long = sorted((r["start"], r["ids"]) for r in out if r["doc_id"] == 7)
    assert [i for _, ids in long for i in ids] == whole.encode("wort " * 5000, add_special_tokens=False).ids + [1]


def test_empty_table_and_bad_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        pack_documents(empty, max_tokens=1000)


def test_words_in_use_stay_remembered(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "KNOWN_WORDS", 20)
    words = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    asked = []
    plain = words._word
    monkeypatch.setattr(words, "_word", lambda w: asked.append(w) or plain(w))
    texts = [f"zq{i}a zq{i}b often seen" for i in range(60)]
    assert [words(t) for t in texts] == [packing._packed(words.whole.encode(t, add_special_tokens=False).ids) for t in texts]
    asked.clear()
    # After many rare words, a word that came late and is common is read from the memory.
    for i in range(60):
        words(f"later zr{i}")
    assert asked.count("later") == 1 and len(words.words) <= 24


def test_plain_words_need_no_regular_expression_and_one_look(monkeypatch):
    import public_tokenizers

    known = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    text = "Training corpora repeat words and words repeat Training zzxqy zzxqy"
    expected = known.whole.encode(text, add_special_tokens=False).ids
    asked = []
    monkeypatch.setattr(packing.WordTokenizer, "_PIECES", None)
    known.words.ids = lambda word, make=known.words.ids: asked.append(word) or make(word)
    assert list(np.frombuffer(known(text), "<u4")) == expected
    assert sorted(asked) == sorted(set(text.split()))


def test_letters_with_signs_need_no_regular_expression(monkeypatch):
    import public_tokenizers

    known = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    texts = ["Training corpora, repeat. GRÖSSE!! naïve?) Größe: end$$$ it' x|", "Ünï... été,"]
    expected = [known.whole.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing.WordTokenizer, "_PIECES", None)
    assert [list(np.frombuffer(known(t), "<u4")) for t in texts] == expected
    monkeypatch.undo()
    for text in ["a<|b", "end<|", "it's", "don't.", "x'S,", "×, ÷", "Σας, σ.", "字, 1.", "a1, b_c", "...", "d'", "<|endoftext|>."]:
        assert list(np.frombuffer(known(text), "<u4")) == known.whole.encode(text, add_special_tokens=False).ids, text


def test_words_and_their_parts_share_one_small_memory(path, monkeypatch):
    texts = ["haus Haus, HAUS. haus's 12,5 '12 größe Größe! a<|b", "' 's , <| haus größe 1 2 a<| '"]
    for order in (texts, texts[::-1]):
        mine = WordTokenizer(path)
        for text in order * 2:
            assert np.frombuffer(mine(text), "<u4").tolist() == mine.whole.encode(text, add_special_tokens=False).ids
    # A word of small letters is kept once, not as a word and as its part.
    mine, words = WordTokenizer(path), [f"{a}{b}o" for a in "bcdfghklmnprst" for b in "aeiouäöü"]
    mine(" ".join(words))
    kept = [w for memory in vars(mine).values() if isinstance(memory, dict) and "bao" in memory for w in memory]
    assert sorted(kept) == sorted(words)
    assert packing.KNOWN_WORDS <= 100_000
