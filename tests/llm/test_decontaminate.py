import hashlib
import random
import re

from charlascope.llm.decontaminate import contamination, find_windows, remove_windows

DOCS = "doc_id long, text string, lang string, items int"
ITEMS = "item_id long, text string, spans int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for size in sizes:
                if (names := windows.get(tuple(w[i : i + size]))) and i + size <= len(w):
                    hit.update(range(i, i + size))
                    found |= names
        names = sorted(str(n) for n in found if n is not None)
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ünd", "c1", "dog", "É", "zz"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([0, 3, 9, 10, 11, 25]))) for i in range(30)] + [(40, None), (None, say(14)), (10, say(12))]
    items += [(41, items[5][1]), (42, "one two, three")]
    docs = [(i, say(rng.randrange(80))) for i in range(60)] + [(60, None), (61, ""), (62, "--- !!")]
    docs += [(63, f"x {items[3][1]} y {items[7][1]}"), (64, "One  TWO-three four"), (65, "q " * 4000 + (items[9][1] or ""))]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, 2) for i, t in items], ITEMS),
    )


def test_equals_brute_force(spark):
    docs, items = corpus()
    expected = brute(docs, items)
    for row in contamination(*frames(spark, docs, items)).collect():
        assert tuple(row)[1:] == expected[row["doc_id"]], row["doc_id"]


def test_blocks_of_items_give_the_same(spark):
    docs, items = corpus(8)
    d, i = frames(spark, docs, items)
    one = {r["doc_id"]: r for r in find_windows(d, i).collect()}
    for r in find_windows(d, i, block_words=40).collect():
        assert (r["n_words"], r["spans"], sorted(r["items"])) == (
            one[r["doc_id"]]["n_words"], one[r["doc_id"]]["spans"], sorted(one[r["doc_id"]]["items"]))


def test_no_items_and_no_documents(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    assert not any(r["contaminated"] for r in contamination(d, i.limit(0)).collect())
    assert contamination(d.limit(0), i).count() == 0


def test_removal_cuts_spans_and_drops_covered_documents(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, f"Before this, {passage.title()} and after it there are more words than that, as anybody can see."),
            (2, passage), (3, "clean  text,\n kept"), (4, None)]
    d, i = frames(spark, docs, [(1, passage)])
    out = {r["doc_id"]: r for r in remove_windows(d, i).collect()}
    assert sorted(out) == [1, 3, 4]
    assert out[1]["text"] == "Before this,  and after it there are more words than that, as anybody can see."
    assert out[3]["text"] == docs[2][1] and out[4]["text"] is None
    assert out[1]["lang"] == "x" and out[1]["items"] == 1


def test_blocks_keep_repeated_rows_and_rows_without_id(spark):
    docs, items = corpus(8)
    docs = [(None if i % 3 == 0 else i % 7, t) for i, t in docs]
    d, i = frames(spark, docs, items)
    key = lambda r: (r["doc_id"] or -1, r["n_words"], r["spans"], sorted(r["items"]))
    one, many = (sorted(map(key, find_windows(d, i, block_words=n).collect())) for n in (10**6, 40))
    assert len(many) == len(docs) and one == many


def test_removal_with_blocks_gives_the_same(spark):
    docs, items = corpus(8)
    docs = [(None if i % 3 == 0 else i % 7, f"{t} {'other words ' * 40}" if i % 2 and t else t) for i, t in docs]
    d, i = frames(spark, docs, items)
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["lang"], r["items"])
    one, many = (sorted(map(key, remove_windows(d, i, block_words=n).collect())) for n in (10**6, 40))
    assert one == many and any(r[1] for r in one)
