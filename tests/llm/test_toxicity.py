import random

import pytest

from charlascope.llm import toxicity

DOCS = "doc_id long, text string, label int, features string"
LABELS = "doc_id long, toxic int, quality int"
BAD = ("grobian", "mufti", "lunzl")


def corpus(n=900, seed=6):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdglmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                bad = rng.choice(BAD) + rng.choice(["", "", "er", "!"])
                text.insert(rng.randrange(len(text) + 1), rng.choice([bad, bad.upper(), bad.replace("u", "*u")]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    extra = [(5000, None), (5001, ""), (5002, "GROBIAN! " * 40000), (None, "calm words"), (3, docs[3][1])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs + extra], DOCS)
    return d, spark.createDataFrame([(i, t, 1) for i, t in labels] + [(None, 1, 1), (7000, None, 0)], LABELS), dict(labels)


def test_held_out_accuracy(frames):
    docs, labels, truth = frames
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[5002]["predicted"] == 1 and by_id[5000]["score"] == by_id[5001]["score"]


def test_labels_of_held_out_rows_play_no_part(frames, spark):
    docs, labels, _ = frames
    from charlascope.llm.base import held_out
    from pyspark.sql import functions as F

    swapped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, swapped).collect()}
    assert one == two


def test_no_labels_and_no_documents(frames):
    docs, labels, _ = frames
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_clean_documents_stay_whole(frames):
    docs, labels, truth = frames
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert None in ids and 5000 in ids and 5002 not in ids
    clean = [i for i, t in truth.items() if not t]
    assert sum(i in ids for i in clean) / len(clean) > 0.9


def test_rows_are_judged_by_their_own_text(frames, spark):
    docs, labels, truth = frames
    bad = next(r["text"] for r in docs.collect() if truth.get(r["doc_id"]))
    calm = next(r["text"] for r in docs.collect() if truth.get(r["doc_id"]) == 0)
    rows = [(7, bad, "a"), (7, calm, "b"), (None, bad, "c"), (None, calm, "d"), (None, None, "e"), (8, "", "f")]
    model = toxicity.fit(docs, labels)
    kept = model.clean(spark.createDataFrame(rows, "doc_id long, text string, features string"))
    assert kept.columns == ["doc_id", "text", "features"]
    assert sorted(r["features"] for r in kept.collect()) == ["b", "d", "e", "f"]


def test_calibration_is_linear_between_boundaries(spark):
    import numpy as np

    bounds, levels = np.array([0.1, 0.3, 0.3, 0.8]), np.array([0.0, 0.2, 0.4, 1.0])
    frame = spark.createDataFrame([(v / 100,) for v in range(0, 101, 5)], "v double")
    from pyspark.sql import functions as F

    for r in frame.select("v", toxicity._steps(F.col("v"), bounds, levels).alias("s")).collect():
        if abs(r["v"] - 0.3) > 1e-9:
            assert abs(r["s"] - np.interp(r["v"], bounds, levels)) < 1e-12


def test_obfuscated_words():
    assert list(toxicity.words_of("s.t.u.p.i.d Id1ot! l'eau 12 a-b")) == [
        ("stupid", True), ("idiot", True), ("l", False), ("eau", False), ("a", False), ("b", False)]
