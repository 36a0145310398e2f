import random

import pytest

import corpus_pipeline
from charlascope.llm import toxicity
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    rng = random.Random(20)
    words = ["".join(rng.choice("aeioudglmnrst") for _ in range(rng.randrange(3, 9))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(20)) for i in range(5)]
    boilerplate = say(14)
    rows, labels = [], []
    for i in range(300):
        parts = [say(rng.randrange(5, 60)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.3:
            parts.append(boilerplate)
        if rng.random() < 0.1:
            parts.append(f"{say(30)} {rng.choice(items)[1]} {say(30)}")
        toxic = rng.random() < 0.2
        if toxic:
            parts.append("grobian mufti " + say(4))
        text = "\n".join(parts)
        if i and rng.random() < 0.1:
            text = rows[rng.randrange(i)][1]
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int("grobian" in text), 1))
    rows += [(900, None, "en", None, None), (901, "", None, None, 0), (902, say(5000), "en", "s", None)]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, items


def test_every_stage_against_brute_force(spark, folder, tmp_path):
    sf_dir, rows, items = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else None
        if name == "toxicity":
            assert not any("grobian" in (t or "") for t in after.values())
            clean = [i for i, t in before.items() if "grobian" not in (t or "")]
            assert sum(i in after for i in clean) > 0.97 * len(clean)
            assert all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            assert after == brute_lines(list(before.items()))
        elif name == "near_dedup":
            prints = {i: brute_fingerprint(t) for i, t in before.items()}
            root = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
            assert after == {i: before[i] for i in before if root[i] == i}
        elif name == "decontamination":
            assert not any(item in (t or "") for t in after.values() for _, item in items)
            untouched = [i for i, t in before.items() if not any(item in (t or "") for _, item in items)]
            assert all(after[i] == before[i] for i in untouched)
            lengths = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
            assert all(lengths[i] == (None if t is None else len(t)) for i, t in after.items())
        else:
            total = {r["doc_id"]: r["doc_tokens"] for r in docs.collect()}
            placed = dict.fromkeys(total, 0)
            for r in docs.collect():
                placed[r["doc_id"]] += r["length"]
            assert placed == total and set(total) == set(before)


def test_run_equals_its_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
    placed = lambda rows: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows)
    assert placed(out.collect()) == placed(docs.collect())
    assert toxicity.THRESHOLD == 0.3


def test_null_and_repeated_ids_clashing_columns_and_no_rows(spark, folder):
    sf_dir, rows, _ = folder
    more = [(None, "grobian mufti grobian", "en", "a", 1), (None, None, "en", "b", 1), (3, "short text here", "en", "c", 1)]
    docs = spark.createDataFrame(rows + more, DOCS)
    for extra in ("row", "features", "hash", "fp", "uid"):
        docs = docs.withColumn(extra, docs["doc_id"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert all(r["row"] == r["doc_id"] == r["fp"] for r in docs.collect()), name
    kept = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert (3, "short text here") in kept and not any("grobian" in (t or "") for _, t in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
