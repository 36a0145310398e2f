import numpy as np
import pytest

from charlascope.llm import neighbours

VECTORS = "vec_id long, embedding array<float>, label int, shard string"


def brute(rows, k=5, modulus=50):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, a in good:
        if q % modulus == 0:
            scores = [(-float(a @ b / np.sqrt((a @ a) * (b @ b))), i) for i, b in good if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scores)[:k]]
    return out


def recall(out, expected):
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q, best in expected.items():
        rows = sorted(found.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1))
        assert all(r["score"] >= s["score"] for r, s in zip(rows, rows[1:]))
        hits += len({r["vec_id"] for r in rows} & {i for i, _ in best})
        total += len(best)
    return hits / total


@pytest.mark.parametrize("shape", ["spread", "clusters", "copies"])
def test_recall(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    if shape == "clusters":
        x = x * 0.1 + rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)]
    if shape == "copies":
        x[rng.random(3000) < 0.4] = x[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], VECTORS)
    out = neighbours.nearest(frame).collect()
    assert recall(out, brute(rows)) > 0.95


def test_small_and_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (3, [1.0, 0.1]), (2, [1.0, 0.1]), (4, None), (5, [0.0, 0.0]), (100, [float("nan"), 1.0]),
            (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [-1.0, 0.0]), (150, [1.0, 2.0, 3.0]), (9, [])]
    frame = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], VECTORS)
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(frame).collect())
    assert out == [(0, 1, 2), (0, 2, 3), (0, 3, 50), (0, 4, 8), (50, 1, 2), (50, 2, 3), (50, 3, 0), (50, 4, 8)]
    assert neighbours.nearest(frame.limit(0)).count() == 0


def test_graph_survives_storage():
    rng = np.random.default_rng(1)
    x = neighbours._unit(rng.normal(size=(400, 8)))
    graph = neighbours.Graph(x)
    neighbours_, ends = graph.flat()
    again = neighbours.Graph.of(x, graph.levels, neighbours_, ends, graph.entry)
    for q in x[::37]:
        assert sorted(graph.nearest(q, 10)) == sorted(again.nearest(q, 10))
