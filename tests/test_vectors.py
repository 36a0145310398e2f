"""Nearest vectors against a full scan, on clustered data with copies and zero vectors."""

import math
import random

import pytest

from pyspark.sql import functions as F

from charlascope.operators import vectors
from charlascope.operators.vectors import nearest_vectors


@pytest.mark.parametrize(("k", "pivots", "part_rows"), [(5, 8, 10_000), (12, 5, 7), (400, 3, 50)])
def test_nearest_equals_full_scan(spark, k, pivots, part_rows):
    rng = random.Random(k)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(6)]
    corpus = []
    for i in range(240):
        base = rng.choice(centers)
        v = [x + rng.gauss(0, 0.05) for x in base] if i % 3 else list(centers[0])
        corpus.append((i, i % 4, [0.0] * 6 if i == 10 else v))
    queries = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centers)]) for i in range(40)] + [(99, [0.0] * 6)]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    expected = {}
    for q, a in queries:
        if norm(a):
            unit = [x / norm(a) for x in a]
            cosine = lambda b: sum(x * (y / norm(b)) for x, y in zip(unit, b))
            sims = [(-math.floor(cosine(b) * 1e10 + 0.5), i) for i, _, b in corpus if norm(b)]
            expected[q] = sorted(sims)[:k]
    got = {}
    frame = nearest_vectors(
        spark.createDataFrame(queries, "query_id bigint, embedding array<double>"),
        spark.createDataFrame(corpus, "vec_id bigint, label int, embedding array<double>"),
        k, pivots, part_rows,
    )
    for r in frame.collect():
        got.setdefault(r.query_id, []).append((-round(r.sim * 1e10), r.vec_id))
    assert {q: sorted(rows) for q, rows in got.items()} == expected


def clustered(spark, rows, clusters):
    """Vectors close around few directions, a third of them copies of one."""
    rng = random.Random(rows)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(clusters)]
    corpus = [
        (i, i % 3, [x + rng.gauss(0, 0.02) for x in centers[i % clusters]] if i % 3 else list(centers[0])) for i in range(rows)
    ]
    return spark.createDataFrame(corpus, "vec_id bigint, label int, embedding array<double>")


def test_cells_grow_and_most_are_out_of_reach(spark):
    corpus = clustered(spark, 6000, 40).cache()
    cells, placed = vectors.build_cells(corpus)
    assert len(cells.centers) == math.isqrt(6000) and cells.sizes.sum() == 6000
    assert len(vectors.build_cells(corpus.limit(300))[0].centers) == vectors.PIVOTS
    queries = corpus.filter(F.col("vec_id") % 30 == 1).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = queries.select("query_id", vectors._unit(F.col("embedding")).alias("q"))
    first = vectors.first_visits(cells, asked, 10)
    near = nearest_vectors(queries, corpus, 10)
    later = vectors.later_visits(cells, asked, near, 10)
    met = sum(cells.sizes[r.cell] for r in first.unionByName(later).select("cell").collect())
    assert met < 0.1 * queries.count() * 6000
    pairs = queries.crossJoin(corpus.select("vec_id", F.col("embedding").alias("e")))
    unit = vectors._unit
    sims = pairs.select("query_id", "vec_id", vectors._dot(unit(F.col("embedding")), unit(F.col("e"))).alias("sim"))
    best = {}
    for r in sims.collect():
        best.setdefault(r.query_id, []).append((-math.floor(r.sim * 1e10 + 0.5), r.vec_id))
    got = {}
    for r in near.collect():
        got.setdefault(r.query_id, []).append((-round(r.sim * 1e10), r.vec_id))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v)[:10] for q, v in best.items()}


def test_no_directions(spark):
    corpus = spark.createDataFrame([(1, 0, [0.0, 0.0])], "vec_id bigint, label int, embedding array<double>")
    queries = corpus.select(F.col("vec_id").alias("query_id"), "embedding")
    assert nearest_vectors(queries, corpus).count() == 0


def test_a_query_takes_at_most_k_vectors_from_a_part(spark):
    corpus = clustered(spark, 900, 3).cache()
    cells, placed = vectors.build_cells(corpus, 4, 100)
    asked = corpus.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), vectors._unit(F.col("embedding")).alias("q"))
    visits = vectors.first_visits(cells, asked, 50).cache()
    assert vectors._meet(visits, placed, 7).count() <= 7 * visits.count()
