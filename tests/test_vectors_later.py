"""Queries that reach many cells are not repeated in each of them."""

import random

from pyspark.sql import functions as F

from charlascope.operators import vectors


def test_vectors_are_dealt_once_a_share_and_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i if i % 50 else i // 2, i % 3, [rng.gauss(0, 1) for _ in range(12)]) for i in range(700)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").cache()
    cells, placed = vectors.build_cells(corpus, 20, 30)
    asked = corpus.select(F.col("vec_id").alias("query_id"), vectors._unit(F.col("embedding")).alias("q")).dropDuplicates(["query_id"])
    near = vectors._meet(vectors.first_visits(cells, asked, 9), placed, 9).cache()
    visits = vectors.later_visits(cells, asked, near, 9)
    assert visits.count() > 10 * asked.count()
    best = vectors.Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id", "label")
    top = lambda pairs: pairs.withColumn("r", F.row_number().over(best)).filter("r <= 9").collect()
    expected = top(near.unionByName(vectors._meet(visits, placed, 9)))
    bounded = vectors.reached(asked, near, 9)
    for share_bytes in (vectors.SHARE_BYTES, 20_000):
        monkeypatch.setattr(vectors, "SHARE_BYTES", share_bytes)
        later = vectors._meet_all(cells, bounded, placed, 9)
        assert sorted(top(near.unionByName(later))) == sorted(expected)
        assert later.count() <= 9 * asked.count()
