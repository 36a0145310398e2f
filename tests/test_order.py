import random

import pytest

from charlascope.operators.order import forward_fill, number_rows


@pytest.mark.parametrize("hot_rows", [10_000, 5])
def test_numbering_per_key_with_and_without_large_keys(spark, hot_rows):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab") if i % 2 else f"k{i % 40}", rng.random(), i) for i in range(600)]
    frame = spark.createDataFrame(rows, "k string, x double, i int").repartition(7)
    expected, seen = {}, {}
    for k, x, i in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        expected[i] = seen[k]
    got = number_rows(frame, ["x", "i"], keys=["k"], out="n", start=1, hot_rows=hot_rows)
    assert {r.i: r.n for r in got.collect()} == expected


def test_numbering_of_a_whole_table(spark):
    rows = [(i * 37 % 1001, i) for i in range(1001)]
    frame = spark.createDataFrame(rows, "x int, i int").repartition(9)
    got = {r.i: r.row_id for r in number_rows(frame, ["x"]).collect()}
    assert got == {i: x for x, i in rows}
    assert number_rows(frame.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("runs", [1, 7, 90])
def test_forward_fill_over_ranges_of_a_sparse_order(spark, runs):
    rng = random.Random(runs)
    places = sorted(rng.sample(range(-(10**12), 10**12), 300))
    rows = [(o, rng.choice([None, None, None, f"v{i}"]) if i > 5 else None, rng.choice([None, i]), f"t{i}") for i, o in enumerate(places)]
    expected, a, b = [], None, None
    for o, x, y, t in rows:
        a, b = x if x is not None else a, y if y is not None else b
        expected.append((o, a, b, t))
    frame = spark.createDataFrame(rows, "o bigint, a string, b int, text string").repartition(5)
    filled = forward_fill(frame, ["a", "b"], "o", runs)
    assert filled.columns == frame.columns
    assert sorted(map(tuple, filled.collect())) == expected
    narrow = forward_fill(frame.select("o", "a"), ["a"], "o", runs)
    assert sorted(map(tuple, narrow.collect())) == [e[:2] for e in expected]
    assert forward_fill(frame.limit(0), ["a", "b"], "o").count() == 0
