"""Rounding against the language's own, which goes by the binary value."""

import math
import random

import pytest

from charlascope.functions.numbers import round_half_even


@pytest.mark.parametrize("digits", [1, 2])
def test_rounds_by_binary_value(spark, digits):
    rng = random.Random(7)
    values = [0.985, 0.575, 0.125, 0.375, 0.625, 0.875, 0.005, 0.015, 1.005, 2.675, 0.0, 1.0, 5e-324, 85.125, 12345.675]
    values += [k / 2000 for k in range(4001)] + [rng.random() for _ in range(2000)]
    values += [rng.random() * 10.0 ** rng.randrange(-8, 19) for _ in range(2000)]
    values += [math.nextafter(k / 200, up) for k in range(1, 400) for up in (0.0, 1e9)]
    values += [-v for v in values]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for row in frame.select("v", round_half_even(frame.v, digits).alias("r")).collect():
        assert row.r == round(row.v, digits), row.v


def test_values_without_a_rounding_stay(spark):
    frame = spark.createDataFrame([(math.inf,), (-math.inf,), (None,), (math.nan,), (1.5e300,)], "v double")
    out = [r[0] for r in frame.select(round_half_even(frame.v)).collect()]
    assert out[:3] == [math.inf, -math.inf, None] and math.isnan(out[3]) and out[4] == 1.5e300


def test_stated_cases(spark):
    frame = spark.createDataFrame([(0.985,), (0.575,), (0.125,)], "v double")
    assert [r[0] for r in frame.select(round_half_even(frame.v)).collect()] == [0.98, 0.57, 0.12]
