"""Growing order statistics against sorted copies of every prefix."""

import random

import pytest
from pyspark.sql import Window

from factlode.operators.expanding import OrderedValues, expanding_statistics


def middle2(values):
    n = len(values)
    return values[(n - 1) // 2] + values[n // 2]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_ordered_values(block):
    rng = random.Random(block)
    for kind in range(4):
        held, plain = OrderedValues(block), []
        for k in range(300):
            value = [rng.choice([-1.0, 0.0, 2.5]), rng.gauss(0, 1e9), float(k), float(-k)][kind]
            held.add(value)
            plain = sorted([*plain, value])
            assert len(held) == k + 1 and [held[i] for i in (0, k // 3, k)] == [plain[i] for i in (0, k // 3, k)]
            assert held.not_above(value) == sum(x <= value for x in plain) and held.not_above(value - 0.5) == sum(x <= value - 0.5 for x in plain)
            assert held.centre2() == middle2(plain)
            assert held.mad4(held.centre2()) == middle2(sorted(abs(x + x - middle2(plain)) for x in plain))


def test_series_of_all_lengths_in_one_pass(spark):
    rng = random.Random(5)
    rows = [(f"s{s}", k, rng.choice([1.0, 2.0, rng.gauss(0, 3)])) for s, n in enumerate([1, 2, 3, 40, 3_000]) for k in range(n)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "series string, at int, value double").repartition(5)
    got = expanding_statistics(frame, Window.partitionBy("series").orderBy("at"), "value")
    assert got.columns[:3] == ["series", "at", "value"]
    found = {(r["series"], r["at"]): r for r in got.collect()}
    assert len(found) == len(rows)
    by: dict = {}
    for s, k, x in sorted(rows):
        by.setdefault(s, []).append(x)
    for (s, k), r in found.items():
        if len(by[s]) > 100 and k % 97:
            continue
        seen = by[s][: k + 1]
        ordered = sorted(seen)
        centre2 = middle2(ordered)
        assert (r["sample_count"], r["centre2"], r["not_above"]) == (k + 1, centre2, sum(x <= seen[-1] for x in seen))
        assert r["mad4"] == middle2(sorted(abs(x + x - centre2) for x in seen))
        assert (r["previous"], r["before_previous"]) == ((seen[-2] if k else None), (seen[-3] if k > 1 else None))


def test_no_rows(spark):
    frame = spark.createDataFrame([], "series string, at int, value double")
    assert expanding_statistics(frame, Window.partitionBy("series").orderBy("at"), "value").collect() == []
