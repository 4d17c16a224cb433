"""Exact rounding and NaN rules against CPython."""

import math
import random

import pytest
from panelwright.functions import numeric as N
from pyspark.sql import functions as F


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("places", [0, 1, 2, 4])
def test_rounding_matches_cpython(spark, places):
    rng = random.Random(places)
    values = [k / 1000 * 1.5 for k in range(-3000, 20000)]
    values += [rng.uniform(-1e3, 1e3) for _ in range(5000)] + [rng.randint(-10**6, 10**6) / 10 ** (places + 1) * 5 for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", N.py_round(F.col("x"), places).alias("r"))
    wrong = [(r.x, r.r) for r in df.collect() if r.r != round(r.x, places)]
    assert not wrong


def test_special_values_pass(spark):
    values = [None, math.nan, math.inf, -math.inf, 0.0, 2.675, 0.125, 0.375]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", N.py_round(F.col("x"), 2).alias("r"), N.finite(F.col("x")).alias("f")).orderBy("i").collect()
    want = [None, math.nan, math.inf, -math.inf, 0.0, 2.67, 0.12, 0.38]
    assert all(same(g.r, w) for g, w in zip(got, want))
    assert [g.f for g in got] == [False, False, False, False, True, True, True, True]


def test_nan_in_comparisons(spark):
    pairs = [(0.0, math.nan), (math.nan, 0.0), (1.0, 2.0), (2.0, 1.0), (math.nan, math.nan), (None, 1.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double")
    got = df.select("i", N.larger(F.col("a"), F.col("b")).alias("hi"), N.smaller(F.col("a"), F.col("b")).alias("lo"), N.at_least(F.col("a"), 0.0).alias("g"), N.more_than(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()
    for g, (a, b) in zip(got, pairs):
        if a is not None:
            assert same(g.hi, max(a, b)) and same(g.lo, min(a, b)) and g.g == (a >= 0.0) and g.m == (a > b)
    assert got[5].hi is None


@pytest.mark.parametrize("x", [-50.0, 0.0, 33.33, 100.0, 250.0, math.nan])
def test_clamp_and_modulo(spark, x):
    r = spark.createDataFrame([(x,)], "x double").select(N.clamp(F.col("x"), 0.0, 100.0).alias("c"), N.floor_mod(F.col("x"), 24.0).alias("m")).first()
    assert same(r.c, min(max(x, 0.0), 100.0))
    assert math.isnan(x) or r.m == x % 24.0


def test_text_of_numbers(spark):
    values = [12.25, 20.5, 21.5, 0.125, 99.95, 888.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", N.fixed(F.col("x"), 1).alias("a"), N.fixed(F.col("x"), 0).alias("b"), N.percent(F.col("x"), 1).alias("p")).collect()
    for r in got:
        assert (r.a, r.b) == (f"{r.x:.1f}", f"{r.x:.0f}") and r.p == f"{r.x:.1%}"


def test_significant_digits(spark):
    """Like C's %g on ties, powers of ten, whole numbers, tiny and huge ones."""
    rng = random.Random(5)
    values = [0.0, -0.0, 1.0, -10.0, 999999.5, 9999.5, 99995.0, 0.0001, 0.00001, 0.00012345, 0.15, 2.5, 12345.5, 0.99995, 0.999995, 1e300, -1e300, 1e-300, 1e22, 1e23, math.inf, -math.inf, math.nan]
    values += [float(10.0**k) for k in range(-300, 301, 7)] + [rng.randrange(10**7) / 10 ** rng.randrange(12) for _ in range(1500)] + [(2 * rng.randrange(10**5) + 1) / 2 ** rng.randrange(12) for _ in range(1500)]
    values += [float((rng.randrange(10**6) * 10 + 5) * 10 ** rng.randrange(8)) for _ in range(1500)] + [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-290, 290) for _ in range(1500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for r in df.select("i", N.significant(F.col("x"), 4).alias("four"), N.significant(F.col("x"), 6).alias("six"), N.significant(F.col("x"), 1).alias("one")).collect():
        x = values[r.i]
        assert (r.one, r.four, r.six) == (f"{x:.1g}", f"{x:.4g}", f"{x:g}"), x
    assert spark.createDataFrame([(None,)], "x double").select(N.significant(F.col("x"), 4)).first()[0] is None
