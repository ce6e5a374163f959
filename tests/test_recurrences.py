"""Recurrences in the JVM against plain loops."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import indicators, trend

WEEKLY = "symbol_id int, week_end_date date, high double, low double, close double"
DAY = dt.date


def bars(n, symbol, seed):
    rng = random.Random(seed)
    x, out = 100.0, []
    for i in range(n):
        x *= 1 + rng.uniform(-0.06, 0.06)
        out.append((symbol, DAY(1990, 1, 5) + dt.timedelta(weeks=i), x * (1 + rng.random() / 20), x * (1 - rng.random() / 20), x))
    return out


def by_loop(rows, period=7, multiplier=3.0, state=None):
    return trend.run_bands([r[1:] for r in rows], state or trend.Bands(), period, multiplier)


@pytest.fixture(scope="module")
def many():
    return {s: bars(n, s, s) for s, n in ((1, 500), (2, 129), (3, 128), (4, 7), (5, 6), (6, 1), (7, 300))}


def frame(spark, many):
    return spark.createDataFrame([r for rows in many.values() for r in rows], WEEKLY).repartition(5)


def python_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(word in plan for word in ("Python", "Pandas", "ArrowEval"))


@pytest.mark.parametrize(("period", "multiplier"), [(7, 3.0), (1, 1.0), (10, 2.5)])
def test_the_fold_is_the_loop_to_the_last_bit(spark, many, period, multiplier):
    got = trend.trend(frame(spark, many), period, multiplier)
    assert python_free(got)
    rows = sorted((r.symbol_id, *tuple(r)[1:]) for r in got.collect())
    assert rows == sorted((s, *r) for s, b in many.items() for r in by_loop(b, period, multiplier))


@pytest.mark.parametrize("split", [3, 7, 60, 128, 299])
def test_from_any_state_as_from_scratch(spark, many, split):
    head = {s: b[:split] for s, b in many.items()}
    tail = {s: b[split:] for s, b in many.items() if b[split:]}
    start = trend.fold(frame(spark, head)).select("symbol_id", F.col("state").alias("s"))
    got = trend.fold(frame(spark, tail), start).select("symbol_id", F.inline("rows"))
    want = [(s, *r) for s, b in tail.items() for r in by_loop(many[s]) if r[0] >= b[0][1]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_states_are_those_of_the_loop(spark, many):
    for r in trend.fold(frame(spark, many)).collect():
        state = trend.Bands()
        by_loop(many[r.symbol_id], state=state)
        want = [None if isinstance(v, float) and v != v else v for v in trend.as_tuple(state)]
        assert list(r.state) == want


@pytest.mark.parametrize(("alpha", "least", "missing"), [(1 / 14, 14, 0.0), (0.5, 1, 0.0), (0.5, 3, 0.3), (1 / 14, 1, 0.97), (0.9, 1, 0.5), (0.01, 1, 0.1)])
def test_recursive_means_are_those_of_the_loop(spark, alpha, least, missing):
    rng = np.random.default_rng(1)
    rows = []
    for key, n in (("a", 2_500), ("b", 60), ("c", 1)):
        x = rng.normal(5, 2, n)
        x[rng.random(n) < missing] = np.nan
        if key == "b":
            x[:] = np.nan if missing > 0.9 else x
        if n > 2_000:
            x[900:1_800] = np.nan  # a gap over which all decays
        rows += [(key, i, None if v != v else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(3)
    got = indicators.ewm(df, "k", "i", "x", "y", alpha, least)
    assert python_free(got)
    pdf = got.toPandas().sort_values(["k", "i"], ignore_index=True)
    want = pdf.groupby("k")["x"].transform(lambda v: v.ewm(alpha=alpha, adjust=False, min_periods=least).mean())
    pd.testing.assert_series_equal(pdf["y"], want, check_names=False, rtol=1e-9, atol=0)


def test_a_mean_has_one_shuffle_and_keeps_all_columns(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id", F.col("id").cast("double").alias("x"))
    out = indicators.ewm(df.withColumns({"s": F.lit("a"), "y": F.lit(9)}), "k", "id", "x", "y", 0.5)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert out.columns == ["k", "id", "x", "s", "y"] and out.where("s = 'a' and y <= x").count() == 100
