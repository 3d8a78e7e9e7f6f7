import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyward.operators import quantiles as Q
from tallyward.operators.settling import Size

LARGE = Size(10**12)


def test_interval_keeps_order(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate(
        [rng.normal(0, 10.0**k, 400) for k in range(-8, 12)]
        + [[0.0, -0.0, 1.0, 2.0, 4.0, np.nextafter(2.0, 0), 1e-320, -1e-320, 1e300, -1e300], 2.0 ** np.arange(-40, 40)]
    )
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out = df.select("x", Q.interval(F.col("x"), 10).alias("a"), Q.interval(F.col("x"), 24).alias("b")).toPandas()
    out = out.sort_values("x")
    assert (np.diff(out["a"]) >= 0).all() and (np.diff(out["b"]) >= 0).all()


@pytest.mark.parametrize("interval_rows", [1, 1_000_000])
def test_matches_numpy_with_a_hot_group(spark, interval_rows):
    rng = np.random.default_rng(2)
    n = 6000
    group = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 20, n).astype(str))
    x = np.where(rng.random(n) < 0.3, 7.0, rng.normal(-5, 1000, n))
    y = rng.integers(0, 30, n).astype(float)
    pdf = pd.DataFrame({"g": group, "x": x, "y": y})
    df = spark.createDataFrame(pdf).repartition(7)
    fractions = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    out = Q.exact_quantiles(df, ["g"], ["x", "y"], fractions, LARGE, interval_rows).collect()
    assert len(out) == 2 * pdf["g"].nunique()
    for r in out:
        part = pdf.loc[pdf["g"] == r["g"], r["column"]]
        assert r["n"] == len(part)
        np.testing.assert_allclose(r["quantiles"], np.percentile(part, np.array(fractions) * 100), rtol=1e-12, atol=1e-9)


def test_missing_and_infinite_values_are_left_out(spark, path_taken):
    data = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", float("inf")), ("a", 3.0), ("b", None)]
    df = spark.createDataFrame(data, "g string, x double")
    out = Q.exact_quantiles(df, ["g"], ["x"], [0.5]).collect()
    assert [(r["g"], r["n"], list(r["quantiles"])) for r in out] == [("a", 2, [2.0])]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False) | st.integers(-3, 3).map(float), min_size=1, max_size=40))
def test_any_values(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "g int, x double")
    out = Q.exact_quantiles(df, ["g"], ["x"], [0.1, 0.5, 0.77], LARGE).first()["quantiles"]
    np.testing.assert_allclose(out, np.percentile(values, [10, 50, 77]), rtol=1e-9, atol=1e-6)


def test_row_pass_does_not_shuffle_rows(spark):
    """Only interval counts and the values of wanted intervals leave the tasks."""
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5).alias("x"))
    df = df.repartition(4).cache()
    out = Q.exact_quantiles(df, ["g"], ["x"], [0.5], LARGE)
    plan = out._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    df.unpersist()
