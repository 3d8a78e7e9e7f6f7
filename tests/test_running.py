"""Running values and filled gaps against plain loops, and plans that never bring a series into one task."""

import random

import pytest
from pyspark.sql import functions as F

from tallyward.operators import drift, forecast
from tallyward.operators.running import running
from tallyward.sources import ledger


def series_of(n, seed):
    own = random.Random(seed)
    return [(k, None if own.random() < 0.3 else own.randrange(100), None if own.random() < 0.6 else f"s{k}") for k in own.sample(range(10 * n + 1), n)]


@pytest.mark.parametrize("n,ranges", [(0, 4), (1, 4), (3, 7), (200, 1), (200, 13)])
def test_running_values(spark, n, ranges):
    rows = series_of(n, n + ranges)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        df = spark.createDataFrame(rows, "k int, v int, s string")
        got = running(df, "k", sums={"total": F.col("v"), "t": F.lit(1)}, before={"prior": F.col("v")}, last_before={"held": F.col("s")}).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total, t, prior, held, expected = None, 0, None, None, []
    for k, v, s in sorted(rows):
        total, t = (total if v is None else (total or 0) + v), t + 1
        expected.append((k, v, s, total, t, prior, held))
        prior, held = v, s if s is not None else held
    assert [tuple(r) for r in got] == expected


def test_null_order_value_comes_first(spark):
    got = running(spark.createDataFrame([(2, 5), (None, 7), (1, 1)], "k int, v int"), "k", sums={"total": F.col("v")}, before={"prior": F.col("v")})
    assert sorted((r.total, r.prior) for r in got.collect() if r.prior is not None) == [(8, 7), (13, 1)]


def test_no_series_meets_in_one_task(spark):
    totals = spark.createDataFrame([(f"r{k}", float(k), 0.1 * k) for k in range(30)], "run_id string, y double, mape double")
    events = totals.select("run_id", F.lit("drift_monitoring").alias("step"), F.lit("COMPLETE").alias("status"))
    forecasts = totals.select("run_id", F.col("y").alias("predicted_total"))
    for df in (
        forecast.expanding_forecast(totals, "run_id", "y"), drift.accuracy_decay(totals), ledger.reference_runs(events),
        forecast.spikes(forecasts), drift.run_pairs(totals), forecast.with_index(totals.select("run_id"), "run_id"),
    ):
        df.collect()
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_gaps_are_filled_without_a_grid(spark):
    own = random.Random(2)
    rows = [(own.choice("abcd"), own.randrange(40), own.choice([0, 0, 5, 9])) for _ in range(60)] + [("e", 3, 0), ("f", 39, 4), (None, 7, 6)]
    df = spark.createDataFrame(rows, "g string, p int, v long")
    periods = sorted({p for _, p, _ in rows})
    total = {}
    for g, p, v in rows:
        total[g, p] = total.get((g, p), 0) + v
    full = {(g, p, total.get((g, p), 0)) for g in {g for g, _, _ in rows} for p in periods}
    got = forecast.densify(df, "p", "g", "v").collect()
    assert {(r.g, r.p, r.v) for r in got} == full and len(got) == len(full)
    assert all(periods[r.t - 1] == r.p for r in got)
    start = {g: min((p for (h, p), v in total.items() if h == g and v > 0), default=99) for g in {g for g, _, _ in rows}}
    trimmed = forecast.densify(df, "p", "g", "v", trim=True)
    assert {(r.g, r.p, r.v) for r in trimmed.collect()} == {x for x in full if x[1] >= start[x[0]]}
    placed = forecast.active_history(trimmed, "g", "v").collect()
    assert all(r.active_t == periods.index(r.p) - periods.index(start[r.g]) + 1 for r in placed)
