import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyward.functions.tails import upper_gamma
from tallyward.operators import drift, forecast


def psi_by_hand(ref, cur):
    ref, cur = ref[np.isfinite(ref)], cur[np.isfinite(cur)]
    if not len(ref) or not len(cur):
        return 0.0
    edges = np.percentile(ref, np.arange(10, 100, 10))
    r = np.bincount((ref[:, None] >= edges).sum(axis=1), minlength=10) / len(ref)
    c = np.bincount((cur[:, None] >= edges).sum(axis=1), minlength=10) / len(cur)
    r, c = np.where(r == 0, 1e-4, r), np.where(c == 0, 1e-4, c)
    return float(((c - r) * np.log(c / r)).sum())


def test_psi_of_like_and_unlike_samples(spark, path_taken):
    rng = np.random.default_rng(42)
    ref, like, unlike = rng.normal(100, 15, 1000), rng.normal(100, 15, 1000), rng.normal(150, 25, 1000)

    def frame(x):
        return spark.createDataFrame(pd.DataFrame({"x": x}))

    near = drift.psi_between(frame(like), frame(ref), ["x"]).first()["psi"]
    far = drift.psi_between(frame(unlike), frame(ref), ["x"]).first()["psi"]
    assert near < 0.1 and far > 2.0
    assert near == pytest.approx(psi_by_hand(ref, like), rel=1e-9)
    assert far == pytest.approx(psi_by_hand(ref, unlike), rel=1e-9)


def test_psi_over_runs_with_ties_gaps_and_empty_runs(spark, path_taken):
    rng = np.random.default_rng(3)
    parts = {
        "r1": rng.integers(0, 4, 300).astype(float), "r2": rng.integers(0, 9, 500).astype(float),
        "r3": np.full(40, np.nan), "r4": np.concatenate([rng.integers(2, 5, 90), [np.inf]]).astype(float),
    }
    rows = [(k, None if math.isnan(v) else float(v)) for k, x in parts.items() for v in x]
    df = spark.createDataFrame(rows, "run_id string, x double")
    got = {r["run_id"]: r["psi"] for r in drift.psi(df, ["x"]).collect()}
    runs = list(parts)
    assert set(got) == {"r2", "r3", "r4"}
    for before, now in zip(runs, runs[1:]):
        assert got[now] == pytest.approx(psi_by_hand(parts[before], parts[now]), rel=1e-9, abs=1e-12)


def test_severity_bounds(spark):
    df = spark.createDataFrame([("a", 0.09), ("b", 0.1), ("c", 0.25), ("d", 0.2501)], "run_id string, psi double")
    got = {r["run_id"]: r["overall_severity"] for r in drift.severity_by_run(df).collect()}
    assert got == {"a": "No Drift", "b": "Moderate Drift", "c": "Moderate Drift", "d": "Significant Drift"}


def test_gamma_tail_closed_forms():
    for x in (0.1, 1.0, 3.3, 12.0, 50.0):
        assert upper_gamma(0.5, x / 2) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert upper_gamma(1.0, x / 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert upper_gamma(2.0, x / 2) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)


def test_chi_squared_two_categories_are_corrected(spark):
    rows = [("a", "x")] * 30 + [("a", "y")] * 70 + [("b", "x")] * 45 + [("b", "y")] * 55
    df = spark.createDataFrame(rows, "run_id string, c string")
    line = drift.with_p_value(drift.chi_squared(df, ["c"])).first()
    table = np.array([[45, 55], [30, 70]]) + 1e-9
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    want = ((np.abs(table - expected) - 0.5) ** 2 / expected).sum()
    assert line["statistic"] == pytest.approx(want, rel=1e-9) and line["dof"] == 1
    assert line["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)), rel=1e-9)


def test_chi_squared_needs_two_categories_and_both_sides(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", "p"), ("b", "x", "q")], "run_id string, c string, d string")
    got = {r["column"]: (r["statistic"], r["p_value"]) for r in drift.with_p_value(drift.chi_squared(df, ["c", "d"])).collect()}
    assert got == {"c": (None, 1.0), "d": (None, 1.0)}


def test_policy_table(spark):
    cases = [
        (None, 50.0, "skipped — no drift", False), ("No Drift", 50.0, "skipped — no drift", False),
        ("Moderate Drift", 0.0, "threshold_recalibration", False), ("Moderate Drift", 20.5, "full_retrain", True),
        ("Significant Drift", 0.0, "full_retrain", True),
    ]
    df = spark.createDataFrame([(str(i), s, d) for i, (s, d, *_) in enumerate(cases)], "run_id string, overall_severity string, accuracy_decay_pct double")
    got = [(r["strategy_applied"], r["retrain_triggered"]) for r in drift.drift_policy(df).orderBy("run_id").collect()]
    assert got == [(c[2], c[3]) for c in cases]


def test_overtime_names_match_whole_parts(spark):
    df = spark.createDataFrame([("total_working_days",), ("ot_rate",), ("robust_z_overtime_hours",)], "n string")
    strict = [r[0] for r in df.select(drift.is_overtime_column(F.col("n"))).collect()]
    loose = [r[0] for r in df.select(drift.is_overtime_column(F.col("n"), loose=True)).collect()]
    assert strict == [False, True, True] and loose == [True, True, True]


def test_short_series(spark):
    df = spark.createDataFrame([("a", 1, 50.0), ("b", 1, 10.0), ("b", 2, 4.0), ("c", 1, 9.0), ("c", 2, 1.0)], "g string, t int, y double")
    got = {r["g"]: r["prediction"] for r in forecast.trend_next(df, "y", ["g"]).collect()}
    assert got["a"] == 50.0 and got["b"] == 0.0 and got["c"] == 0.0


def test_growth_guards(spark):
    df = spark.createDataFrame(
        [("up", 1, 100.0), ("up", 3, 121.0), ("up", 2, 0.0), ("zero", 1, 0.0), ("zero", 2, 5.0), ("one", 1, 5.0)], "g string, t int, y double"
    )
    got = {r["g"]: r["growth"] for r in forecast.growth_rate(df, "y", ["g"]).collect()}
    assert got["up"] == pytest.approx(0.1) and got["zero"] == 0.0 and got["one"] == 0.0


def test_sparse_group_forecast_equals_the_dense_one(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{p:02d}", f"g{g}", float(rng.integers(1, 1000))) for g in range(40) for p in range(12)
            if p >= rng.integers(0, 12) and (rng.random() < 0.7 or p == 11)]
    rows += [("p11", "Unknown", 5.0), ("p11", None, 5.0)]
    pdf = pd.DataFrame(rows, columns=["p", "g", "y"])
    got = {r["g"]: (r["active_periods"], r["prediction"])
           for r in forecast.group_forecast(spark.createDataFrame(rows, "p string, g string, y double"), "p", "g", "y").collect()}
    periods = sorted(pdf.p.unique())
    totals = pdf.groupby("p").y.sum()
    growth = (totals.iloc[-1] / totals.iloc[0]) ** (1 / (len(periods) - 1)) - 1
    want = {}
    for g, part in pdf[pdf.g.notna() & (pdf.g != "Unknown")].groupby("g"):
        series = part.groupby("p").y.sum().reindex(periods, fill_value=0.0).to_numpy()
        if series[-1] == 0:
            continue
        active = series[np.flatnonzero(series > 0)[0]:]
        if len(active) >= 3:
            t = np.arange(1, len(active) + 1)
            b, a = np.polyfit(t, active, 1)
            guess = a + b * (len(active) + 1)
        else:
            guess = active[-1] * (1 + growth)
        want[g] = (len(active), max(0.0, guess))
    assert set(got) == set(want)
    for g in want:
        assert got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1], rel=1e-9, abs=1e-6)


def fit(t, y):
    if len(t) < 2:
        return 0.0, float(y.mean())
    b, a = np.polyfit(t, y, 1)
    return b, a


@pytest.mark.parametrize("n", [2, 4, 5, 9, 49])
def test_regression_cv_matches_refitting(spark, n):
    rng = np.random.default_rng(n)
    t, y = np.arange(1, n + 1), rng.normal(1000, 80, n)
    df = spark.createDataFrame([("s", int(a), float(b)) for a, b in zip(t, y)], "k string, t int, y double")
    got = forecast.regression_cv(df, "y", ["k"]).first()
    if n < 5:
        b, a = fit(t, y)
        miss = y - (a + b * t)
        want = (np.mean(np.abs(miss / y)), np.sqrt(np.mean(miss**2)), 1.0)
    else:
        miss = np.empty(n)
        for i in range(n):
            b, a = fit(np.delete(t, i), np.delete(y, i))
            miss[i] = y[i] - (a + b * t[i])
        want = (np.mean(np.abs(miss / y)), np.mean(np.abs(miss)), 1 - np.std(np.abs(miss / y)))
    np.testing.assert_allclose((got["mape"], got["rmse"], got["stability_score"]), want, rtol=1e-7, atol=1e-7)


def test_regression_folds_are_even(spark):
    df = spark.createDataFrame([("s", i, float(i * 3)) for i in range(1, 73)], "k string, t int, y double")
    got = forecast.regression_cv(df, "y", ["k"]).first()
    assert got["mape"] == pytest.approx(0.0, abs=1e-9) and got["stability_score"] == pytest.approx(1.0)


def test_previous_severity_lifts_the_forecast(spark):
    totals = spark.createDataFrame([("r1", 100.0), ("r2", 110.0), ("r3", 120.0)], "run_id string, y double")
    levels = spark.createDataFrame([("r2", "Significant Drift"), ("r1", "Moderate Drift"), ("r3", "No Drift")], "run_id string, overall_severity string")
    out = forecast.adjusted(forecast.expanding_forecast(totals, "run_id", "y"), levels).orderBy("run_id").collect()
    assert [r["drift_multiplier"] for r in out] == [1.0, 1.05, 1.1]
    assert out[2]["predicted_total"] == pytest.approx(130 * 1.1)


def test_spike_uses_the_last_known_total(spark):
    df = spark.createDataFrame([("r1", 100.0, None), ("r2", 125.0, 200.0), ("r3", 241.0, None)], "run_id string, predicted_total double, actual_total double")
    got = {r["run_id"]: (r["prior_total"], r["is_spike"]) for r in forecast.spikes(df).collect()}
    assert got == {"r1": (None, False), "r2": (100.0, True), "r3": (200.0, True)}


def test_group_models_are_made_and_judged_per_group(spark):
    """Groups below three periods have no model; a group without a champion is promoted, others by their own error."""
    rows = [(g, t, 10.0 * t + bump * (t % 2)) for g, n, bump in (("a", 6, 0), ("b", 6, 25), ("c", 2, 0), ("d", 4, 1)) for t in range(1, n + 1)]
    series = spark.createDataFrame(rows, "g string, t int, y double")
    standing = spark.createDataFrame([("a", 0.5), ("b", 0.01)], "g string, standing double")
    got = {r.g: r for r in forecast.group_models(series, "y", "g", standing).collect()}
    assert set(got) == {"a", "b", "d"}
    assert got["a"].slope == pytest.approx(10) and got["a"].mape == pytest.approx(0, abs=1e-9) and got["a"].prediction == pytest.approx(70)
    assert got["a"].promoted and not got["b"].promoted and got["d"].promoted and got["d"].champion is None
    alone = {r.g: r for r in forecast.group_models(series.where("g = 'b'"), "y", "g").collect()}
    assert alone["b"].mape == got["b"].mape
