import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyward.operators import features, profile, quantiles, rules, schema, scoring
from tallyward.plans.adapters import pay_records

from .conftest import SMALL_TABLES


@pytest.fixture(scope="module")
def pay(spark):
    return pay_records(spark, SMALL_TABLES).cache()


def by_hand(pdf):
    """The features in plain pandas, one run at a time."""
    out = []
    for _, p in pdf.groupby("run_id"):
        p = p.copy()
        p["overtime_pay"] = p.overtime_hours * p.overtime_pay_per_hour
        p["earned_base"] = p.base_salary / p.total_working_days * p.present_days
        p["salary_diff"] = p.net_salary - (p.earned_base + p.overtime_pay)
        mean = p.groupby("designation").base_salary.transform("mean")
        p["salary_dev_pct"] = (p.base_salary - mean) / mean * 100
        for c in ("base_salary", "salary_dev_pct", "total_working_days"):
            mad = (p[c] - p[c].median()).abs().median()
            p[f"robust_z_{c}"] = 0.0 if mad == 0 else (p[c] - p[c].median()) / mad
        hours = p.groupby("department").overtime_hours
        limit = hours.transform("mean") + 2 * hours.transform("std").fillna(p.overtime_hours.std()).fillna(0)
        p["violated"] = (
            (p.salary_diff.abs() > p.salary_diff.std()).astype(int)
            + (p.salary_dev_pct.abs() > p.salary_dev_pct.std()).astype(int)
            + (p.overtime_hours > limit).astype(int)
        )
        z = (p.robust_z_base_salary.abs() + p.robust_z_salary_dev_pct.abs()) / 2
        p["score"] = 0.4 * p.violated / 3 + 0.3 * (z - z.min()) / (z.max() - z.min())
        out.append(p)
    return pd.concat(out).sort_values(["run_id", "employee_id"])


def test_features_and_scores_match_pandas(spark, pay, path_taken):
    table = features.feature_table(pay)
    got = scoring.score_records(table).toPandas().sort_values(["run_id", "employee_id"])
    want = by_hand(pay.toPandas())
    for c in ("overtime_pay", "earned_base", "salary_diff", "salary_dev_pct", "robust_z_base_salary",
              "robust_z_salary_dev_pct", "robust_z_total_working_days"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-7)
    np.testing.assert_allclose(got.final_anomaly_score, want.score, rtol=1e-9, atol=1e-9)
    assert len([c for c in table.columns if c.startswith("robust_z_")]) == 14


def test_zero_days_give_null(spark):
    df = spark.createDataFrame([("r", 0, 0, 100)], "run_id string, present_days bigint, total_working_days bigint, base_salary bigint")
    line = features.pay_features(df).first()
    assert line["attendance_ratio"] is None and line["earned_base"] is None


def test_missing_roles_skip_features(spark, pay):
    df = pay.select("run_id", "employee_id", "department", "base_salary", "net_salary", "present_days", "total_working_days")
    out = features.pay_features(df)
    assert {"attendance_ratio", "expected_net", "salary_diff"} <= set(out.columns)
    assert not {"overtime_pay", "salary_dev_pct"} & set(out.columns)


def test_ids_are_no_features(spark):
    df = spark.createDataFrame([(1, 2.0)], "employee_id bigint, x double")
    assert schema.numeric_columns(df) == ["x"]


def test_feature_vector_fills_missing_columns(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    out = df.select(*schema.feature_vector(df, ["a", "gone", "b"])).first()
    assert tuple(out) == (2.0, 0.0, 1.0)


def test_single_row_groups_fall_back(spark, path_taken):
    df = spark.createDataFrame(
        [("r", "a", 1), ("r", "a", 3), ("r", "b", 8), ("r", None, 4)], "run_id string, g string, x bigint"
    )
    out = {r["g"]: r for r in profile.with_spread(df, "x", "g").collect()}
    overall = np.std([1, 3, 8, 4], ddof=1)
    assert out["a"]["x_spread"] == pytest.approx(np.sqrt(2))
    assert (out["b"]["x_center"], out["b"]["x_spread"]) == (8.0, pytest.approx(overall))
    assert (out[None]["x_center"], out[None]["x_spread"]) == (4.0, pytest.approx(overall))


def test_flat_sigma_takes_its_rule_out(spark):
    df = spark.createDataFrame([("r", 5.0, 1), ("r", 5.0, 2)], "run_id string, salary_diff double, overtime_hours bigint")
    line = rules.with_rules(df).first()
    assert line["rules_evaluated"] == 1 and line["rules_violated"] == 0


def test_tiers_at_the_bounds(spark):
    from tallyward.functions.scalars import risk_tier

    df = spark.createDataFrame([(x,) for x in (0.0, 0.29, 0.3, 0.6, 0.8, 1.0, None)], "s double")
    got = [r[0] for r in df.select(risk_tier(F.col("s"))).collect()]
    assert got == ["LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL", "UNKNOWN"]


def test_explanation_names_absent_features(spark):
    df = spark.createDataFrame(
        [("r", "a", 900.0, 5.0), ("r", "b", 0.0, 0.0), ("r", "c", 1.0, 0.0)],
        "run_id string, employee_id string, salary_diff double, robust_z_base_salary double",
    ).withColumn("decision", -F.col("salary_diff"))
    top = scoring.score_records(df, absent=["department"]).orderBy(F.desc("final_anomaly_score")).first()
    assert top["risk_tier"] == "CRITICAL"
    assert top["explanation"] == (
        "Risk Tier: CRITICAL (Score: 1.00). Rules violated: 1/1. Details: salary_diff (900) exceeded 1σ (519). "
        "Robust Z-Scores: Z-base: 5.00. Model Anomaly Score: 1.00. Absent features (schema mismatch): department"
    )


def test_statistics_are_broadcast_to_a_large_table(spark, pay, monkeypatch):
    from tallyward.operators import settling

    monkeypatch.setattr(settling, "SMALL_ROWS", 0)
    plan = rules.with_rules(features.pay_features(pay))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_too_many_groups_are_not_forced_into_a_broadcast(spark):
    from tallyward.operators import settling

    rows = spark.range(100).select((F.col("id") % 10).alias("g"), "id")
    stats = settling.settle(rows.groupBy("g").agg(F.avg("id").alias("m")))
    # Without the optimizer's own threshold only the hint is left to ask for a broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, broadcast in ((9, False), (10, True)):
            joined = rows.join(settling.sized(stats, limit), "g")
            assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) is broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_median_of_runs(spark, pay, path_taken):
    got = {r["run_id"]: r["quantiles"][0] for r in quantiles.exact_quantiles(pay, ["run_id"], ["base_salary"], [0.5]).collect()}
    want = pay.toPandas().groupby("run_id").base_salary.median()
    assert got == want.to_dict()


def test_scoring_a_large_table_moves_no_rows(spark, pay, monkeypatch):
    from tallyward.operators import settling

    monkeypatch.setattr(settling, "SMALL_ROWS", 0)
    plan = scoring.score_records(features.feature_table(pay))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan
