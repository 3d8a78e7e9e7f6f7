import random

import pytest
from pyspark.sql import functions as F

from tallyward.operators import alerts, risk
from tallyward.plans import catalog, reports

from .conftest import SMALL_TABLES, rows

STATES = "employee_id string, run_id string, score double, absenteeism boolean, overtime_calc boolean, salary_manipulation boolean"


def walk(states):
    """The register kept run by run, with the stored overtime flag feeding back."""
    memory, out = {}, {}
    for run in sorted({s[1] for s in states}):
        for who, _, score, away, calc, forged in [s for s in states if s[1] == run]:
            past = memory.setdefault(who, [])
            trend = "stable" if not past or score == past[-1][0] else ("increasing" if score > past[-1][0] else "decreasing")
            rising = len(past) >= 2 and score > past[-1][0] > past[-2][0]
            flag = calc or (len(past) >= 2 and past[-1][1] and past[-2][1])
            past.append((score, flag))
            out[(who, run)] = (trend, rising, flag)
    return out


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(7)
    return [(f"E{e}", f"run_{r}", float(rng.randint(0, 4)), rng.random() < 0.3, rng.random() < 0.45, False)
            for e in range(60) for r in range(9) if rng.random() < 0.8]


def test_history_equals_the_run_by_run_register(spark, sample):
    out = risk.assess_history(spark.createDataFrame(sample, STATES)).collect()
    got = {(r["employee_id"], r["run_id"]): (r["trend"], r["escalation"], r["overtime_abuse"]) for r in out}
    assert got == walk(sample)


def test_one_new_run_equals_the_history(spark, sample):
    states = spark.createDataFrame(sample, STATES)
    whole = risk.assess_history(states)
    register = whole.where("run_id < 'run_8'")
    now = risk.assess_run(states, register, "run_8")
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, whole.where("run_id = 'run_8'").select(now.columns).collect()))


def test_escalation_needs_three_rising_runs(spark):
    data = [("E_UP", f"run_{i}", s, False, False, False) for i, s in enumerate([0.2, 0.5, 0.9])]
    got = [r["escalation"] for r in risk.assess_history(spark.createDataFrame(data, STATES)).orderBy("run_id").collect()]
    assert got == [False, False, True]


def test_many_records_of_one_entity_merge_before_the_window(spark):
    rows = spark.range(5000).select(
        F.lit("HOT").alias("employee_id"), F.concat(F.lit("run_"), F.col("id") % 3).alias("run_id"),
        (F.col("id") % 100 / 100).alias("final_anomaly_score"), (F.col("id") > 4990).alias("overtime_calc"),
    )
    out = risk.entity_states(rows).orderBy("run_id").collect()
    assert len(out) == 3 and out[0]["score"] == 0.99


def test_register_views(spark, sample):
    whole = risk.assess_history(spark.createDataFrame(sample, STATES))
    latest = {r["employee_id"]: r["last_run_id"] for r in risk.register_now(whole).collect()}
    want = {}
    for who, run, *_ in sample:
        want[who] = max(run, want.get(who, ""))
    assert latest == want
    active = risk.register_now(whole, active_in="run_8")
    assert {r["employee_id"] for r in active.collect()} == {w for w, r in want.items() if r == "run_8"}
    nested = risk.history_arrays(whole).where("employee_id = 'E0'").first()
    assert [h["run_id"] for h in nested["history"]] == sorted(s[1] for s in sample if s[0] == "E0")


ALERT = alerts.ALERT_SCHEMA


def test_first_alert_per_entity_stands(spark):
    data = [
        ("A", "HIGH", "r", "e", 2.0, None, "later", 7), ("A", "HIGH", "r", "e", 1.0, None, "first", 6),
        ("A", "HIGH", "r", "f", 1.0, None, "", 6), ("B", "INFO", "r", "e", 1.0, None, "", 6), ("A", "HIGH", "s", "e", 3.0, None, "", 6),
    ]
    out = alerts.dedupe_alerts(spark.createDataFrame(data, ALERT))
    assert out.count() == 4
    assert out.where("run_id = 'r' AND alert_type = 'A' AND affected_entity = 'e'").first()["recommended_action"] == "first"


def test_a_column_may_raise_several_drift_alerts(spark):
    psi = spark.createDataFrame([("r", "overtime_pay", 11.0), ("r", "present_days", 0.3), ("r", "base_salary", 0.25)], "run_id string, column string, psi double")
    got = sorted((r["alert_type"], r["affected_entity"], r["severity"]) for r in alerts.drift_alerts(psi).collect())
    assert got == [
        ("OVERTIME_DRIFT_ALERT", "overtime_pay", "HIGH"), ("PAYROLL_DATA_DRIFT_ALERT", "overtime_pay", "CRITICAL"),
        ("SALARY_DRIFT_ALERT", "overtime_pay", "HIGH"),
    ]


def test_accuracy_alerts(spark):
    df = spark.createDataFrame([("a", 0.1, None), ("b", 0.16, 0.1), ("c", 0.4, 0.16)], "run_id string, mape double, prior_mape double")
    got = sorted((r["run_id"], r["alert_type"]) for r in alerts.decay_alerts(df).collect())
    assert got == [("b", "FORECAST_ACCURACY_DECAY_ALERT"), ("c", "CRITICAL_MODEL_HEALTH_ALERT"), ("c", "FORECAST_ACCURACY_DECAY_ALERT")]


def test_batch_health(spark, path_taken):
    calm = [("calm", float(x), 1, 100.0 + x) for x in (-2, -1, 0, 1, 2)]
    flat = [("flat", 5.0, 3, 100.0) for _ in range(5)]
    spike = [("spike", float(x), 1, p) for x, p in zip([-2, -1, 0, 1, 2] * 4, [100.0] * 19 + [9999.0])]
    df = spark.createDataFrame(calm + flat + spike, "run_id string, salary_diff double, final_risk_level int, updated_net_salary double")
    got = sorted((r["run_id"], r["type"]) for r in alerts.system_alerts(df).collect())
    assert got == [("calm", "SYSTEM_HEALTHY"), ("flat", "ANOMALY_SPIKE"), ("flat", "SYSTEMATIC_SHIFT"), ("spike", "PAYROLL_SPIKE")]


def test_other_alerts(spark):
    failures = spark.createDataFrame([("r", "boom")], "run_id string, error string")
    assert alerts.failure_alerts(failures).first()["recommended_action"].startswith("boom")
    pairs = spark.createDataFrame([("r1", None), ("r2", "r1")], "run_id string, reference_run string")
    assert [r["run_id"] for r in alerts.cold_start_notices(pairs).collect()] == ["r1"]
    policy = spark.createDataFrame([("r", True, 25.0), ("s", True, 3.0), ("t", False, 30.0)], "run_id string, retrain_triggered boolean, accuracy_decay_pct double")
    assert [r["run_id"] for r in alerts.policy_alerts(policy).collect()] == ["r"]


def test_entity_risk_tells_the_last_run_of_its_highest_record(spark):
    register = spark.createDataFrame([("E1", "r2", 0.5), ("E2", "r1", 0.1), ("E3", "r2", 0.0)], "employee_id string, last_run_id string, current_score double")
    scored = spark.createDataFrame(
        [("E1", "r1", 9.0, "old"), ("E1", "r2", 0.9, "high"), ("E1", "r2", 0.2, "low"), ("E1", "r2", None, "none"), ("E2", "r1", 0.1, None)],
        "employee_id string, run_id string, final_anomaly_score double, explanation string",
    )
    out = reports.entity_risk(register, scored)
    assert out.columns == ["employee_id", "last_run_id", "current_score", "explanation"]
    assert rows(out, "employee_id") == [("E1", "r2", 0.5, "high"), ("E2", "r1", 0.1, ""), ("E3", "r2", 0.0, "")]


def test_queries_derive_their_records_once(spark, monkeypatch):
    """What several steps of a query need is derived once and handed on, and no unused z-score is made."""
    pays, made = [], []
    own_pay, own_z = catalog.pay, catalog.features.robust_z
    monkeypatch.setattr(catalog, "pay", lambda *a: pays.append(a) or own_pay(*a))
    monkeypatch.setattr(catalog.features, "robust_z", lambda df, columns=None, **k: made.append(columns) or own_z(df, columns, **k))
    for name in ("entity_risk", "sectioned_summary"):
        catalog.QUERIES[name](spark, SMALL_TABLES)
    assert len(pays) == 2 and made == [catalog.scoring.Z_COLUMNS] * 2
