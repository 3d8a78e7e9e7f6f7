import pytest
from pyspark.sql import functions as F

from tallyward.errors import MissingRoleError
from tallyward.plans import run_stages
from tallyward.plans.adapters import pay_records
from tallyward.sources import ledger, store

from .conftest import SMALL_TABLES


def test_two_runs(spark, tmp_path):
    place = run_stages.Place(spark, str(tmp_path / "base"), trees=3, depth=2)
    pay = pay_records(spark, SMALL_TABLES)
    for year, factor in ((1996, 1.0), (1997, 2.1)):
        path = str(tmp_path / f"{year}.csv")
        batch = pay.where(F.col("run_id") == f"run_{year}").drop("run_id")
        batch = batch.withColumn("base_salary", (F.col("base_salary") * factor).cast("bigint"))
        batch.toPandas().to_csv(path, index=False)
        assert run_stages.ingest(place, path, run_id=f"run_{year}") == f"run_{year}"
        assert run_stages.ingest(place, path, run_id="again") == f"run_{year}"

    state = {r["run_id"]: r["status"] for r in ledger.run_status(place.run_events()).collect()}
    assert state == {"run_1996": "COMPLETE", "run_1997": "COMPLETE"}
    fired = store.read_history(spark, place.path("alerts"))
    kinds = {r["run_id"]: set(r["kinds"]) for r in fired.groupBy("run_id").agg(F.collect_set("alert_type").alias("kinds")).collect()}
    assert "COLD_START_NOTICE" in kinds["run_1996"] and "SALARY_DRIFT_ALERT" in kinds["run_1997"]
    policy = {r["run_id"]: r["strategy_applied"] for r in store.read_history(spark, place.path("policy")).collect()}
    assert policy == {"run_1996": "skipped — no drift", "run_1997": "full_retrain"}
    assert ledger.model_versions(place.model_events()).where("model_name = 'anomaly_detector'").count() == 3
    assert place.run("thresholds", "run_1997").count() == 28
    summary = place.run("summary", "run_1997").first()
    assert summary["total_records"] == place.run("features", "run_1997").count()
    # Forecasts rest on one row per run and department, which say the same as all feature rows.
    totals = run_stages._totals(place)
    assert all("/totals/" in f for f in totals.inputFiles())
    fresh = store.read_history(spark, place.path("features")).groupBy("run_id").agg(F.sum("net_salary").cast("double").alias("total"))
    assert {r["run_id"]: r["total_payroll"] for r in totals.collect()} == {r["run_id"]: r["total"] for r in fresh.collect()}
    before = {tuple(r) for r in place.history("totals", run_stages.TOTALS).select("run_id", "department", "records", "net_salary").collect()}
    run_stages.rebuild_totals(place)
    assert {tuple(r) for r in place.history("totals", run_stages.TOTALS).select("run_id", "department", "records", "net_salary").collect()} == before
    header = spark.read.csv(place.path("reports/run_1997/high_risk"), header=True).columns
    assert {"employee_id", "risk_tier", "explanation"} <= set(header)


def test_a_failed_file_may_come_again(spark, tmp_path):
    place = run_stages.Place(spark, str(tmp_path / "base"))
    path = tmp_path / "odd.csv"
    path.write_text("col_a,col_b\n1,2\n3,4\n")
    for attempt in ("run_1", "run_2"):
        with pytest.raises(MissingRoleError):
            run_stages.ingest(place, str(path), run_id=attempt)
    state = {r["run_id"]: (r["status"], r["error"]) for r in ledger.run_status(place.run_events()).collect()}
    assert {k: v[0] for k, v in state.items()} == {"run_1": "FAILED", "run_2": "FAILED"}
    assert place.run("alerts", "run_2").first()["alert_type"] == "PIPELINE_FAILURE_ALERT"
    assert place.run("quality", "run_1").first()["warnings"] == ["SCHEMA_MISMATCH_WARNING"]
