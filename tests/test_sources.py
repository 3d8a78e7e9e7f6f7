import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tallyward.plans import reports
from tallyward.sources import ledger, readers, store


def test_csv_types_missing_texts_and_names(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write(" Emp_ID ,Dept,Basic_Pay,Rate,Code\nA1,Ops,100,1.5,007x\nA2,N/A,200,n/a,8\nA3,,300,2,9\n")
    df = readers.read_records(spark, path)
    assert dict(df.dtypes) == {"emp_id": "string", "dept": "string", "basic_pay": "bigint", "rate": "double", "code": "string"}
    assert [r["dept"] for r in df.orderBy("emp_id").collect()] == ["Ops", None, None]
    fixed = readers.read_records(spark, path, "e string, d string, p int, r double, c string")
    assert fixed.columns == ["e", "d", "p", "r", "c"]
    assert [r["d"] for r in fixed.orderBy("e").collect()] == ["Ops", None, None]
    with open(path, "w") as f:
        f.write("id,x\n7f,1\n8d,2\n")
    assert dict(readers.read_records(spark, path).dtypes) == {"id": "string", "x": "bigint"}


def test_json_and_rejections(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('[{"ID": 1, "Net_Pay": 5.5}, {"ID": 2, "Net_Pay": null}]')
    assert readers.read_records(spark, str(path), multi_line=True).columns == ["id", "net_pay"]
    (tmp_path / "lines.json").write_text('{"ID": 1, "Net_Pay": 5.5}\n{"ID": 2}\n')
    assert readers.read_records(spark, str(tmp_path / "lines.json")).columns == ["id", "net_pay"]
    with pytest.raises(ValueError):
        readers.read_records(spark, str(tmp_path / "notes.txt"))
    with pytest.raises(FileNotFoundError):
        readers.read_records(spark, str(tmp_path / "gone.csv"))


def test_run_store(spark, tmp_path):
    path = str(tmp_path / "runs")
    store.write_runs(spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x int"), path)
    store.write_runs(spark.createDataFrame([("r2", 5, "new")], "run_id string, x int, y string"), path)
    assert sorted(map(tuple, store.read_history(spark, path).select("run_id", "x", "y").collect())) == [("r1", 1, None), ("r2", 5, "new")]
    assert store.read_run(spark, path, "r2").count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_run(spark, path, "r9")
    with pytest.raises(FileNotFoundError):
        store.read_history(spark, str(tmp_path / "none"))


def test_one_run_prunes_to_its_partition(spark, tmp_path):
    path = str(tmp_path / "runs")
    store.write_runs(spark.range(100).select((F.col("id") % 4).cast("string").alias("run_id"), "id", (F.col("id") * 2).alias("z")), path)
    plan = store.read_history(spark, path).where("run_id = '3'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_empty_report_keeps_its_header(spark, tmp_path):
    path = str(tmp_path / "report")
    store.write_csv_report(spark.createDataFrame([], "a int, b string"), path)
    assert spark.read.csv(path, header=True).columns == ["a", "b"]


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


RUNS = [
    ("r1", "run", "RUNNING", at(0), "h1", None), ("r1", "feature", "COMPLETE", at(1), None, None), ("r1", "drift_monitoring", "COMPLETE", at(2), None, None),
    ("r1", "run", "COMPLETE", at(3), "h1", None), ("r2", "run", "RUNNING", at(4), "h2", None), ("r2", "feature", "FAILED", at(5), None, None),
    ("r2", "run", "FAILED", at(6), "h2", "boom"), ("r3", "run", "RUNNING", at(7), "h3", None),
]


def test_run_ledger(spark):
    events = spark.createDataFrame(RUNS, ledger.RUN_EVENTS)
    state = {r["run_id"]: r for r in ledger.run_status(events).collect()}
    assert [state[k]["status"] for k in ("r1", "r2", "r3")] == ["COMPLETE", "FAILED", "RUNNING"]
    assert state["r2"]["error"] == "boom" and state["r1"]["completed_at"] == at(3) and len(state["r1"]["steps"]) == 2
    assert {r["run_id"]: r["reference_run"] for r in ledger.reference_runs(events).collect()} == {"r1": None, "r2": "r1", "r3": "r1"}
    assert ledger.last_run(events).first()[0] == "r3"


def test_only_completed_runs_block_a_file(spark):
    events = spark.createDataFrame(RUNS, ledger.RUN_EVENTS)
    files = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h9")], "path string, file_hash string")
    assert sorted(r["path"] for r in ledger.new_files(files, events).collect()) == ["b", "c"]
    assert [(r["path"], r["run_id"]) for r in ledger.known_runs(files, events).collect()] == [("a", "r1")]


def test_equal_files_hash_alike(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "x,y\n1,2\n"), ("c.csv", "x,y\n1,3\n")):
        (tmp_path / name).write_text(text)
    hashes = {r["path"].rsplit("/", 1)[-1]: r["file_hash"] for r in readers.file_hashes(spark, str(tmp_path)).collect()}
    assert hashes["a.csv"] == hashes["b.csv"] != hashes["c.csv"]
    single = readers.batch_hash(spark, str(tmp_path / "a.csv")).first()["file_hash"]
    whole = readers.batch_hash(spark, str(tmp_path)).first()["file_hash"]
    assert single == hashes["a.csv"] and whole not in hashes.values()


def test_rollback(spark):
    def made(version, minute):
        return [("m", version, 1, "registered", at(minute), 0.5), ("m", version, 1, "promoted", at(minute), 0.5)]

    events = spark.createDataFrame(made("a", 1) + made("b", 2), ledger.MODEL_EVENTS)
    assert [(r["version_id"], r["is_production"]) for r in ledger.model_versions(events).orderBy("place").collect()] == [("b", True), ("a", False)]
    back = ledger.rollback_events(events, "m")
    after = events.unionByName(back)
    assert ledger.production_models(after).first()["version_id"] == "a"
    assert [r["version_id"] for r in ledger.promotion_history(after).orderBy("place").collect()] == ["a", "b", "a"]
    with pytest.raises(ValueError):
        ledger.rollback_events(events, "other")
    assert ledger.cold_start_models(events, ["m", "n"]) == ["n"]


def test_run_ids_sort_by_time():
    early, late = (ledger.new_run_id(dt.datetime(2024, 1, day, 5, 6, 7)) for day in (1, 2))
    assert early < late and re.fullmatch(r"run_20240101_050607_[0-9a-f]{8}", early)


def test_reports(spark):
    scored = spark.createDataFrame(
        [("r", "EMP001", "HIGH", 0.7, "why"), ("r", "E2", "LOW", 0.1, ""), ("s", "E3", "CRITICAL", 0.9, None)],
        "run_id string, employee_id string, risk_tier string, final_anomaly_score double, explanation string",
    )
    report = reports.risk_report(scored)
    assert report.columns == ["run_id", *reports.RISK_REPORT]
    out = {r["employee_id"]: r["explanation"] for r in reports.high_risk_report(report, scored, masked=True).collect()}
    assert out == {"EM***01": "why", "****": ""}
    assert [r["run_id"] for r in reports.of_last_run(scored).collect()] == ["s"]
    assert reports.find_entities(scored, "emp").count() == 1
    assert reports.display_table(scored).columns == ["Employee Id", "Risk Tier", "Risk Score"]
    line = reports.run_summary(scored, report).where("run_id = 'r'").first()
    assert (line["total_records"], line["anomaly_rate"], line["high_count"]) == (2, 0.5, 1)
