"""All stages of one run, from an incoming file to reports and alerts.

A plain function chains the stages. Each stage reads the tables earlier ones stored and writes its
own, partitioned by run, so a failed run resumes nothing but harms nothing either: the ledger marks
it failed and the same file may come again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyward.errors import MissingRoleError
from tallyward.functions.scalars import drift_multiplier
from tallyward.operators import (
    alerts, classifier, cleaning, drift, evaluation, features, forecast, isolation, profile, quality, risk, rules,
    schema, scoring,
)
from tallyward.operators.forest import read_forest
from tallyward.operators.settling import measure, stage
from tallyward.plans import reports
from tallyward.sources import ledger, readers, store

RUN, ENTITY = "run_id", "employee_id"
ROW = [RUN, ENTITY]
DETECTOR, AWAY, FORGED = "anomaly_detector", "absenteeism_classifier", "salary_manipulation_detector"
PAYROLL = "company_payroll_forecaster"
# Fixed value: name of the version that holds all group models.
GROUPS = "dept_payroll_forecaster"


@dataclass(frozen=True)
class Place:
    """Where the tables of one installation live."""

    spark: SparkSession
    base: str
    trees: int = isolation.TREES
    depth: int = classifier.DEPTH

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    def history(self, name: str, ddl: str) -> DataFrame:
        """A table that may not exist yet."""
        try:
            return store.read_history(self.spark, self.path(name))
        except FileNotFoundError:
            return self.spark.createDataFrame([], ddl)

    def run_events(self) -> DataFrame:
        return self.history("run_events", ledger.RUN_EVENTS)

    def model_events(self) -> DataFrame:
        try:
            return self.spark.read.schema(ledger.MODEL_EVENTS).parquet(self.path("model_events"))
        except AnalysisException as error:
            # No model was ever registered.
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ledger.MODEL_EVENTS)

    def run(self, name: str, run_id: str) -> DataFrame:
        return store.read_run(self.spark, self.path(name), run_id)

    def save(self, name: str, df: DataFrame) -> None:
        store.write_runs(df, self.path(name))

    def note(self, run_id: str, step: str, status: str, file_hash: str | None = None, error: str | None = None) -> None:
        store.append(ledger.run_event(self.spark, run_id, step, status, file_hash, error), self.path("run_events"))


def ingest(place: Place, path: str, run_id: str | None = None) -> str:
    """Run all stages on a file; a file some completed run has read gives that run's id at once."""
    spark = place.spark
    hashes = readers.batch_hash(spark, path)
    known = ledger.known_runs(hashes, place.run_events()).first()
    if known:
        return known[RUN]
    run_id = run_id or ledger.new_run_id()
    file_hash = hashes.first()["file_hash"]
    place.note(run_id, "run", "RUNNING", file_hash)
    fired: list[DataFrame] = []
    try:
        for step, stage in (
            ("feature", lambda: build_features(place, path, run_id)),
            ("training", lambda: train(place, run_id, fired)),
            ("inference", lambda: score(place, run_id, fired)),
            ("forecasting", lambda: predict(place, run_id, fired)),
            ("risk", lambda: assess(place, run_id, fired)),
            ("drift_monitoring", lambda: monitor(place, run_id, fired)),
            ("drift_handling", lambda: handle(place, run_id, fired)),
            ("alerting", lambda: publish(place, run_id, fired)),
        ):
            place.note(run_id, step, "RUNNING")
            stage()
            place.note(run_id, step, "COMPLETE")
    except Exception as error:
        failure = spark.createDataFrame([(run_id, str(error))], f"{RUN} string, error string")
        failed = alerts.failure_alerts(failure)
        try:
            _save_alerts(place, [*fired, failed])
        except Exception:  # noqa: BLE001 - an earlier alert may rest on the very thing that failed
            _save_alerts(place, [failed])
        place.note(run_id, step, "FAILED")
        place.note(run_id, "run", "FAILED", file_hash, str(error))
        raise
    place.note(run_id, "run", "COMPLETE", file_hash)
    return run_id


def build_features(place: Place, path: str, run_id: str) -> None:
    raw = readers.read_records(place.spark, path)
    roles = schema.map_roles(raw.columns)
    raw = raw.withColumn(RUN, F.lit(run_id))
    place.save("quality", quality.quality_report(raw, roles))
    missing = [r for r in (ENTITY, "base_salary", "net_salary") if r not in roles.mapped]
    if missing:
        raise MissingRoleError(f"no column for {', '.join(missing)}")
    traced = cleaning.trace_cleaning(schema.with_role_names(raw, roles, keep=[RUN]))
    place.save("cleaning", cleaning.cleaning_summary(traced))
    place.save("clean", cleaning.clean_rows(traced))
    clean = place.run("clean", run_id)
    cleaning.assert_usable(clean.select(RUN, *[c for c in schema.CANONICAL if c in clean.columns]))
    given = set(clean.columns)
    derived = features.pay_features(clean)
    wanted = [c for c in derived.columns if c in (RUN, *schema.CANONICAL) or c not in given]
    place.save("features", features.feature_table(clean).select(
        *wanted, *[f"robust_z_{c}" for c in schema.numeric_columns(derived.select(*wanted))]
    ))
    table = place.run("features", run_id)
    place.save("totals", run_totals(table))
    place.save("profiles", profile.distribution_profile(table, schema.numeric_columns(table)))
    groups = [c for c in ("department", "designation") if c in table.columns]
    if groups:
        place.save("categories", profile.category_counts(table, groups))


def _labelled(place: Place, run_id: str) -> DataFrame:
    rows = place.run("features", run_id)
    return rules.rule_target(rows).select(*rows.columns, "rule_target")


def _coded(place: Place, rows: DataFrame, version: str) -> DataFrame:
    for c in ("department", "designation"):
        if c in rows.columns:
            codes = place.spark.read.parquet(place.path(f"models/{AWAY}/{version}/codes_{c}"))
            rows = evaluation.encode(rows, codes, c)
    return rows


def train(place: Place, run_id: str, fired: list[DataFrame], attempt: int = 1) -> None:
    """Fit all challengers, compare them with the champions, register every version."""
    spark = place.spark
    version = run_id if attempt == 1 else f"{run_id}_retrain{attempt}"
    rows = _labelled(place, run_id)
    size = measure(rows)
    rate = rows.agg(F.avg(F.col("rule_target").cast("double"))).first()[0]
    metrics: list[tuple[str, float, float, bool]] = []

    for name, inputs, share in (
        (DETECTOR, schema.detector_features(rows), min(0.5, max(0.05, rate))),
        (FORGED, schema.manipulation_features(rows), isolation.MANIPULATION_CONTAMINATION),
    ):
        if not inputs:
            continue
        result = isolation.cross_validate_forest(
            rows, inputs, "rule_target", ROW, share, place.trees, size=size
        ).first()
        forest = isolation.fit_forest(rows, inputs, ROW, share, place.trees, size=size)
        folder = place.path(f"models/{name}/{version}")
        forest.node_table(spark).write.mode("overwrite").parquet(f"{folder}/nodes")
        facts = [(list(forest.features), forest.sample_rows, forest.offset)]
        spark.createDataFrame(facts, "features array<string>, sample_rows int, offset double").write.mode(
            "overwrite"
        ).parquet(f"{folder}/facts")
        metrics.append((name, result["f1"], result["stability_score"], False))

    if {"present_days", "total_working_days"} <= set(rows.columns):
        folder = place.path(f"models/{AWAY}/{version}")
        for c in ("department", "designation"):
            if c in rows.columns:
                evaluation.label_codes(rows, c).write.mode("overwrite").parquet(f"{folder}/codes_{c}")
        coded = _coded(place, rows, version).withColumn("away", rules.absenteeism_label())
        inputs = schema.absenteeism_features(coded)
        result = classifier.cross_validate(coded, inputs, "away", ROW, place.trees, place.depth, size=size).first()
        model = classifier.fit_absenteeism(coded, inputs, "away", ROW, place.trees, place.depth)
        only = bool(coded.select("away").first()[0]) if model is None else None
        if model is not None:
            model.node_table(spark).write.mode("overwrite").parquet(f"{folder}/forest")
        spark.createDataFrame([(inputs, only)], "features array<string>, only_label boolean").write.mode(
            "overwrite"
        ).parquet(f"{folder}/facts")
        metrics.append((AWAY, result["f1"], result["stability_score"], False))

    totals = _totals(place)
    series = forecast.with_index(totals, RUN).withColumn("series", F.lit("company"))
    for name, value in ((PAYROLL, "total_payroll"), ("company_overtime_forecaster", "overtime_hours")):
        result = forecast.regression_cv(series, value, ["series"]).first()
        metrics.append((name, result["mape"], result["stability_score"], True))

    held = {r["model_name"]: r["metric"] for r in ledger.production_models(place.model_events()).collect()}
    tries = [(run_id, n, m, lower, n == "company_overtime_forecaster") for n, m, _, lower in metrics]
    tries += [("", n, held[n], lower, False) for n, _, _, lower in metrics if n in held]
    decided = evaluation.champion_decisions(
        spark.createDataFrame(tries, f"{RUN} string, model_name string, metric double, lower_is_better boolean, always_promote boolean")
        .withColumn("always_promote", F.max("always_promote").over(Window.partitionBy("model_name")))
    ).where(F.col(RUN) == run_id)
    steady = spark.createDataFrame([(n, s) for n, _, s, _ in metrics], "model_name string, stability_score double")
    decided = decided.join(steady, "model_name", "left").withColumn("attempt", F.lit(attempt))
    outcome = decided.collect()
    events = []
    for line in outcome:
        kinds = ["registered", "promoted"] if line["promoted"] else ["registered"]
        events += [(line["model_name"], version, attempt, kind, line["challenger"]) for kind in kinds]
    grouped = place.history("totals", TOTALS).where("department is not null")
    if not grouped.isEmpty():
        # One version holds the models of all groups; their parameters and metrics are a table by group.
        placed = forecast.densify(grouped, RUN, "department", "net_salary", trim=True)
        made = forecast.group_models(forecast.active_history(placed, "department", "net_salary"), "net_salary", "department", index="active_t")
        made = stage(made.withColumns({RUN: F.lit(run_id), "version_id": F.lit(version)}), "group_models")
        store.append(made, place.path("group_models"))
        error = made.agg(F.avg("mape")).first()[0]
        events += [(GROUPS, version, attempt, kind, error) for kind in ("registered", "promoted")]
    noted = spark.createDataFrame(events, "model_name string, version_id string, attempt int, event string, metric double")
    noted = noted.select("model_name", "version_id", "attempt", "event", F.current_timestamp().alias("at"), "metric")
    store.append(noted, place.path("model_events"))
    store.append(decided.withColumn("version_id", F.lit(version)), place.path("training"))
    fired.append(alerts.retrain_alerts(decided))


def _production(place: Place, name: str) -> str | None:
    found = ledger.production_models(place.model_events().where(F.col("model_name") == name)).first()
    return found["version_id"] if found else None


def _forest(place: Place, name: str) -> isolation.Forest | None:
    version = _production(place, name)
    if not version:
        return None
    folder = place.path(f"models/{name}/{version}")
    facts = place.spark.read.parquet(f"{folder}/facts").first()
    # Bounded by trees x rows per tree.
    nodes = place.spark.read.parquet(f"{folder}/nodes").toPandas()
    return isolation.Forest(nodes, tuple(facts["features"]), facts["sample_rows"], facts["offset"])


def score(place: Place, run_id: str, fired: list[DataFrame]) -> None:
    rows = place.run("features", run_id)
    forest = _forest(place, DETECTOR)
    if forest is None:
        raise FileNotFoundError(f"no production version of {DETECTOR}")
    warned = place.run("quality", run_id).first()
    absent = warned["unmapped_columns"] if "SCHEMA_MISMATCH_WARNING" in warned["warnings"] else []
    # The decisions are stored once, as scoring passes over them several times.
    place.save("decisions", forest.decide(rows))
    place.save("scored", scoring.score_records(place.run("decisions", run_id), absent=absent))
    fired.append(alerts.high_risk_alerts(place.run("scored", run_id)))


# One row per run and department (null where a run has none): what forecasts need of the feature history.
TOTALS = f"{RUN} string, department string, records bigint, net_salary double, overtime_hours double"


def run_totals(table: DataFrame) -> DataFrame:
    """Counts and sums of feature rows by run and department. They add up over departments, so a new run appends its own."""
    have = set(table.columns)
    group = F.col("department").cast("string") if "department" in have else F.lit(None).cast("string")
    hours = F.col("overtime_hours") if "overtime_hours" in have else F.lit(0)
    return table.groupBy(RUN, group.alias("department")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("net_salary").cast("double").alias("net_salary"), F.sum(hours).cast("double").alias("overtime_hours")
    )


def rebuild_totals(place: Place) -> None:
    """Totals of all runs from the feature history; for a base whose runs were stored before there were totals."""
    place.save("totals", run_totals(store.read_history(place.spark, place.path("features"))))


def _totals(place: Place) -> DataFrame:
    """One row per run, from the stored totals: no feature row of an earlier run is read again."""
    return forecast.period_totals(place.history("totals", TOTALS), RUN, {"total_payroll": "net_salary", "overtime_hours": "overtime_hours"})


FORECASTS = (
    f"{RUN} string, predicted_total double, predicted_overtime double, drift_multiplier double, actual_total double, "
    "forecast_mape double"
)
DRIFT = f"{RUN} string, max_psi double, overall_severity string, drift_detected boolean, accuracy_decay_pct double"


def predict(place: Place, run_id: str, fired: list[DataFrame]) -> None:
    series = forecast.with_index(_totals(place), RUN)
    pay = forecast.trend_next(series, "total_payroll").select(F.col("prediction").alias("raw_total"))
    hours = forecast.trend_next(series, "overtime_hours").select(F.col("prediction").alias("predicted_overtime"))
    before = place.history("drift", DRIFT).agg(F.max_by("overall_severity", RUN).alias("severity"))
    trained = place.spark.read.parquet(place.path("training")).where((F.col(RUN) == run_id) & (F.col("model_name") == PAYROLL))
    factor = F.coalesce(drift_multiplier(F.col("severity")), F.lit(1.0))
    entry = series.where(F.col(RUN) == run_id).select(RUN, F.col("total_payroll").cast("double").alias("actual_total"))
    entry = entry.withColumns(
        {
            "raw_total": pay.scalar(), "predicted_overtime": hours.scalar(), "severity": before.scalar(),
            "forecast_mape": trained.agg(F.max("challenger")).scalar(),
        }
    )
    entry = entry.withColumn("drift_multiplier", factor).select(
        RUN, (F.col("raw_total") * F.col("drift_multiplier")).alias("predicted_total"), "predicted_overtime",
        "drift_multiplier", "actual_total", "forecast_mape",
    )
    place.save("forecasts", entry)
    totals = place.history("totals", TOTALS).where("department is not null").select(RUN, "department", "net_salary")
    if not totals.isEmpty():
        groups = forecast.group_forecast(totals, RUN, "department", "net_salary").withColumn(RUN, F.lit(run_id))
        place.save("group_forecasts", groups)
    told = forecast.spikes(place.history("forecasts", FORECASTS)).where(F.col(RUN) == run_id)
    fired.append(alerts.spike_alerts(told))


def assess(place: Place, run_id: str, fired: list[DataFrame]) -> None:
    rows = rules.overtime_abuse(place.run("scored", run_id))
    version = _production(place, AWAY)
    if version:
        folder = place.path(f"models/{AWAY}/{version}")
        facts = place.spark.read.parquet(f"{folder}/facts").first()
        model = None if facts["only_label"] is not None else read_forest(place.spark.read.parquet(f"{folder}/forest"), facts["features"])
        names = rows.columns
        rows = classifier.positive_share(model, _coded(place, rows, version), facts["features"], facts["only_label"])
        rows = rows.select(*names, "absenteeism_score")
    else:
        rows = rows.withColumn("absenteeism_score", F.lit(0.0))
    forest = _forest(place, FORGED)
    rows = forest.decide(rows, "salary_manipulation_score") if forest else rows.withColumn("salary_manipulation_score", F.lit(0.0))
    rows = rows.withColumns(
        {
            "absenteeism": classifier.absenteeism_flag(),
            "salary_manipulation": F.col("salary_manipulation_score") < 0,
        }
    )
    place.save("judged", rows)
    rows = place.run("judged", run_id)
    blank = f"{ENTITY} string, {RUN} string, score double, trend string, escalation boolean, absenteeism boolean, overtime_abuse boolean, salary_manipulation boolean"
    register = place.history("register", blank).where(F.col(RUN) < run_id)
    now = risk.assess_run(risk.entity_states(rows), register, run_id)
    place.save("register", now)
    now = place.run("register", run_id)
    flags = now.select(F.col(ENTITY).alias("who"), F.col("overtime_abuse").alias("overtime_abuse_flag"))
    report = rows.join(flags, F.col(ENTITY).cast("string") == F.col("who"), "left").withColumns(
        {"absenteeism_flag": F.col("absenteeism"), "salary_manipulation_flag": F.col("salary_manipulation")}
    )
    place.save("risk", reports.risk_report(report))
    scores = rows.groupBy(F.col(ENTITY).cast("string").alias(ENTITY), RUN).agg(
        F.max("absenteeism_score").alias("absenteeism_score"), F.min("salary_manipulation_score").alias("salary_manipulation_score")
    )
    fired.append(alerts.risk_alerts(now.join(scores, [ENTITY, RUN], "left")))


def monitor(place: Place, run_id: str, fired: list[DataFrame]) -> None:
    events = place.run_events()
    pair = ledger.reference_runs(events).where(F.col(RUN) == run_id)
    reference = pair.first()["reference_run"]
    if reference is None:
        fired.append(alerts.cold_start_notices(pair))
        return
    spark = place.spark
    pair = spark.createDataFrame([(run_id, reference)], f"{RUN} string, reference_run string")
    scored = store.read_history(spark, place.path("scored")).where(F.col(RUN).isin(run_id, reference))
    shared = schema.shared_columns(place.run("scored", run_id), place.run("scored", reference))
    psi = drift.psi(scored, shared, pairs=pair)
    place.save("psi", psi)
    psi = place.run("psi", run_id)
    groups = [c for c in ("department", "designation") if c in scored.columns]
    if groups:
        place.save("category_drift", drift.with_p_value(drift.chi_squared(scored, groups, pairs=pair)))
    errors = place.history("forecasts", FORECASTS).select(RUN, F.col("forecast_mape").alias("mape"))
    decay = drift.accuracy_decay(errors).where(F.col(RUN) == run_id)
    place.save("drift", drift.severity_by_run(psi).join(decay.select(RUN, "accuracy_decay_pct"), RUN, "left"))
    place.save("top_drift", drift.top_drift(psi, drift.mean_change(scored, shared, pairs=pair)))
    fired += [alerts.drift_alerts(psi), alerts.decay_alerts(decay)]


def handle(place: Place, run_id: str, fired: list[DataFrame]) -> None:
    found = place.history("drift", DRIFT).where(F.col(RUN) == run_id)
    policy = drift.drift_policy(found)
    line = policy.first()
    if line is None:
        quiet = place.spark.createDataFrame([(run_id, None, 0.0)], f"{RUN} string, overall_severity string, accuracy_decay_pct double")
        place.save("policy", drift.drift_policy(quiet))
        return
    if line["action"] in ("threshold_recalibration", "recalibrate_and_retrain"):
        table = place.run("features", run_id)
        place.save("thresholds", profile.thresholds(table, schema.numeric_columns(table)))
    if line["retrain_triggered"]:
        train(place, run_id, fired, attempt=2)
    place.save("policy", policy)
    fired.append(alerts.policy_alerts(policy))


def _save_alerts(place: Place, fired: list[DataFrame]) -> None:
    """Write the alerts of a run, also of one that failed."""
    together = fired[0]
    for part in fired[1:]:
        together = together.unionByName(part)
    place.save("alerts", alerts.dedupe_alerts(together).withColumn("timestamp", F.current_timestamp()))


def publish(place: Place, run_id: str, fired: list[DataFrame]) -> None:
    _save_alerts(place, fired)
    scored, report = place.run("scored", run_id), place.run("risk", run_id)
    counted = store.read_history(place.spark, place.path("alerts")).where(F.col(RUN) == run_id)
    summary = reports.run_summary(scored, report).withColumn("alerts_count", counted.agg(F.count(F.lit(1))).scalar())
    place.save("summary", summary)
    told = place.history("forecasts", FORECASTS).where(F.col(RUN) == run_id).dropDuplicates([RUN])
    found = place.history("drift", DRIFT).where(F.col(RUN) == run_id).dropDuplicates([RUN])
    store.write_json_report(reports.sectioned_summary(summary, told, found, counted), place.path(f"reports/{run_id}/sections"))
    store.write_csv_report(report, place.path(f"reports/{run_id}/risk_report"))
    store.write_csv_report(reports.high_risk_report(report, scored), place.path(f"reports/{run_id}/high_risk"))
    total = place.run("forecasts", run_id).select(
        RUN, F.col("predicted_total").alias("total_payroll"), F.col("predicted_overtime").alias("overtime_hours"),
        (F.col("drift_multiplier") > 1).alias("drift_adjusted"),
    )
    blank = f"{RUN} string, department string, active_periods bigint, prediction double"
    groups = place.history("group_forecasts", blank).where(F.col(RUN) == run_id)
    store.write_csv_report(reports.forecast_report(total, groups).drop(RUN), place.path(f"reports/{run_id}/forecast"))
    for name in ("quality", "cleaning", "summary", "policy", "alerts"):
        store.write_json_report(place.run(name, run_id) if name != "alerts" else counted, place.path(f"reports/{run_id}/{name}"))
