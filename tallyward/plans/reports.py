"""Report queries over the stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.scalars import is_high_risk, mask_id, title_words

# Columns of the risk report and of the display table.
RISK_REPORT = [
    "employee_id", "department", "designation", "absenteeism_score", "absenteeism_flag", "overtime_hours",
    "overtime_abuse_flag", "salary_manipulation_score", "salary_manipulation_flag", "final_anomaly_score", "risk_tier",
]
DISPLAY = ["employee_id", "department", "designation", "net_salary", "risk_tier", "risk_score"]


def risk_report(scored: DataFrame, run: str = "run_id") -> DataFrame:
    """The eleven report columns; whatever the input lacks is 0, false or 'Unknown'."""
    have = set(scored.columns)
    absent = {"department": F.lit("Unknown"), "designation": F.lit("Unknown")}
    absent |= {c: F.lit(0.0) for c in ("absenteeism_score", "overtime_hours", "salary_manipulation_score")}
    absent |= {c: F.lit(False) for c in RISK_REPORT if c.endswith("_flag")}
    columns = [F.col(c) if c in have else absent[c].alias(c) for c in RISK_REPORT]
    return scored.select(run, *columns)


def _told(scored: DataFrame, score: str = "final_anomaly_score") -> Column:
    """The explanation of the highest-scoring record of a group; of equal scores the last text in order."""
    told = F.coalesce("explanation", F.lit(""))
    rank = F.coalesce(F.col(score), F.lit(-1.0)) if score in scored.columns else F.lit(0.0)
    return F.max(F.struct(rank.alias("rank"), told.alias("told"))).getField("told")


def high_risk_report(
    report: DataFrame, scored: DataFrame, masked: bool = False, run: str = "run_id", entity: str = "employee_id"
) -> DataFrame:
    """HIGH and CRITICAL rows of the report with their explanation, empty where there is none.

    If an id repeats in a run, its rows show the text of the record with the highest score, which stands for the run.
    """
    texts = scored.groupBy(run, F.col(entity).cast("string").alias("who")).agg(_told(scored).alias("explanation"))
    hit = report.where(is_high_risk(F.col("risk_tier"))).withColumn("who", F.col(entity).cast("string"))
    out = hit.join(texts, [run, "who"], "left").drop("who")
    out = out.withColumn("explanation", F.coalesce("explanation", F.lit("")))
    return out.withColumn(entity, mask_id(F.col(entity))) if masked else out


def tier_counts(scored: DataFrame, run: str = "run_id") -> DataFrame:
    return scored.groupBy(run, "risk_tier").agg(F.count(F.lit(1)).alias("n"))


def run_summary(scored: DataFrame, report: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, total_records, anomaly_rate, tier counts, flag counts): one row per run."""
    tiers = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    records = scored.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.avg(is_high_risk(F.col("risk_tier")).cast("double")).alias("anomaly_rate"),
        *[F.count_if(F.col("risk_tier") == t).alias(f"{t.lower()}_count") for t in tiers],
    )
    flags = report.groupBy(run).agg(
        F.count_if("absenteeism_flag").alias("absenteeism_risk_count"),
        F.count_if("overtime_abuse_flag").alias("overtime_abuse_count"),
        F.count_if("salary_manipulation_flag").alias("salary_manipulation_count"),
    )
    return records.join(flags, run, "left")


def sectioned_summary(summary: DataFrame, forecasts: DataFrame, drifts: DataFrame, alerts: DataFrame, run: str = "run_id") -> DataFrame:
    """One nested row per run: its records, risk counts, forecast, drift report and number of alerts.

    ``forecasts`` and ``drifts`` hold at most one row per run, whose other columns become the section; a run without one has null there.
    """
    def section(table: DataFrame, name: str) -> DataFrame:
        return table.select(run, F.struct(*[c for c in table.columns if c != run]).alias(name))

    inference = F.struct(
        "total_records", "anomaly_rate",
        F.struct(*[F.col(f"{t.lower()}_count").alias(t) for t in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]).alias("risk_tiers"),
    )
    risks = F.struct("absenteeism_risk_count", "overtime_abuse_count", "salary_manipulation_count")
    fired = alerts.groupBy(run).agg(F.count(F.lit(1)).alias("alerts_count"))
    out = summary.select(run, inference.alias("inference"), risks.alias("risk_monitoring"))
    out = out.join(section(forecasts, "forecasting"), run, "left").join(section(drifts, "drift_monitoring"), run, "left")
    return out.join(fired, run, "left").withColumn("alerts_count", F.coalesce("alerts_count", F.lit(0)))


def dashboard_figures(summary: DataFrame, severities: DataFrame, run: str = "run_id") -> DataFrame:
    """The headline figures with their labels, one row per run."""
    high = F.col("high_count") + F.col("critical_count")
    rate = F.round(F.col("anomaly_rate") * 100.0, 2)
    drift = F.coalesce("overall_severity", F.lit("Skipped (Baseline)"))
    # Labels and limits of the figures.
    return summary.join(severities.select(run, "overall_severity"), run, "left").select(
        run, "total_records", rate.alias("anomaly_rate_pct"),
        F.when(F.col("anomaly_rate") * 100.0 > 5, "Active Anomalies").otherwise("Normal").alias("anomaly_label"),
        high.alias("high_risk_cases"),
        F.when(high > 0, "Action Required").otherwise("Clear").alias("risk_label"),
        drift.alias("drift_status"),
        F.when(drift.contains("No Drift"), "Calibrated").otherwise("Drift Warning").alias("drift_label"),
        "absenteeism_risk_count", "overtime_abuse_count", "salary_manipulation_count",
    )


def forecast_report(total: DataFrame, groups: DataFrame, run: str = "run_id", group: str = "department") -> DataFrame:
    """(run, metric, department, value): the forecast in long form, values as text.

    ``total`` has ``total_payroll``, ``overtime_hours``, ``drift_adjusted``; ``groups`` has ``prediction``.
    """
    head = total.select(
        run,
        F.stack(
            F.lit(3),
            F.lit("total_payroll"), F.lit("All"), F.col("total_payroll").cast("string"),
            F.lit("overtime_hours"), F.lit("All"), F.col("overtime_hours").cast("string"),
            F.lit("drift_adjusted"), F.lit("All"), F.initcap(F.col("drift_adjusted").cast("string")),
        ).alias("metric", "department", "value"),
    )
    rest = groups.select(
        run, F.lit("department_payroll").alias("metric"), F.col(group).alias("department"),
        F.col("prediction").cast("string").alias("value"),
    )
    return head.unionByName(rest)


def drift_report(
    severity: DataFrame, top: DataFrame, p_values: DataFrame, decay: DataFrame, psi: DataFrame, run: str = "run_id"
) -> DataFrame:
    """One nested row per run: severity, top columns, root cause, PSI map, category p-values, decay."""
    leaders = top.groupBy(run).agg(
        F.sort_array(F.collect_list(F.struct("rank", "column", "psi", "mean_change_pct"))).alias("top_features")
    )
    values = psi.groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct("column", "psi"))).alias("feature_psi_map"))
    tails = p_values.groupBy(run).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "p_value"))).alias("categorical_drift_p_values")
    )
    return (
        severity.join(leaders, run, "left").join(values, run, "left").join(tails, run, "left")
        .join(decay.select(run, "accuracy_decay_pct"), run, "left")
        .withColumns({"root_cause": F.get("top_features", F.lit(0)), "cold_start": F.lit(False)})
    )


def of_last_run(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the newest run in the table."""
    return df.where(F.col(run) == df.agg(F.max(run)).scalar())


def of_run(df: DataFrame, run_id: str, run: str = "run_id") -> DataFrame:
    return df.where(F.col(run) == run_id)


def entity_risk(register: DataFrame, scored: DataFrame, masked: bool = False, entity: str = "employee_id", run: str = "run_id") -> DataFrame:
    """Current risk of each entity with the explanation from its last run, that of the record whose score stands for it."""
    key = [entity, "last_run_id"]
    used = [c for c in ("final_anomaly_score", "explanation") if c in scored.columns]
    told = scored.select(F.col(entity).cast("string").alias(entity), F.col(run).alias("last_run_id"), *used)
    # Joined before it is grouped: only records of a last run are sorted, and once. The register has one row per entity.
    found = register.join(told, key, "left").groupBy(*key)
    kept = [F.first(c).alias(c) for c in register.columns if c not in key]
    out = found.agg(*kept, F.coalesce(_told(told), F.lit("")).alias("explanation")).select(*register.columns, "explanation")
    return out.withColumn(entity, mask_id(F.col(entity))) if masked else out


def find_entities(df: DataFrame, pattern: str, entity: str = "employee_id") -> DataFrame:
    """Rows whose id matches a pattern, in any letter case."""
    return df.where(F.col(entity).cast("string").rlike(f"(?i){pattern}"))


def display_table(report: DataFrame) -> DataFrame:
    """The columns shown to people, under readable headings; older column names are accepted."""
    names = {"take_home": "net_salary", "anomaly_score": "risk_score", "final_anomaly_score": "risk_score"}
    for old, new in names.items():
        if old in report.columns and new not in report.columns:
            report = report.withColumnRenamed(old, new)
    return report.select(*[F.col(c).alias(title_words(c)) for c in DISPLAY if c in report.columns])


def alert_log(alerts: DataFrame, time: str = "timestamp") -> DataFrame:
    """Alerts for display, with the time cut to seconds."""
    # Headings.
    headings = {
        "timestamp": "Timestamp", "severity": "Severity", "alert_type": "Alert Type",
        "affected_entity": "Affected Component", "trigger_value": "Trigger Value",
        "recommended_action": "Action Recommendation",
    }
    shown = alerts.withColumn(time, F.substring(F.col(time).cast("string"), 1, 19)) if time in alerts.columns else alerts
    return shown.select(*[F.col(c).alias(h) for c, h in headings.items() if c in shown.columns])


def model_health(decisions: DataFrame, folds: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, model_name, metric, stability_score): the real figures of each model."""
    return decisions.select(run, "model_name", F.col("challenger").alias("metric"), "promoted").join(
        folds.select(run, "model_name", "stability_score"), [run, "model_name"], "left"
    )


def health_by_run(
    training: DataFrame, detector: str = "anomaly_detector", forecaster: str = "company_payroll_forecaster", run: str = "run_id"
) -> DataFrame:
    """(run, model_version, forecaster_version, forecaster_mape, anomaly_detector_f1, stability_score): one row per run.

    ``training`` has one row per run and model, with ``version_id``, ``metric`` and ``stability_score``. The stability is the detector's.
    """
    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model_name") == model, F.col(column)))

    # What stands for a model that a run has not trained.
    return training.groupBy(run).agg(
        F.coalesce(of(detector, "version_id"), F.lit("unknown")).alias("model_version"),
        F.coalesce(of(forecaster, "version_id"), F.lit("unknown")).alias("forecaster_version"),
        F.coalesce(of(forecaster, "metric"), F.lit(0.0)).alias("forecaster_mape"),
        F.coalesce(of(detector, "metric"), F.lit(0.0)).alias("anomaly_detector_f1"),
        of(detector, "stability_score").alias("stability_score"),
    )


def schema_report(quality: DataFrame, run: str = "run_id") -> DataFrame:
    return quality.select(run, "schema_confidence", "mapped_columns", "unmapped_columns", "warnings")
