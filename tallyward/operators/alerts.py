"""Alert rows from the results of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.scalars import fixed, is_high_risk
from tallyward.operators.drift import is_overtime_column, is_pay_column
from tallyward.operators.quantiles import exact_quantiles
from tallyward.operators.settling import Size, attach, measure

ALERT_SCHEMA = (
    "alert_type string, severity string, run_id string, affected_entity string, trigger_value double, "
    "threshold_value double, recommended_action string, stage int"
)

# Order of the stages that emit alerts.
STAGES = {"training": 2, "scoring": 3, "forecast": 4, "risk": 5, "drift": 6, "policy": 7, "system": 9}


def alert_rows(
    df: DataFrame,
    alert_type: Column | str,
    severity: Column | str,
    entity: Column,
    stage: str,
    trigger: Column | None = None,
    threshold: Column | float | None = None,
    action: Column | str = "",
    run: str = "run_id",
) -> DataFrame:
    """Each row of ``df`` as one alert in the common shape."""
    def text(v: Column | str) -> Column:
        return F.lit(v) if isinstance(v, str) else v

    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.select(
        text(alert_type).alias("alert_type"), text(severity).alias("severity"),
        F.col(run).cast("string").alias("run_id"), entity.cast("string").alias("affected_entity"),
        (F.lit(None) if trigger is None else trigger).cast("double").alias("trigger_value"),
        limit.cast("double").alias("threshold_value"),
        text(action).alias("recommended_action"), F.lit(STAGES[stage]).alias("stage"),
    )


def dedupe_alerts(alerts: DataFrame) -> DataFrame:
    """The first alert per run, type and entity, by stage. Combines before the shuffle."""
    body = F.struct("stage", "severity", "trigger_value", "threshold_value", "recommended_action")
    return (
        alerts.groupBy("run_id", "alert_type", "affected_entity")
        .agg(F.min(body).alias("body"))
        .select(
            "alert_type", "body.severity", "run_id", "affected_entity", "body.trigger_value",
            "body.threshold_value", "body.recommended_action", "body.stage",
        )
    )


def high_risk_alerts(scored: DataFrame, entity: str = "employee_id", run: str = "run_id") -> DataFrame:
    hit = scored.where(is_high_risk(F.col("risk_tier")))
    return alert_rows(
        hit, "HIGH_RISK_EMPLOYEE_ALERT", F.col("risk_tier"), F.col(entity), "scoring",
        F.col("final_anomaly_score"), None, F.col("explanation"), run,
    )


def spike_alerts(history: DataFrame, run: str = "run_id") -> DataFrame:
    """From ``forecast.spikes``."""
    total, prior = F.col("predicted_total"), F.col("prior_total")
    # Wording of the recommendation.
    action = F.concat(
        F.lit("Upcoming payroll prediction "), fixed(total, 0),
        F.lit(" is > 20% higher than prior total "), fixed(prior, 0), F.lit(". Audit department budgets."),
    )
    return alert_rows(
        history.where("is_spike"), "FORECAST_PAYROLL_SPIKE_ALERT", "HIGH", F.lit("company_payroll"),
        "forecast", total, prior * 1.20, action, run,
    )


def risk_alerts(assessed: DataFrame, entity: str = "employee_id", run: str = "run_id") -> DataFrame:
    """Absenteeism, manipulation and escalation, each row giving as many alerts as it has flags.

    Optional columns ``absenteeism_score`` and ``salary_manipulation_score`` become trigger values.
    """
    have = set(assessed.columns)
    missing = F.lit(None).cast("double")
    share = F.col("absenteeism_score") if "absenteeism_score" in have else missing
    decision = F.col("salary_manipulation_score") if "salary_manipulation_score" in have else missing
    who = F.col(entity).cast("string")
    # Types, severities and wording of the three alerts.
    away = F.concat(
        F.lit("Absenteeism risk score "), F.coalesce(fixed(share, 2), F.lit("")),
        F.lit(" exceeds threshold 0.7 for employee "), who, F.lit("."),
    )
    forged = F.concat(F.lit("Salary manipulation detected for employee "), who, F.lit("."))
    rising = F.concat(F.lit("Risk score has escalated consecutively over 3 runs for employee "), who, F.lit("."))

    def entry(flag: str, kind: str, severity: str, trigger: Column, limit: Column, action: Column) -> Column:
        return F.when(
            F.col(flag),
            F.struct(
                F.lit(kind).alias("kind"), F.lit(severity).alias("level"), trigger.cast("double").alias("trigger"),
                limit.cast("double").alias("limit"), action.alias("advice"),
            ),
        )

    entries = F.array(
        entry("absenteeism", "ABSENTEEISM_RISK_ALERT", "MEDIUM", share, F.lit(0.7), away),
        entry("salary_manipulation", "SALARY_MANIPULATION_ALERT", "CRITICAL", decision, missing, forged),
        entry("escalation", "RISK_ESCALATION_ALERT", "HIGH", F.col("score"), missing, rising),
    )
    fired = assessed.select(F.col(entity), F.col(run), F.inline(F.array_compact(entries)))
    return alert_rows(
        fired, F.col("kind"), F.col("level"), F.col(entity), "risk",
        F.col("trigger"), F.col("limit"), F.col("advice"), run,
    )


def drift_alerts(psi_table: DataFrame, run: str = "run_id", loose: bool = False) -> DataFrame:
    """Pay, overtime and catastrophic drift alerts from a PSI table."""
    name, value = F.col("column"), F.col("psi")
    size_text = fixed(value, 3)
    # Types, severities, limits and wording of the three alerts.
    pay = F.concat(F.lit("Salary feature '"), name, F.lit("' drifted with PSI="), size_text, F.lit(". Auditing salary ranges."))
    hours = F.concat(F.lit("Overtime feature '"), name, F.lit("' drifted with PSI="), size_text, F.lit(". Reviewing overtime policies."))
    worst = F.concat(F.lit("Catastrophic drift in feature '"), name, F.lit("' (PSI="), size_text, F.lit("). Triggering retrain."))

    def entry(hit: Column, kind: str, severity: str, limit: float, action: Column) -> Column:
        return F.when(
            hit,
            F.struct(
                F.lit(kind).alias("kind"), F.lit(severity).alias("level"),
                F.lit(limit).alias("limit"), action.alias("advice"),
            ),
        )

    entries = F.array(
        entry(is_pay_column(name) & (value > 0.25), "SALARY_DRIFT_ALERT", "HIGH", 0.25, pay),
        entry(is_overtime_column(name, loose) & (value > 0.25), "OVERTIME_DRIFT_ALERT", "HIGH", 0.25, hours),
        entry(value > 10.0, "PAYROLL_DATA_DRIFT_ALERT", "CRITICAL", 10.0, worst),
    )
    fired = psi_table.select(F.col(run), name, value, F.inline(F.array_compact(entries)))
    return alert_rows(
        fired, F.col("kind"), F.col("level"), F.col("column"), "drift", F.col("psi"), F.col("limit"), F.col("advice"), run
    )


def decay_alerts(decay: DataFrame, run: str = "run_id", error: str = "mape") -> DataFrame:
    """Forecast accuracy alerts from ``drift.accuracy_decay``."""
    now, prior = F.col(error), F.col(f"prior_{error}")
    delta = now - prior

    def pct(x: Column) -> Column:
        return F.concat(fixed(x * 100, 2), F.lit("%"))

    # Limits and wording.
    worse = F.concat(
        F.lit("Forecast MAPE increased by "), pct(delta), F.lit(" (from "), pct(prior), F.lit(" to "), pct(now),
        F.lit("). Recalibrating thresholds."),
    )
    critical = F.concat(F.lit("Critical MAPE decay of "), pct(delta), F.lit(" detected. Triggering emergency model retrain."))
    who = F.lit("company_payroll_forecaster")
    high = alert_rows(
        decay.where(delta > 0.05), "FORECAST_ACCURACY_DECAY_ALERT", "HIGH", who, "drift", now, prior + 0.05, worse, run
    )
    severe = alert_rows(
        decay.where(delta > 0.20), "CRITICAL_MODEL_HEALTH_ALERT", "CRITICAL", who, "drift", now, prior + 0.20, critical, run
    )
    return high.unionByName(severe)


def miss_alerts(scores: DataFrame, limit: float = 50000.0, run: str = "run_id", entity: str = "model") -> DataFrame:
    """One alert per run and model whose mean absolute error (``forecast.decay_score``) passed the limit."""
    # Type and severity.
    return alert_rows(
        scores.where("decayed"), "Accuracy Decay", "HIGH", F.col(entity), "drift", F.col("drift_score"), limit,
        "Mean absolute error of the forecast is over its limit.", run,
    )


def policy_alerts(policy: DataFrame, run: str = "run_id") -> DataFrame:
    """Emergency retrain notice, when a retrain ran and accuracy fell by more than 20 points."""
    hit = policy.where(F.col("retrain_triggered") & (F.col("accuracy_decay_pct") > 20.0))
    return alert_rows(
        hit, "CRITICAL_MODEL_HEALTH_ALERT", "CRITICAL", F.lit("company_payroll_forecaster"), "policy",
        F.col("accuracy_decay_pct"), 20.0,
        "Emergency model retrain completed due to extreme accuracy decay.", run,
    )


def cold_start_notices(pairs: DataFrame, run: str = "run_id") -> DataFrame:
    """One notice for each run without a reference run."""
    return alert_rows(
        pairs.where("reference_run IS NULL"), "COLD_START_NOTICE", "INFO", F.lit("model_monitoring"), "drift",
        action="First run recorded as baseline reference distributions. Drift monitoring skipped.", run=run,
    )


def retrain_alerts(decisions: DataFrame, run: str = "run_id") -> DataFrame:
    """Challengers that lost, from ``evaluation.champion_decisions``."""
    lower = F.col("lower_is_better")
    # Wording.
    action = F.concat(
        F.lit("Retrained "), F.replace(F.col("model_name"), F.lit("_"), F.lit(" ")), F.lit(" did not improve "),
        F.when(lower, "MAPE").otherwise("F1 score"), F.lit(" by 5%. Retained champion."),
    )
    return alert_rows(
        decisions.where("NOT promoted"), "RETRAIN_FAILED", "WARNING", F.col("model_name"), "training",
        F.col("challenger"), F.col("bar"), action, run,
    )


def failure_alerts(failures: DataFrame, run: str = "run_id") -> DataFrame:
    """Failed runs from the ledger; the error text leads the recommendation."""
    action = F.concat_ws(": ", F.col("error"), F.lit("Investigate pipeline logs immediately."))
    return alert_rows(failures, "PIPELINE_FAILURE_ALERT", "CRITICAL", F.lit("system"), "system", action=action, run=run)


def system_alerts(
    batch: DataFrame,
    diff: str = "salary_diff",
    level: str = "final_risk_level",
    pay: str = "updated_net_salary",
    run: str = "run_id",
    size: Size | None = None,
) -> DataFrame:
    """(run, type, severity, message, metric): health checks of a batch, or one all-clear row per run."""
    size = size or measure(batch)
    have = set(batch.columns)
    stats = [F.avg(diff).alias("mean"), F.stddev_samp(diff).alias("sigma")]
    if level in have:
        stats.append(F.avg((F.col(level) == 3).cast("double")).alias("share"))
    if pay in have:
        stats += [F.avg(pay).alias("pay_mean"), F.stddev_samp(pay).alias("pay_sigma"), F.max(pay).alias("pay_max")]
    middles = exact_quantiles(batch, [run], [diff], [0.5], size).select(run, F.col("quantiles")[0].alias("middle"))
    apart = attach(batch.select(run, diff), middles, [run], size).select(
        run, F.abs(F.col(diff) - F.col("middle")).alias("apart")
    )
    mads = exact_quantiles(apart, [run], ["apart"], [0.5], size).select(run, F.col("quantiles")[0].alias("mad"))
    one = batch.groupBy(run).agg(*stats).join(mads, run, "left")
    shift = F.abs("mean")

    def entry(hit: Column, kind: str, severity: str, message: str, metric: Column) -> Column:
        return F.when(
            hit,
            F.struct(
                F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(message).alias("message"),
                metric.cast("double").alias("metric"),
            ),
        )

    none = F.lit(None).cast("double")
    # Types, severities, limits and messages of the checks.
    checks = [
        entry((F.col("sigma") > 0) & (shift > 0.5 * F.col("sigma")), "DATA_DRIFT", "HIGH",
              "Possible payroll logic drift detected.", shift),
        entry(F.col("mad") < 0.01, "SYSTEMATIC_SHIFT", "CRITICAL",
              "Possible systematic uniform shift in payroll.", none),
    ]
    if level in have:
        checks.append(
            entry(F.col("share") > 0.15, "ANOMALY_SPIKE", "CRITICAL",
                  "Abnormally high anomaly concentration detected.", F.col("share"))
        )
    if pay in have:
        far = F.col("pay_max") > F.col("pay_mean") + 3 * F.col("pay_sigma")
        checks.append(
            entry((F.col("pay_sigma") > 0) & far, "PAYROLL_SPIKE", "MEDIUM", "Unusual payroll spike detected.", none)
        )
    fired = F.array_compact(F.array(*checks))
    healthy = F.array(
        F.struct(
            F.lit("SYSTEM_HEALTHY").alias("type"), F.lit("INFO").alias("severity"),
            F.lit("No anomalies detected.").alias("message"), none.alias("metric"),
        )
    )
    return one.select(run, F.inline(F.when(F.size(fired) > 0, fired).otherwise(healthy)))
