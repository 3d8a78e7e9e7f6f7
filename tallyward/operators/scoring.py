"""Anomaly score, tier and explanation of each record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.scalars import fixed, is_high_risk, mean_present, min_max, risk_tier
from tallyward.operators.rules import apply_rules, group_statistics, rule_score, run_statistics
from tallyward.operators.settling import Size, attach, measure

# Weights of the score components.
RULE_WEIGHT, Z_WEIGHT, MODEL_WEIGHT = 0.4, 0.3, 0.3
# The columns whose robust z-scores enter score and explanation.
Z_COLUMNS = ("base_salary", "salary_dev_pct")


def z_mean(df: DataFrame) -> Column:
    """Mean absolute z of base salary and peer deviation, over those present."""
    used = [f"robust_z_{c}" for c in Z_COLUMNS if f"robust_z_{c}" in df.columns]
    return mean_present([F.abs(c) for c in used]) if used else F.lit(0.0)


def _oddness(df: DataFrame, decision: str) -> Column:
    return -F.col(decision) if decision in df.columns else F.lit(0.0)


def component_bounds(df: DataFrame, decision: str = "decision") -> list[Column]:
    """The per-run aggregates the two scaled components need."""
    z, odd = z_mean(df), _oddness(df, decision)
    return [
        F.min(z).alias("z_low"), F.max(z).alias("z_high"), F.min(odd).alias("odd_low"), F.max(odd).alias("odd_high")
    ]


def apply_components(df: DataFrame, decision: str = "decision") -> DataFrame:
    """Add ``z_component`` and ``model_component`` to rows that carry the bounds of their run."""
    out = df.withColumns(
        {
            "z_component": min_max(z_mean(df), F.col("z_low"), F.col("z_high")),
            "model_component": min_max(_oddness(df, decision), F.col("odd_low"), F.col("odd_high")),
        }
    )
    return out.drop("z_low", "z_high", "odd_low", "odd_high")


def with_components(
    df: DataFrame, run: str = "run_id", decision: str = "decision", size: Size | None = None
) -> DataFrame:
    """Add ``z_component`` and ``model_component``, both scaled to 0..1 per run.

    A flat component is 0, and so is the model component of a table without forest decisions.
    """
    size = size or measure(df)
    bounds = df.groupBy(run).agg(*component_bounds(df, decision))
    return apply_components(attach(df, bounds, [run], size), decision)


def score_records(
    df: DataFrame,
    run: str = "run_id",
    decision: str = "decision",
    absent: Sequence[str] = (),
    size: Size | None = None,
) -> DataFrame:
    """Features (with an optional forest decision) to ``final_anomaly_score``, ``risk_tier``, ``explanation``.

    Two aggregates precede the scoring pass: one per run for all components, one per department.
    """
    size = size or measure(df)
    features = [c for c in df.columns if c != decision]
    stats = df.groupBy(run).agg(*component_bounds(df, decision), *run_statistics(df))
    rows = attach(df, stats, [run], size)
    own = group_statistics(df, run)
    if own is not None:
        rows = attach(rows, own, [run, "department"], size)
    parts = apply_rules(apply_components(rows, decision))
    final = (
        RULE_WEIGHT * rule_score()
        + Z_WEIGHT * F.col("z_component")
        + MODEL_WEIGHT * F.col("model_component")
    )
    scored = parts.withColumn("final_anomaly_score", final)
    scored = scored.withColumn("risk_tier", risk_tier(F.col("final_anomaly_score")))
    scored = scored.withColumn("explanation", explanation(scored, absent))
    return scored.select(*features, "final_anomaly_score", "risk_tier", "explanation")


def explanation(df: DataFrame, absent: Sequence[str] = ()) -> Column:
    """Text for HIGH and CRITICAL records, empty otherwise. Needs the columns ``score_records`` adds."""
    have = set(df.columns)
    # Wording and number formats of the explanation.
    details = []
    if "breaks_salary_diff" in have:
        details.append(
            F.when(
                F.col("breaks_salary_diff"),
                F.concat(
                    F.lit("salary_diff ("), fixed(F.col("salary_diff"), 0), F.lit(") exceeded 1σ ("),
                    fixed(F.col("salary_diff_sigma"), 0), F.lit(")"),
                ),
            )
        )
    if "breaks_salary_dev_pct" in have:
        details.append(
            F.when(
                F.col("breaks_salary_dev_pct"),
                F.concat(
                    F.lit("salary_dev_pct ("), fixed(F.col("salary_dev_pct"), 1), F.lit("%) exceeded 1σ ("),
                    fixed(F.col("salary_dev_pct_sigma"), 1), F.lit("%)"),
                ),
            )
        )
    if "breaks_overtime" in have:
        whose = "dept" if "department" in have else "global"
        details.append(
            F.when(
                F.col("breaks_overtime"),
                F.concat(
                    F.lit("overtime_hours ("), F.col("overtime_hours").cast("string"),
                    F.lit(f") exceeded {whose} limit ("), fixed(F.col("overtime_limit"), 1), F.lit(")"),
                ),
            )
        )
    z_scores = [
        F.concat(F.lit(f"{label}: "), fixed(F.col(c), 2))
        for label, c in (("Z-base", "robust_z_base_salary"), ("Z-dev", "robust_z_salary_dev_pct"))
        if c in have
    ]
    detail_text = F.concat_ws("; ", *details)
    parts = [
        F.concat(
            F.lit("Risk Tier: "), F.col("risk_tier"), F.lit(" (Score: "),
            fixed(F.col("final_anomaly_score"), 2), F.lit(")"),
        ),
        F.concat(
            F.lit("Rules violated: "), F.col("rules_violated").cast("string"), F.lit("/"),
            F.col("rules_evaluated").cast("string"),
        ),
        F.when(F.length(detail_text) > 0, F.concat(F.lit("Details: "), detail_text)),
        F.concat(F.lit("Robust Z-Scores: "), F.concat_ws(", ", *z_scores)) if z_scores else F.lit(None),
        F.concat(F.lit("Model Anomaly Score: "), fixed(F.col("model_component"), 2)),
        F.lit("Absent features (schema mismatch): " + ", ".join(absent)) if absent else F.lit(None),
    ]
    return F.when(is_high_risk(F.col("risk_tier")), F.concat_ws(". ", *parts)).otherwise("")
