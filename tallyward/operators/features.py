"""Derived pay features and robust z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.scalars import numbers, ratio
from tallyward.operators.quantiles import exact_quantiles, widen
from tallyward.operators.schema import numeric_columns
from tallyward.operators.settling import Size, attach, measure, stage


def _last_named(columns: Sequence[str], *parts: str) -> str | None:
    hits = [c for c in columns if all(p in c for p in parts)]
    return hits[-1] if hits else None


def pay_features(df: DataFrame, run: str = "run_id", size: Size | None = None) -> DataFrame:
    """Add the derived columns the present roles allow. Division by zero days gives null."""
    have = set(df.columns)

    def ready(*names: str) -> bool:
        return set(names) <= have

    def add(df: DataFrame, name: str, value) -> DataFrame:
        have.add(name)
        return df.withColumn(name, value)

    tax, fund = _last_named(df.columns, "tax", "deduct"), _last_named(df.columns, "pf", "deduct")
    if ready("present_days", "total_working_days"):
        df = add(df, "attendance_ratio", ratio(F.col("present_days"), F.col("total_working_days")))
    if ready("overtime_hours", "overtime_pay_per_hour"):
        df = add(df, "overtime_pay", F.col("overtime_hours") * F.col("overtime_pay_per_hour"))
    if ready("base_salary", "total_working_days", "present_days"):
        daily = ratio(F.col("base_salary"), F.col("total_working_days"))
        df = add(df, "earned_base", daily * F.col("present_days"))
    if ready("earned_base"):
        extra = F.col("overtime_pay") if ready("overtime_pay") else F.lit(0)
        df = add(df, "expected_gross_salary", F.col("earned_base") + extra)
        deductions = (F.col(tax) if tax else F.lit(0)) + (F.col(fund) if fund else F.lit(0))
        df = add(df, "expected_net", F.col("expected_gross_salary") - deductions)
    if ready("net_salary", "expected_net"):
        df = add(df, "salary_diff", F.col("net_salary") - F.col("expected_net"))
    if ready("base_salary", "designation"):
        means = df.groupBy(run, "designation").agg(F.avg("base_salary").alias("peer_mean"))
        df = attach(df, means, [run, "designation"], size)
        apart = F.try_divide(F.col("base_salary") - F.col("peer_mean"), F.col("peer_mean")) * 100.0
        df = add(df, "salary_dev_pct", F.when(F.col("peer_mean") == 0, 0.0).otherwise(apart)).drop("peer_mean")
    unused = [c for c in (tax, fund) if c]
    return df.drop(*unused)


def robust_z(
    df: DataFrame, columns: Sequence[str] | None = None, run: str = "run_id", size: Size | None = None
) -> DataFrame:
    """Add ``robust_z_<c>`` = (x - median) / MAD per run, 0 where the MAD is 0.

    Two selections serve all columns: one for the medians, one for the deviations.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    size = size or measure(df)
    centers = exact_quantiles(df, [run], columns, [0.5], size)
    middle = F.col("quantiles")[0]
    centered = attach(df, widen(centers, [run], columns, middle, "median_"), [run], size)
    finite = numbers(df, columns)
    apart = centered.select(run, *[F.abs(finite[c] - F.col(f"median_{c}")).alias(c) for c in columns])
    spreads = exact_quantiles(apart, [run], columns, [0.5], size)
    scored = attach(centered, widen(spreads, [run], columns, middle, "mad_"), [run], size)
    z = {
        f"robust_z_{c}": F.when(F.col(f"mad_{c}") == 0, 0.0).otherwise(
            (finite[c] - F.col(f"median_{c}")) / F.col(f"mad_{c}")
        )
        for c in columns
    }
    helpers = [p + c for c in columns for p in ("median_", "mad_")]
    return scored.withColumns(z).drop(*helpers)


def feature_table(df: DataFrame, run: str = "run_id", size: Size | None = None) -> DataFrame:
    """Clean records to the full feature table. The derived columns are staged, as the z-scores pass over them."""
    return robust_z(stage(pay_features(df, run, size), "features"), run=run, size=size)
