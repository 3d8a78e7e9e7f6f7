"""Rule checks on scored features: deviations beyond one sigma, overtime beyond two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.operators.profile import with_spread
from tallyward.operators.settling import Size, attach, measure

# Columns the rules add; ``rule_columns`` lists those a scored row carries.
SIGMA_RULES = ["salary_diff", "salary_dev_pct"]


def _checked(df: DataFrame) -> list[str]:
    return [c for c in SIGMA_RULES if c in df.columns]


def run_statistics(df: DataFrame) -> list[Column]:
    """The per-run aggregates the rules need."""
    stats = [F.stddev_samp(c).alias(f"{c}_sigma") for c in _checked(df)]
    if "overtime_hours" in df.columns:
        stats += [F.avg("overtime_hours").alias("all_mean"), F.stddev_samp("overtime_hours").alias("all_sigma")]
    return stats


def group_statistics(df: DataFrame, run: str = "run_id") -> DataFrame | None:
    """Overtime mean and deviation per department, where both columns exist."""
    if not {"overtime_hours", "department"} <= set(df.columns):
        return None
    return df.groupBy(run, "department").agg(
        F.avg("overtime_hours").alias("own_mean"), F.stddev_samp("overtime_hours").alias("own_sigma")
    )


def with_rules(df: DataFrame, run: str = "run_id", size: Size | None = None) -> DataFrame:
    """Attach sigmas and limits, ``breaks_*`` flags, ``rules_evaluated`` and ``rules_violated``.

    A sigma of null or 0 takes its rule out of the count. The overtime rule counts whenever the column exists.
    """
    size = size or measure(df)
    stats, own = run_statistics(df), group_statistics(df, run)
    out = attach(df, df.groupBy(run).agg(*stats), [run], size) if stats else df
    if own is not None:
        out = attach(out, own, [run, "department"], size)
    return apply_rules(out)


def apply_rules(out: DataFrame) -> DataFrame:
    """The rules on rows that already carry their run and group statistics."""
    checked = _checked(out)
    hours = "overtime_hours" in out.columns
    grouped = "own_mean" in out.columns
    evaluated, violated = F.lit(0), F.lit(0)
    added: dict[str, Column] = {}
    for c in checked:
        usable = F.coalesce(F.col(f"{c}_sigma") > 0, F.lit(False))
        hit = F.coalesce(usable & (F.abs(c) > F.col(f"{c}_sigma")), F.lit(False))
        added[f"breaks_{c}"] = hit
        evaluated = evaluated + usable.cast("int")
    if hours:
        means = [F.col("own_mean")] if grouped else []
        sigmas = [F.col("own_sigma")] if grouped else []
        middle = F.coalesce(*means, F.col("all_mean"))
        added["overtime_limit"] = middle + 2 * F.coalesce(*sigmas, F.col("all_sigma"), F.lit(0.0))
        evaluated = evaluated + F.lit(1)
    out = out.withColumns(added)
    if hours:
        hit = F.coalesce(F.col("overtime_hours") > F.col("overtime_limit"), F.lit(False))
        out = out.withColumn("breaks_overtime", hit)
        out = out.drop("all_mean", "all_sigma", "own_mean", "own_sigma")
    for c in [f"breaks_{c}" for c in checked] + (["breaks_overtime"] if hours else []):
        violated = violated + F.col(c).cast("int")
    return out.withColumns({"rules_evaluated": evaluated, "rules_violated": violated})


def rule_score() -> Column:
    """Share of evaluated rules a row breaks."""
    return F.coalesce(F.try_divide(F.col("rules_violated"), F.col("rules_evaluated")), F.lit(0.0))


def rule_target(df: DataFrame, run: str = "run_id", size: Size | None = None) -> DataFrame:
    """Add ``rule_target``: whether a row breaks any rule."""
    return with_rules(df, run, size).withColumn("rule_target", F.col("rules_violated") > 0)


def contamination(df: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, rate, contamination): expected outlier share, kept between 5 and 50 percent."""
    rate = F.avg(F.col("rule_target").cast("double"))
    return df.groupBy(run).agg(
        rate.alias("rate"), F.least(F.lit(0.5), F.greatest(F.lit(0.05), rate)).alias("contamination")
    )


def absenteeism_label() -> Column:
    return F.col("present_days") < F.col("total_working_days") * 0.9


def overtime_abuse(df: DataFrame, run: str = "run_id", size: Size | None = None) -> DataFrame:
    """Add ``overtime_calc``: hours beyond the department median plus two sigmas."""
    if "overtime_hours" not in df.columns:
        return df.withColumn("overtime_calc", F.lit(False))
    out = with_spread(df, "overtime_hours", "department", run, center="median", size=size)
    limit = F.col("overtime_hours_center") + 2 * F.col("overtime_hours_spread")
    hit = F.coalesce(F.col("overtime_hours") > limit, F.lit(False))
    return out.withColumn("overtime_calc", hit).drop("overtime_hours_center", "overtime_hours_spread")
