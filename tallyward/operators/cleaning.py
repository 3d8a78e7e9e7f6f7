"""Cleaning of canonical records, per run.

``trace_cleaning`` computes every rule as columns on the de-duplicated rows. The clean rows and the
rule counters are both read from it, so counters cost one aggregate, not one count per rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.errors import DataCleaningError, InsufficientDataError
from tallyward.functions.scalars import INTEGERS, numbers, whole_number
from tallyward.operators.quality import collapse_copies
from tallyward.operators.quantiles import exact_quantiles
from tallyward.operators.schema import CANONICAL, WHOLE_NUMBERS
from tallyward.operators.settling import Size, attach, measure, stage

# Fallback day count, warning limits in percent, smallest usable run.
FULL_MONTH = 23
REMOVAL_LIMIT = 10.0
MIN_ROWS = 5
REQUIRED = ["employee_id", "base_salary", "net_salary"]


def _have(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def group_median(df: DataFrame, column: str, run: str, size: Size | None = None) -> DataFrame:
    """(run, median), exact for runs of any size."""
    q = exact_quantiles(df, [run], [column], [0.5], size)
    return q.select(run, F.col("quantiles")[0].alias("median"))


def group_mode(df: DataFrame, column: str, run: str) -> DataFrame:
    """(run, mode): the most frequent value, the smallest on ties. Counts combine per value first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(run, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(run).agg(F.max_by(column, F.struct("n", -F.col(column))).alias("mode"))


def drop_missing_required(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=[c for c in REQUIRED if c in df.columns])


def drop_nonpositive_pay(df: DataFrame) -> DataFrame:
    for c in ("base_salary", "net_salary"):
        if c in df.columns:
            df = df.where(F.col(c) > 0)
    return df


def fill_categories(df: DataFrame) -> DataFrame:
    return df.na.fill("Unknown", subset=[c for c in ("department", "designation") if c in df.columns])


def to_whole_numbers(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: whole_number(c, kinds[c]) for c in WHOLE_NUMBERS if c in kinds})


def trace_cleaning(df: DataFrame, run: str = "run_id", size: Size | None = None) -> DataFrame:
    """Distinct rows with their final values, ``copies``, and one flag per rule (``rule_*``).

    ``kept`` marks the rows that survive. Numbers are read before the checks, so text cannot fail them.
    """
    size = size or measure(df)
    have = set(df.columns)
    figures = [c for c in WHOLE_NUMBERS if c in have]
    rows = collapse_copies(df)
    if not size.small:
        # Removing copies moves every row once; the passes below then read the result.
        rows = stage(rows, "distinct")
    kinds = dict(df.dtypes)
    fractional = {c: x for c, x in numbers(df, figures).items() if kinds[c] not in INTEGERS}
    rows = rows.withColumns(fractional) if fractional else rows

    def missing(c: str) -> Column:
        return F.col(c).isNull()

    # Step 1: what is missing, and which rows lack a required value.
    complete = F.lit(True)
    for c in REQUIRED:
        if c in have:
            complete = complete & F.col(c).isNotNull()
    found = {f"rule_null_before_{c}": missing(c) for c in df.columns if c != run}
    found |= {"complete": complete, "rule_dropped_null_required": ~complete}
    fillable = [
        "department", "designation", "present_days", "total_working_days",
        "overtime_hours", "overtime_pay_per_hour",
    ]
    found |= {f"rule_{c}_filled": complete & missing(c) for c in fillable if c in have}
    rows = rows.withColumns(found)

    # Step 2: fill.
    usable = rows.where("complete").select(run, *figures)
    if "present_days" in have:
        rows = attach(rows, group_median(usable, "present_days", run, size), [run], size)
    if "total_working_days" in have:
        rows = attach(rows, group_mode(usable, "total_working_days", run), [run], size)
    fills = {
        "department": F.lit("Unknown"),
        "designation": F.lit("Unknown"),
        "present_days": F.coalesce(F.expr("cast(median as bigint)"), F.lit(FULL_MONTH)),
        "total_working_days": F.coalesce(F.expr("cast(mode as bigint)"), F.lit(FULL_MONTH)),
        "overtime_hours": F.lit(0),
        "overtime_pay_per_hour": F.lit(0),
    }
    rows = rows.withColumns({c: F.coalesce(F.col(c), fills[c]) for c in fillable if c in have})
    rows = rows.drop("median", "mode")
    days_known = {"lop_days", "total_working_days", "present_days"} <= have
    if days_known:
        rows = rows.withColumn("lop_days", F.col("total_working_days") - F.col("present_days"))

    # Step 3: mark impossible values, in the order the rules apply.
    kept = F.col("complete")
    fixes: dict[str, Column] = {}
    if {"present_days", "total_working_days"} <= have:
        over = F.col("present_days") > F.col("total_working_days")
        fixes["rule_present_days_capped"] = F.col("complete") & over
    for c in ("present_days", "lop_days", "overtime_hours"):
        if c in have:
            x = F.least(c, "total_working_days") if c == "present_days" and "total_working_days" in have else F.col(c)
            fixes[f"rule_{c}_zeroed"] = F.coalesce(F.col("complete") & (x < 0), F.lit(False))
    for c in ("base_salary", "net_salary"):
        if c in have:
            fixes[f"rule_{c}_nonpositive_dropped"] = F.coalesce(kept & (F.col(c) <= 0), F.lit(False))
            kept = kept & F.coalesce(F.col(c) > 0, F.lit(False))
    fixes["kept"] = kept
    if "overtime_pay_per_hour" in have:
        fixes["rule_overtime_pay_per_hour_zeroed"] = kept & (F.col("overtime_pay_per_hour") < 0)
    rows = rows.withColumns(fixes)

    # Step 4: correct them.
    final: dict[str, Column] = {}
    if "present_days" in have:
        days = F.col("present_days")
        capped = F.least(days, F.col("total_working_days")) if "total_working_days" in have else days
        final["present_days"] = F.greatest(capped, F.lit(0))
    for c in ("overtime_hours", "overtime_pay_per_hour"):
        if c in have:
            final[c] = F.greatest(F.col(c), F.lit(0))
    rows = rows.withColumns(final) if final else rows
    if days_known:
        rows = rows.withColumn("lop_days", F.col("total_working_days") - F.col("present_days"))
    elif "lop_days" in have:
        rows = rows.withColumn("lop_days", F.greatest(F.coalesce("lop_days", F.lit(0)), F.lit(0)))
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in figures})


def rule_names(traced: DataFrame) -> list[str]:
    return [c for c in traced.columns if c.startswith("rule_")]


def clean_rows(traced: DataFrame) -> DataFrame:
    extra = [*rule_names(traced), "complete", "kept", "copies"]
    return traced.where("kept").drop(*extra)


def clean_records(df: DataFrame, run: str = "run_id", size: Size | None = None) -> DataFrame:
    """Clean canonical records. Columns outside the canonical schema ride along unchanged."""
    return clean_rows(trace_cleaning(df, run, size))


def cleaning_summary(traced: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run: rows before and after, removal share, warnings and a counter per rule."""
    rules = rule_names(traced)
    total = F.col("original_rows")
    counted = traced.groupBy(run).agg(
        F.sum("copies").alias("original_rows"),
        (F.sum("copies") - F.count(F.lit(1))).alias("duplicates"),
        F.count_if(F.col("kept")).alias("rows_after_cleaning"),
        *[F.count_if(F.col(r)).alias(r.removeprefix("rule_")) for r in rules],
    )
    removed = total - F.col("rows_after_cleaning")
    pct = F.round(F.try_divide(removed * 100.0, total), 2)
    return counted.withColumns(
        {
            "rows_removed_total": removed,
            "removal_pct": pct,
            "removal_warning": pct > REMOVAL_LIMIT,
            "duplicate_warning": F.col("duplicates") / total > 0.05,
        }
    )


def assert_usable(clean: DataFrame, run: str = "run_id", min_rows: int = MIN_ROWS) -> None:
    """Raise unless every run keeps enough rows and no mapped column holds a null. One small job."""
    held = [c for c in CANONICAL if c in clean.columns]
    tested = clean.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in held]
    )
    worst = tested.agg(F.min("n").alias("n"), *[F.sum(c).alias(c) for c in held]).first()
    for c in held:
        if worst[c]:
            raise DataCleaningError(f"nulls remain in column {c}")
    if (worst["n"] or 0) < min_rows:
        raise InsufficientDataError(f"{worst['n'] or 0} rows remain after cleaning, {min_rows} needed")
