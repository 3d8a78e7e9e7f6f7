"""Column expressions shared by the operators. All stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


INTEGERS = {"tinyint", "smallint", "int", "bigint"}
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
WHOLE = r"^\s*[+-]?[0-9]+\s*$"


def number(c: Column | str, kind: str = "string") -> Column:
    """Any input as a double; text that is no number, NaN and infinities become null.

    ``kind`` is the type name of the input; integers need no check.
    """
    x = F.col(c) if isinstance(c, str) else c
    if kind in INTEGERS:
        return x.cast("double")
    d = x.try_cast("double")
    if kind == "string":
        # The cast also takes a trailing d or f, which no number here has.
        d = F.when(x.rlike(NUMBER), d)
    # NaN counts as larger than infinity, so one comparison covers both.
    return F.when(F.abs(d) < float("inf"), d)


def numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """``number`` of several columns, by the types the schema gives."""
    kinds = dict(df.dtypes)
    return {c: number(c, kinds[c]) for c in columns}


def whole_number(c: Column | str, kind: str = "string") -> Column:
    """Numeric coercion to a 64-bit integer: unusable text gives 0, fractions are cut off. Whole numbers stay exact."""
    x = F.col(c) if isinstance(c, str) else c
    if kind in INTEGERS:
        return F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))
    rounded = F.coalesce(number(c, kind), F.lit(0.0)).cast("bigint")
    if kind != "string":
        return rounded
    return F.coalesce(F.when(x.rlike(WHOLE), x.try_cast("bigint")), rounded)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def at_least_zero(c: Column) -> Column:
    return F.when(c < 0, F.lit(0)).otherwise(c)


def min_max(x: Column, lowest: Column, highest: Column) -> Column:
    """Position of x between two bounds, 0 when they coincide."""
    return F.when(highest > lowest, (x - lowest) / (highest - lowest)).otherwise(F.lit(0.0))


def mean_present(cols: Sequence[Column]) -> Column:
    """Row-wise mean over the non-null arguments."""
    filled = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    held = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return F.try_divide(filled, held.cast("double"))


def risk_tier(score: Column) -> Column:
    # Tier bounds and names.
    return (
        F.when(score.isNull(), "UNKNOWN")
        .when(score < 0.3, "LOW")
        .when(score < 0.6, "MEDIUM")
        .when(score < 0.8, "HIGH")
        .otherwise("CRITICAL")
    )


def is_high_risk(tier: Column) -> Column:
    return tier.isin("HIGH", "CRITICAL")


def drift_severity(psi: Column) -> Column:
    # Severity bounds and names.
    return (
        F.when(psi < 0.1, "No Drift").when(psi <= 0.25, "Moderate Drift").otherwise("Significant Drift")
    )


def drift_badge(psi: Column) -> Column:
    # The per-feature labels of the drift table.
    return F.when(psi < 0.1, "Normal").when(psi <= 0.25, "Moderate").otherwise("Action Required")


def drift_multiplier(severity: Column) -> Column:
    # Forecast uplift by the severity of the previous run.
    return (
        F.when(severity == "Significant Drift", 1.10)
        .when(severity == "Moderate Drift", 1.05)
        .otherwise(1.00)
    )


def mask_id(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) <= 4, "****").otherwise(
        F.concat(F.substring(text, 1, 2), F.lit("***"), F.substring(text, -2, 2))
    )


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def title_words(name: str) -> str:
    """Column heading for display: underscores to blanks, words capitalised."""
    return name.replace("_", " ").title()


def has_token(name: Column, tokens: Sequence[str]) -> Column:
    """Whether one of the ``_``-separated parts of a column name is in ``tokens``."""
    return F.arrays_overlap(F.split(F.lower(name), "_"), F.array(*[F.lit(t) for t in tokens]))


def contains_any(name: Column, parts: Sequence[str]) -> Column:
    lowered = F.lower(name)
    hit = F.lit(False)
    for part in parts:
        hit = hit | lowered.contains(part)
    return hit


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even."""
    # A rounded minus zero prints without its sign. Values beyond the decimal's range have no digits to round.
    near = F.bround(x.try_cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.coalesce(near, F.format_string(f"%.{digits}f", x.cast("double")))
