"""Distribution profiles, group statistics and category counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.scalars import number, numbers
from tallyward.operators.quantiles import exact_quantiles
from tallyward.operators.settling import Size, attach, measure

# Percentiles kept for thresholds.
THRESHOLD_FRACTIONS = [0.25, 0.50, 0.75, 0.90, 0.95, 0.99]


def moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, mean, std): all columns in one aggregate; std is the sample deviation."""
    finite = numbers(df, columns)
    wide = df.groupBy(*keys).agg(
        *[F.avg(finite[c]).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(finite[c]).alias(f"s_{i}") for i, c in enumerate(columns)],
    )
    cells = []
    for i, c in enumerate(columns):
        cells += [F.lit(c), F.col(f"m_{i}"), F.col(f"s_{i}")]
    return wide.select(*keys, F.stack(F.lit(len(columns)), *cells).alias("column", "mean", "std"))


def thresholds(
    df: DataFrame, columns: Sequence[str], run: str = "run_id", size: Size | None = None
) -> DataFrame:
    """Per run and column: mean, std, median and the threshold percentiles; missing values read 0."""
    quantiles = exact_quantiles(df, [run], columns, THRESHOLD_FRACTIONS, size)
    joined = moments(df, [run], columns).join(quantiles, [run, "column"], "left")

    def known(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))

    picks = [
        known(F.get("quantiles", F.lit(i))).alias(f"p{round(q * 100)}")
        for i, q in enumerate(THRESHOLD_FRACTIONS)
    ]
    return joined.select(
        run, "column", known(F.col("mean")).alias("mean"), known(F.col("std")).alias("std"),
        known(F.get("quantiles", F.lit(1))).alias("median"), *picks,
    )


def distribution_profile(df: DataFrame, columns: Sequence[str], run: str = "run_id") -> DataFrame:
    """The reference distribution of a run: mean, median, std, quartiles per numeric column."""
    return thresholds(df, columns, run).select(run, "column", "mean", "median", "std", "p25", "p75")


def category_counts(df: DataFrame, columns: Sequence[str], run: str = "run_id") -> DataFrame:
    """(run, column, category, n), nulls left out. Combines on the map side, so hot values are fine."""
    cells = []
    for c in columns:
        cells += [F.lit(c), F.col(c).cast("string")]
    long = df.select(run, F.stack(F.lit(len(columns)), *cells).alias("column", "category"))
    return (
        long.where("category IS NOT NULL")
        .groupBy(run, "column", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_spread(
    df: DataFrame, column: str, group: str | None, run: str = "run_id", center: str = "mean",
    size: Size | None = None,
) -> DataFrame:
    """Attach ``<column>_center`` and ``<column>_spread`` of each row's group.

    A group without a deviation (one row, or no group) uses the run's, then 0.
    """
    size = size or measure(df)
    x = number(column, dict(df.dtypes)[column])

    def statistics(keys: list[str], prefix: str) -> DataFrame:
        stats = df.groupBy(*keys).agg(
            F.avg(x).alias(f"{prefix}_center"), F.stddev_samp(x).alias(f"{prefix}_spread")
        )
        if center == "median":
            middle = exact_quantiles(df, keys, [column], [0.5], size)
            middle = middle.select(*keys, F.col("quantiles")[0].alias(f"{prefix}_center"))
            stats = stats.drop(f"{prefix}_center").join(middle, keys, "left")
        return stats

    out = attach(df, statistics([run], "all"), [run], size)
    if group and group in df.columns:
        out = attach(out, statistics([run, group], "own"), [run, group], size)
        own_center, own_spread = F.col("own_center"), F.col("own_spread")
    else:
        own_center = own_spread = F.lit(None).cast("double")
    out = out.withColumns(
        {
            f"{column}_center": F.coalesce(own_center, F.col("all_center"), F.lit(0.0)),
            f"{column}_spread": F.coalesce(own_spread, F.col("all_spread"), F.lit(0.0)),
        }
    )
    return out.drop("all_center", "all_spread", "own_center", "own_spread")
