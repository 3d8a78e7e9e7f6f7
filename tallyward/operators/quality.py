"""Quality profile of raw records: nulls per column, exact copies, impossible values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators.schema import RoleMap, numeric_columns

# Report limits, in percent.
NULL_LIMIT = 20.0
COPY_LIMIT = 5.0


def collapse_copies(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Distinct rows (nulls equal) with their number of copies; copies combine before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))


def drop_copies(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def null_profile(df: DataFrame, run: str = "run_id", columns: Sequence[str] | None = None) -> DataFrame:
    """(run, column, data_type, null_count, null_pct, flagged): one pass for all columns."""
    types = dict(df.dtypes)
    chosen = list(columns) if columns is not None else [c for c in df.columns if c != run]
    counts = df.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(chosen)],
    )
    cells = []
    for i, c in enumerate(chosen):
        cells += [F.lit(c), F.lit(types[c]), F.col(f"n_{i}")]
    long = counts.select(
        run, "total_rows", F.stack(F.lit(len(chosen)), *cells).alias("column", "data_type", "null_count")
    )
    pct = F.col("null_count") / F.col("total_rows") * 100.0
    return long.select(
        run, "column", "data_type", "null_count", pct.alias("null_pct"), (pct > NULL_LIMIT).alias("flagged")
    )


def row_quality(df: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, total_rows, duplicate_rows, impossible_value_rows) from the copy-collapsed rows."""
    negative = F.lit(False)
    for c in numeric_columns(df):
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    return (
        collapse_copies(df)
        .groupBy(run)
        .agg(
            F.sum("copies").alias("total_rows"),
            (F.sum("copies") - F.count(F.lit(1))).alias("duplicate_rows"),
            F.sum(F.when(negative, F.col("copies")).otherwise(0)).alias("impossible_value_rows"),
        )
    )


def quality_report(df: DataFrame, roles: RoleMap, run: str = "run_id") -> DataFrame:
    """One nested row per run: totals, per-column nulls, schema mapping and warnings."""
    types = dict(df.dtypes)
    columns = [c for c in df.columns if c != run]
    negative = F.lit(False)
    for c in numeric_columns(df):
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    copies = F.col("copies")
    totals = (
        collapse_copies(df)
        .groupBy(run)
        .agg(
            F.sum(copies).alias("total_rows"),
            (F.sum(copies) - F.count(F.lit(1))).alias("duplicate_rows"),
            F.sum(F.when(negative, copies).otherwise(0)).alias("impossible_value_rows"),
            *[
                F.sum(F.when(F.col(c).isNull(), copies).otherwise(0)).alias(f"n_{i}")
                for i, c in enumerate(columns)
            ],
        )
    )
    entries = []
    for i, c in enumerate(columns):
        pct = F.col(f"n_{i}") / F.col("total_rows") * 100.0
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n_{i}").alias("null_count"),
                pct.alias("null_pct"),
                F.lit(types[c]).alias("data_type"),
                (pct > NULL_LIMIT).alias("flagged"),
            )
        )
    copied = F.col("duplicate_rows") / F.col("total_rows") * 100.0 > COPY_LIMIT
    warnings = [F.lit(w) for w in roles.warnings] + [F.when(copied, F.lit("DUPLICATE_DATA_WARNING"))]

    def texts(values: Sequence[str]):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return totals.select(
        run, "total_rows", "duplicate_rows", "impossible_value_rows",
        F.array(*entries).alias("columns"),
        F.lit(roles.confidence).alias("schema_confidence"),
        F.map_from_arrays(texts(list(roles.mapped)), texts(list(roles.mapped.values()))).alias("mapped_columns"),
        texts(roles.unmapped).alias("unmapped_columns"),
        texts(roles.skipped_features).alias("skipped_features"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
    )
