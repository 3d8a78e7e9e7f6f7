"""Distribution drift between a run and its reference run."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyward.functions.scalars import contains_any, drift_badge, drift_severity, has_token
from tallyward.functions.tails import upper_gamma
from tallyward.operators.profile import category_counts, moments
from tallyward.operators.quantiles import exact_quantiles, melt
from tallyward.operators.running import running
from tallyward.operators.settling import Size, attach, measure, settle

# Number of bins, share of an empty bin, weight added to each contingency cell.
BINS = 10
EMPTY_SHARE = 1e-4
CELL_WEIGHT = 1e-9


def run_pairs(df: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, reference_run): each run with the run before it, null for the first. One row per run."""
    return running(df.select(run).distinct(), run, before={"reference_run": F.col(run)})


def bin_of(x: Column, edges: Column) -> Column:
    """Left-closed bin by the inner edges; repeated edges leave bins empty."""
    place = F.lit(0)
    for i in range(BINS - 1):
        place = place + (x >= F.get(edges, F.lit(i))).cast("int")
    return place


def psi(
    df: DataFrame,
    columns: Sequence[str],
    run: str = "run_id",
    pairs: DataFrame | None = None,
    size: Size | None = None,
) -> DataFrame:
    """(run, column, ordinal, psi) of each run that has a reference run.

    Each value is binned twice in one scan: by its own run's edges (as the reference of a later
    run) and by its reference run's edges. Only bin counts leave the tasks.
    """
    size = size or measure(df)
    pairs = (run_pairs(df, run) if pairs is None else pairs).where("reference_run IS NOT NULL")
    inner = [i / BINS for i in range(1, BINS)]
    names = F.array(*[F.lit(c) for c in columns])
    number = (F.array_position(names, F.col("column")) - 1).cast("int")
    edges = exact_quantiles(df, [run], columns, inner, size).select(
        run, number.alias("col_no"), F.col("quantiles").alias("edges")
    )
    theirs = edges.select(
        F.col(run).alias("reference_run"), "col_no", F.col("edges").alias("reference_edges")
    )
    of_reference = pairs.join(theirs, "reference_run").select(run, "col_no", "reference_edges")
    both = edges.join(of_reference, [run, "col_no"], "left")

    binned = attach(melt(df, [run], columns), both, [run, "col_no"], size).select(
        run, F.element_at(names, F.col("col_no") + 1).alias("column"),
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("as_reference"), bin_of(F.col("x"), F.col("edges")).alias("bin")),
                F.struct(F.lit(False).alias("as_reference"), bin_of(F.col("x"), F.col("reference_edges")).alias("bin")),
            )
        ),
    )
    counted = (
        binned.where("bin IS NOT NULL")
        .groupBy(run, "column", "as_reference", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Looking the comparison up, rather than filtering either side out, keeps this one pass.
    cells = counted.join(_comparisons(pairs, run), [run, "as_reference"]).select(
        F.col("compared").alias(run), "column", "as_reference", "bin", "n"
    )
    return _psi_from_cells(cells, pairs, columns, run)


def _comparisons(pairs: DataFrame, run: str) -> DataFrame:
    """(run, as_reference, compared): in which runs' comparison a run takes part, and on which side."""
    return pairs.select(
        F.inline(
            F.array(
                F.struct(F.col(run).alias(run), F.lit(False).alias("as_reference"), F.col(run).alias("compared")),
                F.struct(F.col("reference_run").alias(run), F.lit(True).alias("as_reference"), F.col(run).alias("compared")),
            )
        )
    )


def _psi_from_cells(cells: DataFrame, pairs: DataFrame, columns: Sequence[str], run: str) -> DataFrame:
    sides = {"r": F.col("as_reference"), "c": ~F.col("as_reference")}
    per_bin = [
        F.sum(F.when(side & (F.col("bin") == b), F.col("n"))).alias(f"{s}{b}")
        for s, side in sides.items()
        for b in range(BINS)
    ]
    totals = [F.sum(F.when(side, F.col("n"))).alias(f"{s}_all") for s, side in sides.items()]
    wide = cells.groupBy(run, "column").agg(*per_bin, *totals)

    def share(s: str, b: int) -> Column:
        return F.coalesce(F.col(f"{s}{b}") / F.col(f"{s}_all"), F.lit(EMPTY_SHARE))

    terms = F.lit(0.0)
    for b in range(BINS):
        r, c = share("r", b), share("c", b)
        terms = terms + (c - r) * F.ln(c / r)
    known = F.col("r_all").isNotNull() & F.col("c_all").isNotNull()
    value = F.when(known, terms).otherwise(0.0).alias("psi")
    ordinals = F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("ordinal", "column")
    return (
        pairs.select(run, ordinals)
        .join(wide.select(run, "column", value), [run, "column"], "left")
        .select(run, "column", "ordinal", F.coalesce("psi", F.lit(0.0)).alias("psi"))
    )


def psi_between(
    current: DataFrame, reference: DataFrame, columns: Sequence[str], size: Size | None = None
) -> DataFrame:
    """(column, ordinal, psi) of one table against another."""
    joined = reference.select(F.lit("0").alias("side"), *columns).unionByName(
        current.select(F.lit("1").alias("side"), *columns)
    )
    return psi(joined, columns, "side", size=size).drop("side")


def severity_by_run(psi_table: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, max_psi, overall_severity, drift_detected)."""
    level = drift_severity(F.col("max_psi"))
    return (
        psi_table.groupBy(run)
        .agg(F.max("psi").alias("max_psi"))
        .withColumns({"overall_severity": level, "drift_detected": level != "No Drift"})
    )


def with_badges(psi_table: DataFrame) -> DataFrame:
    return psi_table.withColumns(
        {"alert_indicator": drift_badge(F.col("psi")), "psi_value": F.round("psi", 4)}
    )


def mean_change(
    df: DataFrame, columns: Sequence[str], run: str = "run_id", pairs: DataFrame | None = None
) -> DataFrame:
    """(run, column, mean_change_pct): how far the mean moved from the reference run, in percent."""
    pairs = run_pairs(df, run) if pairs is None else pairs
    means = settle(moments(df, [run], columns).select(run, "column", "mean"))
    theirs = means.select(F.col(run).alias("reference_run"), "column", F.col("mean").alias("reference_mean"))
    apart = F.abs(F.col("mean") - F.col("reference_mean"))
    base = F.greatest(F.abs("reference_mean"), F.lit(1e-6))
    return (
        means.join(pairs.where("reference_run IS NOT NULL"), run)
        .join(theirs, ["reference_run", "column"])
        .select(run, "column", (apart / base * 100.0).alias("mean_change_pct"))
    )


def top_drift(psi_table: DataFrame, changes: DataFrame, k: int = 3, run: str = "run_id") -> DataFrame:
    """The k most drifted columns of each run (ties by column order), rank 1 being the root cause."""
    order = Window.partitionBy(run).orderBy(F.desc("psi"), "ordinal")
    ranked = psi_table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(changes, [run, "column"], "left").select(
        run, "rank", "column", "psi", "mean_change_pct"
    )


def chi_squared(
    df: DataFrame, columns: Sequence[str], run: str = "run_id", pairs: DataFrame | None = None
) -> DataFrame:
    """(run, column, categories, statistic, dof) of category counts against the reference run.

    Works on counts only. Two categories get the continuity correction. One category, or an
    empty side, gives no statistic.
    """
    pairs = (run_pairs(df, run) if pairs is None else pairs).where("reference_run IS NOT NULL")
    counts = category_counts(df, columns, run)
    scope = [run, "column"]
    sided = counts.join(_comparisons(pairs, run), run).drop(run).withColumnRenamed("compared", run)
    # A category one side lacks counts as 0 there.
    table = settle(
        sided.groupBy(*scope, "category").agg(
            F.sum(F.when(F.col("as_reference"), 0).otherwise(F.col("n"))).alias("c"),
            F.sum(F.when(F.col("as_reference"), F.col("n")).otherwise(0)).alias("r"),
        )
    )
    totals = table.groupBy(*scope).agg(
        F.sum("c").alias("c_all"), F.sum("r").alias("r_all"), F.count(F.lit(1)).alias("categories")
    )
    k = F.col("categories")
    row = {"c": F.col("c_all") + k * CELL_WEIGHT, "r": F.col("r_all") + k * CELL_WEIGHT}
    whole = row["c"] + row["r"]
    column_sum = F.col("c") + F.col("r") + 2 * CELL_WEIGHT

    def term(side: str) -> Column:
        expected = row[side] * column_sum / whole
        apart = F.abs(F.col(side) + CELL_WEIGHT - expected)
        apart = F.when(k == 2, apart - F.least(F.lit(0.5), apart)).otherwise(apart)
        return apart * apart / expected

    usable = (k > 1) & (F.col("c_all") > 0) & (F.col("r_all") > 0)
    stats = (
        table.join(totals, scope)
        .groupBy(*scope)
        .agg(
            F.first("categories").alias("categories"),
            F.sum(F.when(usable, term("c") + term("r"))).alias("statistic"),
        )
    )
    ordinals = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    return (
        pairs.select(run, ordinals)
        .join(stats, scope, "left")
        .select(
            *scope, F.coalesce("categories", F.lit(0)).cast("bigint").alias("categories"), "statistic",
            F.greatest(F.coalesce("categories", F.lit(0)) - 1, F.lit(0)).cast("bigint").alias("dof"),
        )
    )


@F.pandas_udf(DoubleType())
def _chi_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([upper_gamma(d / 2.0, s / 2.0) for s, d in zip(statistic, dof)])


def with_p_value(stats: DataFrame) -> DataFrame:
    """Add ``p_value`` to the few rows ``chi_squared`` returns; 1 where there is no statistic."""
    safe = F.coalesce("statistic", F.lit(0.0))
    tail = _chi_tail(safe, F.greatest(F.col("dof"), F.lit(1)).cast("double"))
    return stats.withColumn("p_value", F.when(F.col("statistic").isNull(), 1.0).otherwise(tail))


def accuracy_decay(errors: DataFrame, run: str = "run_id", error: str = "mape") -> DataFrame:
    """(run, mape, prior_mape, accuracy_decay_pct) from one row per run."""
    table = running(errors.select(run, error), run, before={f"prior_{error}": F.col(error)})
    decay = F.coalesce((F.col(error) - F.col(f"prior_{error}")) * 100.0, F.lit(0.0))
    return table.withColumn("accuracy_decay_pct", decay)


def drift_policy(drift: DataFrame) -> DataFrame:
    """Add ``strategy_applied``, ``action`` and ``retrain_triggered`` to drift rows.

    Needs ``overall_severity`` (null on a cold start) and ``accuracy_decay_pct``.
    """
    severity, decay = F.col("overall_severity"), F.col("accuracy_decay_pct")
    quiet = severity.isNull() | (severity == "No Drift")
    retrain = (decay > 20.0) | (severity == "Significant Drift")
    adjust = (severity == "Moderate Drift") | ((decay > 5.0) & (decay <= 20.0))
    # Names of strategies and actions.
    skipped = "skipped — no drift"
    strategy = (
        F.when(quiet, skipped).when(retrain, "full_retrain")
        .when(adjust, "threshold_recalibration").otherwise("skipped")
    )
    action = (
        F.when(quiet, skipped).when(retrain, "recalibrate_and_retrain")
        .when(adjust, "threshold_recalibration").otherwise("none")
    )
    return drift.withColumns(
        {"strategy_applied": strategy, "action": action, "retrain_triggered": ~quiet & F.coalesce(retrain, F.lit(False))}
    )


def is_pay_column(name: Column) -> Column:
    return contains_any(name, ["salary", "pay", "base"])


def is_overtime_column(name: Column, loose: bool = False) -> Column:
    """Overtime columns by whole name parts; ``loose`` accepts any name that contains ``ot``."""
    return contains_any(name, ["overtime", "ot"]) if loose else has_token(name, ["overtime", "ot"])
