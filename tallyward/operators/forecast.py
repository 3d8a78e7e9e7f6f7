"""Period totals and next-period forecasts. All of it works on aggregated series, one row per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.scalars import drift_multiplier
from tallyward.operators.running import running
from tallyward.operators.settling import settle, sized

# Shortest series for a trend, spike limit, fold limits.
TREND_PERIODS = 3
SPIKE_FACTOR = 1.20
# A challenger's error has to stay below this share of the champion's.
STANDING_SHARE = 0.95
FEW_PERIODS, MANY_PERIODS, FOLDS = 5, 50, 5


def period_totals(df: DataFrame, period: str, sums: dict[str, str], group: str | None = None) -> DataFrame:
    """Sums per period (and group): ``sums`` maps output names to input columns."""
    keys = [period] + ([group] if group else [])
    return df.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def with_index(totals: DataFrame, period: str) -> DataFrame:
    """Add ``t`` = 1..n in period order. ``totals`` holds one row per period."""
    indexed = running(totals, period, sums={"t": F.lit(1)})
    return indexed.withColumn("t", F.col("t").cast("int"))


def period_index(df: DataFrame, period: str) -> DataFrame:
    """(period, t) of the distinct periods."""
    return with_index(df.select(period).distinct(), period)


def densify(totals: DataFrame, period: str, group: str, value: str, trim: bool = False) -> DataFrame:
    """One row per group and period, missing ones with 0; with ``trim`` only from the group's first positive period on.

    No grid is built: every row a group has fills the gap up to its next one (or the last period of all), and the first also
    the one before it. So a row makes as many rows as its own gap is long, and with ``trim`` nothing stands before the group's start.
    A null group is a group; a null period is left out.
    """
    totals = settle(totals.where(F.col(period).isNotNull()))
    index = settle(period_index(totals, period))
    last = index.agg(F.max("t").alias("last"))
    y = F.col(value)
    summed = totals.groupBy(group, period).agg(F.sum(value).alias(value))
    own = Window.partitionBy(group).orderBy("t")
    placed = summed.join(sized(index), period).select(group, "t", value)
    if trim:
        begun = F.max((y > 0).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
        placed = placed.withColumn("_begun", begun).where("_begun = 1").drop("_begun")
    following = F.coalesce(F.lead("t").over(own), last.scalar() + 1)
    first = F.row_number().over(own) == 1
    begin = F.col("t") if trim else F.when(first, F.lit(1)).otherwise(F.col("t"))
    spans = placed.select(group, "t", value, following.alias("_next"), begin.alias("_begin"))
    filled = spans.select(group, value, F.col("t").alias("_own"), F.explode(F.sequence("_begin", F.col("_next") - 1)).alias("t"))
    zero = F.lit(0).cast(dict(totals.dtypes)[value])
    told = F.when(F.col("t") == F.col("_own"), F.coalesce(y, zero)).otherwise(zero)
    return filled.select(group, "t", told.alias(value)).join(sized(index), "t").select(group, period, "t", value)


def trend_next(series: DataFrame, value: str, keys: Sequence[str] = (), index: str = "t") -> DataFrame:
    """(keys, n, slope, intercept, prediction): straight line through the series, one step ahead.

    One period predicts its own value; predictions are never negative.
    """
    y, t = F.col(value).cast("double"), F.col(index).cast("double")
    fitted = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, t).alias("slope"),
        F.regr_intercept(y, t).alias("intercept"),
        F.max_by(y, t).alias("last_value"),
    )
    ahead = F.col("intercept") + F.col("slope") * (F.col("n") + 1)
    guess = F.greatest(F.coalesce(ahead, F.col("last_value"), F.lit(0.0)), F.lit(0.0))
    return fitted.select(*keys, "n", "slope", "intercept", guess.alias("prediction"))


def growth_rate(series: DataFrame, value: str, keys: Sequence[str] = (), index: str = "t") -> DataFrame:
    """(keys, growth): compound growth per period between first and last value, 0 where undefined."""
    y = F.col(value).cast("double")
    ends = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(y, index).alias("first"), F.max_by(y, index).alias("last")
    )
    defined = (F.col("n") > 1) & (F.col("first") > 0) & (F.col("last") > 0)
    rate = F.pow(F.col("last") / F.col("first"), 1.0 / (F.col("n") - 1)) - 1.0
    return ends.select(*keys, F.when(defined, rate).otherwise(0.0).alias("growth"))


def active_history(dense: DataFrame, group: str, value: str, index: str = "t") -> DataFrame:
    """Each group's series from its first positive period on, re-indexed as ``active_t``."""
    running = Window.partitionBy(group).orderBy(index)
    started = F.max((F.col(value) > 0).cast("int")).over(running)
    kept = dense.withColumn("started", started).where("started = 1").drop("started")
    return kept.withColumn("active_t", F.row_number().over(running))


def group_forecast(totals: DataFrame, period: str, group: str, value: str) -> DataFrame:
    """(group, active_periods, prediction) for the groups present in the last period.

    The line fit uses sums over the periods a group has: absent periods count as 0 and add
    nothing to the sums of y, while the sums of 1..m are known. So no grid is built.
    Groups with fewer than three active periods grow at the overall rate.
    """
    totals = settle(totals)
    by_period = with_index(totals.groupBy(period).agg(F.sum(value).alias("all_value")), period)
    overall = growth_rate(by_period, "all_value")
    span = by_period.agg(F.max("t").alias("n_periods"))
    y = F.col(value).cast("double")
    placed = (
        totals.groupBy(group, period).agg(F.sum(value).alias(value))
        .join(by_period.select(period, "t"), period)
        .withColumns({"n_periods": span.scalar(), "growth": overall.scalar()})
    )
    t = F.col("t")
    sums = placed.groupBy(group).agg(
        F.max("n_periods").alias("n_periods"),
        F.max("growth").alias("growth"),
        F.min(F.when(y > 0, t)).alias("start"),
        F.sum(F.when(t == F.col("n_periods"), y)).alias("last_value"),
    )
    fitted = (
        placed.drop("growth", "n_periods").join(sums, group)
        .where("t >= start")
        .groupBy(group, "n_periods", "growth", "start", "last_value")
        .agg(F.sum(y).alias("sy"), F.sum(y * (t - F.col("start") + 1)).alias("sjy"))
    )
    m = (F.col("n_periods") - F.col("start") + 1).cast("double")
    sj = m * (m + 1) / 2
    sjj = m * (m + 1) * (2 * m + 1) / 6
    slope = F.try_divide(m * F.col("sjy") - sj * F.col("sy"), m * sjj - sj * sj)
    ahead = F.col("sy") / m + slope * ((m + 1) - sj / m)
    short = F.coalesce("last_value", F.lit(0.0)) * (1.0 + F.col("growth"))
    named = F.col(group).isNotNull() & ~F.col(group).isin("", "Unknown")
    guess = F.greatest(F.when(m >= TREND_PERIODS, ahead).otherwise(short), F.lit(0.0))
    return (
        fitted.where(named & F.col("last_value").isNotNull())
        .select(group, m.cast("bigint").alias("active_periods"), guess.alias("prediction"))
    )


def expanding_forecast(totals: DataFrame, period: str, value: str) -> DataFrame:
    """(period, t, actual, prediction): for every period, the trend through all periods up to it."""
    y = F.col(value).cast("double")
    # Both sums over the place come from running sums: t is the count so far.
    indexed = with_index(totals, period).select(period, "t", y.alias("actual"))
    counted = F.col("t").cast("double")
    sums = running(indexed, period, sums={"sy": F.col("actual"), "sty": counted * F.col("actual")}).withColumn("n", counted)
    n = F.col("n")
    st, stt = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
    slope = F.try_divide(n * F.col("sty") - st * F.col("sy"), n * stt - st * st)
    ahead = F.col("sy") / n + slope * ((n + 1) - st / n)
    guess = F.greatest(F.coalesce(ahead, F.col("actual")), F.lit(0.0))
    return sums.select(period, "t", "actual", guess.alias("prediction"))


def adjusted(forecasts: DataFrame, severities: DataFrame, run: str = "run_id") -> DataFrame:
    """Raise each run's total by the drift of the run before it.

    ``severities`` holds one row per run; adds ``drift_multiplier`` and ``predicted_total``.
    """
    joined = forecasts.join(severities.select(run, "overall_severity"), run, "left")
    joined = running(joined, run, before={"previous_severity": F.col("overall_severity")}).drop("overall_severity")
    factor = drift_multiplier(F.col("previous_severity"))
    return joined.withColumns(
        {"drift_multiplier": factor, "predicted_total": F.col("prediction") * factor}
    )


def spikes(history: DataFrame, run: str = "run_id") -> DataFrame:
    """Add ``prior_total`` and ``is_spike``: a forecast more than 20 percent above the previous total.

    The previous total is the last known of ``last_actual_total``, ``actual_total``, ``predicted_total``.
    """
    names = [c for c in ("last_actual_total", "actual_total", "predicted_total") if c in history.columns]
    table = running(history, run, before={"prior_total": F.coalesce(*names)})
    above = F.col("predicted_total") > F.col("prior_total") * SPIKE_FACTOR
    return table.withColumn("is_spike", F.coalesce((F.col("prior_total") > 0) & above, F.lit(False)))


def regression_cv(
    series: DataFrame, value: str, keys: Sequence[str], index: str = "t", deal: Column | None = None
) -> DataFrame:
    """(keys, n, mape, rmse, stability_score) of the straight-line fit.

    Below 5 periods the fit is judged on itself, below 50 by leaving one out, above in 5 folds.
    Each held-out fit comes from the sums of the series minus those of the fold. The folds are dealt by a hash of the
    period, or by ``deal``.
    """
    whole = Window.partitionBy(*keys)
    y, t = F.col(value).cast("double"), F.col(index).cast("double")
    given = F.lit(None).cast("int") if deal is None else deal.cast("int")
    rows = series.select(*keys, y.alias("y"), t.alias("t"), F.count(F.lit(1)).over(whole).alias("n"), given.alias("given"))
    shuffled = F.row_number().over(whole.orderBy(F.xxhash64("t"), "t"))
    fold = (
        F.when(F.col("n") < FEW_PERIODS, -1)
        .when(F.col("n") < MANY_PERIODS, F.row_number().over(whole.orderBy("t")))
        .otherwise(shuffled % FOLDS if deal is None else F.col("given"))
    )
    rows = rows.withColumn("fold", fold)
    held_out = Window.partitionBy(*keys, "fold")

    def left(x: Column) -> Column:
        inside = F.when(F.col("fold") >= 0, F.sum(x).over(held_out)).otherwise(0.0)
        return F.sum(x).over(whole) - inside

    one, ty, tt = F.lit(1.0), F.col("t") * F.col("y"), F.col("t") * F.col("t")
    sums = rows.select(
        *keys, "n", "fold", "y", "t", left(one).alias("n_left"), left(F.col("t")).alias("st"),
        left(F.col("y")).alias("sy"), left(ty).alias("sty"), left(tt).alias("stt"),
    )
    k, st, sy = F.col("n_left"), F.col("st"), F.col("sy")
    slope = F.coalesce(F.try_divide(k * F.col("sty") - st * sy, k * F.col("stt") - st * st), F.lit(0.0))
    guess = sy / k + slope * (F.col("t") - st / k)
    miss = F.col("y") - guess
    scored = sums.select(*keys, "n", "fold", "y", miss.alias("miss"))
    per_fold = scored.groupBy(*keys, "n", "fold").agg(
        F.when(F.count_if(F.col("y") == 0) > 0, 0.0)
        .otherwise(F.avg(F.try_divide(F.abs("miss"), F.abs("y")))).alias("fold_mape"),
        F.sqrt(F.avg(F.col("miss") * F.col("miss"))).alias("fold_rmse"),
    )
    steady = F.when(F.count(F.lit(1)) > 1, 1.0 - F.stddev_pop("fold_mape")).otherwise(1.0)
    return per_fold.groupBy(*keys, "n").agg(
        F.avg("fold_mape").alias("mape"), F.avg("fold_rmse").alias("rmse"), steady.alias("stability_score")
    )


def group_models(series: DataFrame, value: str, group: str, standing: DataFrame | None = None, index: str = "t") -> DataFrame:
    """(group, n, slope, intercept, prediction, mape, rmse, stability_score, champion, promoted): one model per group, all in one job.

    Groups with fewer than three periods have no model. ``standing`` holds the error of each group's champion (``group, standing``);
    a model is promoted if its own is at least five percent lower, or if its group has no champion with a positive error.
    """
    keys = [group]
    long_enough = series.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= TREND_PERIODS).select(group)
    kept = settle(series.join(long_enough, group, "left_semi"))
    fitted = trend_next(kept, value, keys, index)
    judged = regression_cv(kept, value, keys, index).drop("n")
    out = fitted.join(judged, group)
    champion = F.lit(None).cast("double").alias("champion")
    out = out.withColumn("champion", champion) if standing is None else out.join(standing.select(group, F.col("standing").alias("champion")), group, "left")
    worse = (F.col("champion") > 0) & (F.col("mape") > F.col("champion") * STANDING_SHARE)
    return out.withColumn("promoted", ~F.coalesce(worse, F.lit(False)))


def decay_score(pairs: DataFrame, actual: str, predicted: str, keys: Sequence[str], limit: float = 50000.0) -> DataFrame:
    """(keys, drift_score, decayed): mean absolute error, flagged beyond a fixed limit."""
    miss = F.avg(F.abs(F.col(actual) - F.col(predicted)))
    return pairs.groupBy(*keys).agg(miss.alias("drift_score"), (miss > limit).alias("decayed"))
