"""Exact quantiles with linear interpolation for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here each
value is first mapped to a narrow, order-keeping interval. Counting rows per interval
combines on the map side, so a group with a third of all rows sends only its few thousand
interval counts. The running count shows which intervals hold the wanted ranks, and only
the values inside those are looked at again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.scalars import numbers
from tallyward.operators.settling import BROADCAST_ROWS, Size, measure, settle, stage

COARSE_BITS = 10
FINE_BITS = 24
# Above this many rows in one wanted interval, the interval is cut a second time.
INTERVAL_ROWS = 1_000_000


def interval(x: Column, bits: int) -> Column:
    """Number of the interval that holds x; larger x never gets a smaller number.

    Intervals split each power of two into ``2**bits`` equal parts, on both sides of zero.
    """
    lowest_exponent = -1022
    size = F.abs(x)
    exponent = F.greatest(
        F.coalesce(F.floor(F.log2(size)), F.lit(lowest_exponent)), F.lit(lowest_exponent)
    ).cast("int")
    part = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * float(2**bits))
    distance = (exponent - lowest_exponent + 1).cast("bigint") * (2**bits) + part
    return F.when(x < 0, -distance).otherwise(distance)


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, col_no, x): one row per finite value of each column."""
    finite = numbers(df, columns)
    pairs = []
    for no, c in enumerate(columns):
        pairs += [F.lit(no), finite[c]]
    kept = [F.col(k) for k in keys]
    if len(columns) == 1:
        long = df.select(*kept, pairs[0].alias("col_no"), pairs[1].alias("x"))
    else:
        long = df.select(*kept, F.stack(F.lit(len(columns)), *pairs).alias("col_no", "x"))
    return long.where("x IS NOT NULL")


def _find(counts: DataFrame, scope: Sequence[str], by: str, wanted: DataFrame) -> DataFrame:
    """Which ``by`` inside each scope holds each wanted rank, from running counts."""
    running = Window.partitionBy(*scope).orderBy(by)
    spans = counts.withColumn("before", F.sum("n").over(running) - F.col("n"))
    begin = F.col("start") + F.col("before")
    return (
        spans.join(wanted.select(*scope, "rank", "start", "total"), list(scope))
        .where((F.col("rank") >= begin) & (F.col("rank") < begin + F.col("n")))
        .select(*scope, by, "rank", begin.alias("start"), "n", "total")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    fractions: Sequence[float],
    size: Size | None = None,
    interval_rows: int = INTERVAL_ROWS,
) -> DataFrame:
    """(keys, column, n, quantiles): the quantiles of each column per group; null, NaN, inf skipped.

    A table measured as small goes to the built-in exact aggregate in one pass.
    """
    size = size or measure(df)
    if size.small:
        return _built_in_quantiles(df, keys, columns, fractions)
    long = melt(df, keys, columns)
    scope = [*keys, "col_no"]

    last = F.col("total") - 1
    ranks = F.array_distinct(
        F.flatten(F.array(*[F.array(F.floor(last * q), F.ceil(last * q)) for q in fractions]))
    )
    running = Window.partitionBy(*scope).orderBy("chunk")
    whole = Window.partitionBy(*scope)
    wanted = (
        long.groupBy(*scope, interval(F.col("x"), COARSE_BITS).alias("chunk"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.sum("n").over(running) - F.col("n"))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn(
            "rank",
            F.explode(
                F.filter(
                    ranks,
                    lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")),
                )
            ),
        )
    )
    wanted = settle(wanted)
    held = wanted.agg(F.count(F.lit(1)).alias("n_wanted"), F.max("n").alias("largest")).first()
    few = held["n_wanted"] <= BROADCAST_ROWS
    wanted = F.broadcast(wanted) if few else wanted

    values = (
        long.withColumn("chunk", interval(F.col("x"), COARSE_BITS))
        .join(wanted.select(*scope, "chunk"), [*scope, "chunk"], "left_semi")
        .groupBy(*scope, "chunk", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scope_in = [*scope, "chunk"]
    if held["largest"] is not None and held["largest"] > interval_rows:
        values = stage(values.withColumn("fine", interval(F.col("x"), FINE_BITS)), "values")
        fine = values.groupBy(*scope_in, "fine").agg(F.sum("n").alias("n"))
        wanted = _find(fine, scope_in, "fine", wanted)
        scope_in = [*scope_in, "fine"]
        values = values.join(wanted.select(*scope_in).distinct(), scope_in, "left_semi")
    found = _find(values, scope_in, "x", wanted)

    # At most two entries per fraction.
    at = F.map_from_entries(F.collect_list(F.struct("rank", "x")))
    by_rank = found.groupBy(*scope, "total").agg(at.alias("at"))

    def interpolated(q: float) -> Column:
        low = F.try_element_at("at", F.floor(last * q))
        high = F.try_element_at("at", F.ceil(last * q))
        return low + (high - low) * (last * q - F.floor(last * q))

    names = F.array(*[F.lit(c) for c in columns])
    return by_rank.select(
        *keys,
        F.element_at(names, F.col("col_no") + 1).alias("column"),
        F.col("total").alias("n"),
        F.array(*[interpolated(q) for q in fractions]).alias("quantiles"),
    )


def _built_in_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], fractions: Sequence[float]
) -> DataFrame:
    finite = numbers(df, columns)
    wide = df.select(*keys, *[finite[c].alias(f"x_{i}") for i, c in enumerate(columns)])
    wide = wide.groupBy(*keys).agg(
        *[F.count(f"x_{i}").alias(f"n_{i}") for i in range(len(columns))],
        *[F.percentile(f"x_{i}", list(fractions)).alias(f"q_{i}") for i in range(len(columns))],
    )
    cells = []
    for i, c in enumerate(columns):
        cells += [F.lit(c), F.col(f"n_{i}"), F.col(f"q_{i}")]
    long = wide.select(*keys, F.stack(F.lit(len(columns)), *cells).alias("column", "n", "quantiles"))
    return long.where("n > 0")


def widen(
    long: DataFrame, keys: Sequence[str], columns: Sequence[str], value: Column, prefix: str
) -> DataFrame:
    """One row per group with ``prefix + column`` for each column of a small long table."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == c, value)).alias(prefix + c) for c in columns]
    )
