"""Model evaluation: folds, confusion metrics, label codes, champion against challenger."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.operators.settling import Size, attach, measure, stage

# Promotion margins.
GAIN, REDUCTION = 1.05, 0.95
SLICE_ROWS = 100_000


def confusion(df: DataFrame, label: str, predicted: str, keys: Sequence[str]) -> DataFrame:
    """(keys, tp, fp, fn, tn, precision, recall, f1, accuracy); a zero denominator gives 0."""
    y, p = F.col(label).cast("boolean"), F.col(predicted).cast("boolean")
    counts = df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
            "accuracy": share(tp + tn, tp + fp + fn + tn),
        }
    )


def fold_summary(per_fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean metrics over the folds, and stability = 1 - population deviation of F1."""
    names = ["f1", "precision", "recall", "accuracy"]
    steady = F.when(F.count(F.lit(1)) > 1, 1.0 - F.stddev_pop("f1")).otherwise(1.0)
    return per_fold.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names], steady.alias("stability_score"))


def class_balance(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def dealt(
    df: DataFrame, stratum: Sequence[str], row_key: Sequence[str], seed: int = 42, size: Size | None = None, upto: int | None = None
) -> DataFrame:
    """Add ``place``: 0, 1, 2, ... inside each stratum, in the order of a seeded hash and the key.

    Who needs only the places below ``upto`` has the rows of all ranges from there on stay where they are: their place is ``upto``.

    The order is cut into ranges of the hash, ranked inside each, and continued across ranges by their counts, so
    no task ranks a whole stratum, and the order is the same for any number of ranges. ``row_key`` must tell rows apart.
    """
    size = size or measure(df)
    slices = max(1, math.ceil(size.rows / SLICE_ROWS))
    spread = F.xxhash64(*row_key, F.lit(seed))
    share = spread.cast("double") / F.lit(2.0**64) + 0.5
    rows = df.withColumns({"spread": spread, "slice": F.floor(share * slices)})
    counts = rows.groupBy(*stratum, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*stratum).orderBy("slice")) - F.col("n")
    offsets = counts.select(*stratum, "slice", before.alias("before"))
    rows = attach(rows, offsets, [*stratum, "slice"], size)
    inside = F.row_number().over(Window.partitionBy(*stratum, "slice").orderBy("spread", *row_key))
    ranked = rows if upto is None else rows.where(F.col("before") < upto)
    ranked = ranked.withColumn("place", F.col("before") + inside - 1)
    if upto is not None:
        ranked = ranked.unionByName(rows.where(~F.coalesce(F.col("before") < upto, F.lit(False))).withColumn("place", F.lit(upto).cast("bigint")))
    return ranked.drop("spread", "slice", "before")


def stratified_folds(
    df: DataFrame, label: str, row_key: Sequence[str], folds: int = 5, seed: int = 42, size: Size | None = None
) -> DataFrame:
    """Add ``fold``: the rows of each label dealt evenly to the folds."""
    rows = dealt(df, [label], row_key, seed, size)
    return rows.withColumn("fold", F.pmod("place", F.lit(folds)).cast("int")).drop("place")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): sorted distinct values numbered from 0. One row per distinct value.

    The values are ranged over tasks, numbered inside each range, and moved up by the counts of the ranges before,
    which are as many as there are tasks.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(values.repartitionByRange(ranges, column).withColumn("range", F.spark_partition_id()), "codes")
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("range").count().collect()):
        offsets.append((r["range"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(offsets, "range int, before long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(column))
    coded = ranged.withColumn("inside", inside).join(F.broadcast(offsets), "range")
    return coded.select(column, (F.col("before") + F.col("inside") - 1).cast("int").alias("code"))


def encode(df: DataFrame, codes: DataFrame, column: str, size: Size | None = None) -> DataFrame:
    """Add ``<column>_code``; a value the codes do not know, or null, gets -1."""
    out = attach(df, codes.select(column, "code"), [column], size)
    return out.withColumn(f"{column}_code", F.coalesce("code", F.lit(-1)).cast("int")).drop("code")


def champion_decisions(results: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, model_name, challenger, champion, bar, lower_is_better, promoted) by walking each model's runs.

    ``results``: (run, model_name, metric, lower_is_better, always_promote). A challenger must beat
    the standing champion by 5 percent, so who the champion is depends on all earlier decisions. The
    walk folds over a model's runs; that list holds one small entry per run.
    """
    entry = F.struct(F.col(run).alias("run"), F.col("metric").cast("double").alias("metric"))
    models = results.groupBy("model_name", "lower_is_better", "always_promote").agg(
        F.sort_array(F.collect_list(entry)).alias("tries")
    )
    lower, always = F.col("lower_is_better"), F.col("always_promote")
    nothing = F.lit(None).cast("double")
    record = "array<struct<run:string,challenger:double,champion:double,bar:double,promoted:boolean>>"
    start = F.struct(nothing.alias("champion"), F.array().cast(record).alias("log"))

    def step(state: Column, x: Column) -> Column:
        champion, metric = state["champion"], x["metric"]
        bar = F.when(lower, champion * REDUCTION).otherwise(champion * GAIN)
        loses = F.when(lower, (metric > bar) & (champion > 0)).otherwise(metric < bar)
        promoted = always | champion.isNull() | ~F.coalesce(loses, F.lit(False))
        line = F.struct(
            x["run"].cast("string").alias("run"), metric.alias("challenger"), champion.alias("champion"),
            bar.alias("bar"), promoted.alias("promoted"),
        )
        return F.struct(
            F.when(promoted, metric).otherwise(champion).alias("champion"),
            F.concat(state["log"], F.array(line)).alias("log"),
        )

    walked = models.withColumn("walk", F.aggregate("tries", start, step))
    return walked.select("model_name", "lower_is_better", F.inline("walk.log")).withColumnRenamed("run", run)
