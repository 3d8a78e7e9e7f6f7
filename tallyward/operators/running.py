"""Running values over one long ordered series: a prefix scan over ranges of the order, never one task.

The series is dealt to ranges of its order column and written once. Each range is folded to one row of totals (combined in
the tasks); the driver carries these few rows forward from range to range; inside its range every row then adds what came
before it. The number of ranges is the session's number of shuffle partitions; it changes no count or looked-up value, and sums only in
the order of their additions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyward.operators.settling import stage


def running(
    series: DataFrame, by: str, sums: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None, last_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns in the order of ``by`` (one row per value of it; null comes first).

    ``sums``: total up to and with the row; null until a value is not null. ``before``: the value of the row before.
    ``last_before``: the last value before the row that is not null. An empty series stays empty.
    """
    spark, sums, before, last_before = series.sparkSession, sums or {}, before or {}, last_before or {}
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = {f"_v{i}": c for i, c in enumerate([*sums.values(), *before.values(), *last_before.values()])}
    names = dict(zip(value, [*sums, *before, *last_before], strict=True))
    kind = dict(zip(value, ["sum"] * len(sums) + ["before"] * len(before) + ["last"] * len(last_before), strict=True))
    dealt = series.select("*", *[c.alias(v) for v, c in value.items()]).repartitionByRange(ranges, by)
    dealt = stage(dealt.withColumn("_range", F.spark_partition_id()), "ranges")

    # The row that ends a range, with a place that is there even if the order value is null.
    place = F.struct(F.col(by).isNotNull(), F.col(by))

    def total(v: str) -> Column:
        if kind[v] == "sum":
            return F.sum(v).alias(v)
        if kind[v] == "before":
            return F.max_by(F.struct(v), place).alias(v)
        return F.max_by(F.when(F.col(v).isNotNull(), F.struct(v)), F.when(F.col(v).isNotNull(), place)).alias(v)

    totals = dealt.groupBy("_range").agg(*[total(v) for v in value])
    carried, state = [], {v: None for v in value}
    for row in sorted(totals.collect(), key=lambda r: r["_range"]):  # one row per range
        carried.append((row["_range"], *state.values()))
        for v in value:
            if row[v] is None:
                continue
            if kind[v] == "sum":
                state[v] = row[v] if state[v] is None else state[v] + row[v]
            else:
                state[v] = row[v][v]
    types = {f.name: f.dataType for f in totals.schema.fields}
    fields = [StructField("_range", types["_range"])]
    fields += [StructField(f"_c{v}", types[v] if kind[v] == "sum" else types[v].fields[0].dataType) for v in value]
    joined = dealt.join(F.broadcast(spark.createDataFrame(carried, StructType(fields))), "_range")

    order = Window.partitionBy("_range").orderBy(by)
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for v, name in names.items():
        carry = F.col(f"_c{v}")
        if kind[v] == "sum":
            own = F.sum(v).over(upto)
            out[name] = F.coalesce(own + carry, own, carry)
        elif kind[v] == "before":
            out[name] = F.when(F.row_number().over(order) == 1, carry).otherwise(F.lag(v).over(order))
        else:
            out[name] = F.coalesce(F.last(v, ignorenulls=True).over(earlier), carry)
    kept = [c for c in series.columns if c not in out]
    return joined.select(*kept, *[c.alias(n) for n, c in out.items()])
