"""Record tables derived from the star-schema tables, in the canonical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def pay_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per customer and order year; the year is the run.

    Orders are summed per customer and year before the join, so only the sums are shuffled on.
    """
    orders = table(spark, folder, "orders")
    yearly = orders.groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.min("o_orderkey").alias("k1"),
        F.sum("o_orderkey").alias("k2"),
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    planted_hours = F.when(key % 41 == 0, F.lit(40)).otherwise(F.lit(0))
    planted_pay = F.when(key % 37 == 0, F.lit(50000)).otherwise(F.lit(0))
    base = F.floor(F.col("cents").cast("double") / 100.0).cast("bigint")
    people = (
        yearly.join(customer, F.col("o_custkey") == key)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("E"), key.cast("string")).alias("employee_id"),
            F.concat(F.lit("run_"), F.col("yr").cast("string")).alias("run_id"),
            F.col("c_mktsegment").alias("department"),
            F.col("n_name").alias("designation"),
            base.alias("base_salary"),
            (23 - F.col("k1") % 6).cast("bigint").alias("present_days"),
            F.lit(23).cast("bigint").alias("total_working_days"),
            (F.col("k2") % 20 + planted_hours).cast("bigint").alias("overtime_hours"),
            (300 + 100 * (key % 3)).cast("bigint").alias("overtime_pay_per_hour"),
            planted_pay.cast("bigint").alias("planted_pay"),
            (F.col("k1") % 6).cast("bigint").alias("lop_days"),
        )
    )
    earned = F.floor(
        F.col("base_salary").cast("double") * F.col("present_days").cast("double") / 23.0
    ).cast("bigint")
    net = earned + F.col("overtime_hours") * F.col("overtime_pay_per_hour") + F.col("planted_pay")
    return people.select(
        "employee_id", "run_id", "department", "designation", "base_salary", "present_days",
        "total_working_days", "overtime_hours", "overtime_pay_per_hour",
        net.alias("net_salary"), "lop_days",
    )


def dirty_pay_records(spark: SparkSession, folder: str) -> DataFrame:
    """The same records with nulls, impossible values, text in a number column and exact copies."""
    k = F.substring("employee_id", 2, 20).cast("bigint")

    def every(n: int):
        return F.col("k") % n == 0

    rows = (
        pay_records(spark, folder)
        .withColumn("k", k)
        .select(
            "k",
            F.when(every(101), None).otherwise(F.col("employee_id")).alias("employee_id"),
            "run_id",
            F.when(every(13), None).otherwise(F.col("department")).alias("department"),
            "designation",
            F.when(every(89), None).when(every(97), -F.col("base_salary"))
            .otherwise(F.col("base_salary")).alias("base_salary"),
            F.when(every(11), None).when(every(19), F.lit(25).cast("bigint"))
            .when(every(23), F.lit(-2).cast("bigint"))
            .otherwise(F.col("present_days")).alias("present_days"),
            F.when(every(17), None).otherwise(F.col("total_working_days")).alias("total_working_days"),
            F.when(every(7), None).when(every(31), -F.col("overtime_hours") - 1)
            .otherwise(F.col("overtime_hours")).alias("overtime_hours"),
            F.when(every(43), "n/a").otherwise(F.col("overtime_pay_per_hour").cast("string"))
            .alias("overtime_pay_per_hour"),
            F.when(every(83), F.lit(0).cast("bigint")).otherwise(F.col("net_salary")).alias("net_salary"),
            "lop_days",
        )
    )
    # Copies come from repeating rows in place, so the records are derived once.
    copies = F.when(every(29), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("k", "copy")
