"""Stage tables that are removed when their reader is done, and sizes checked before a broadcast."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.session import fresh_path

#: Seconds that Spark's listeners get to hear of the end of a query.
LISTENERS_S = 1.5


class Shelf:
    """Parquet stage tables in the shared folder, each removed by ``drop`` once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.tables: list[str] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def deal(self, df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
        """A stage table bucketed by a column, so that grouping by it moves no row."""
        path = fresh_path(self.spark, label)
        name = "stage_" + path.rsplit("-", 1)[1]
        self.paths.append(path)
        self.tables.append(name)
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.clear()


@contextmanager
def shelf(spark: SparkSession):
    """Stage tables for the length of a block; what leaves the block must not read them."""
    own = Shelf(spark)
    try:
        yield own
    finally:
        own.drop()


def let_go(spark: SparkSession) -> None:
    """What finished queries shuffled goes from the disks, if no plan in use holds it.

    Spark does so when the driver collects its garbage. Listeners hold the last query until they have heard of its end, so the
    driver is asked again a moment later; else its shuffle would lie there until the end of the next.
    """
    spark._jvm.System.gc()
    time.sleep(LISTENERS_S)
    spark._jvm.System.gc()


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a result once, so that it does not depend on stage tables that are removed."""
    return Shelf(df.sparkSession).put(df, label)


def small_side(settled: DataFrame, rows: int) -> DataFrame:
    """Mark a written table for broadcast if it has at most ``rows`` rows; else it joins by shuffle."""
    return F.broadcast(settled) if settled.limit(rows + 1).count() <= rows else settled
