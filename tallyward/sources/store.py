"""Stage tables and reports, partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_runs(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Write run partitions; runs already stored under other ids stay, the same run is replaced."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(run)
        .parquet(path)
    )


def read_run(spark: SparkSession, path: str, run_id: str, run: str = "run_id") -> DataFrame:
    """One run; the filter prunes to its partition. Raises FileNotFoundError for an unknown run."""
    df = read_history(spark, path, run).where(F.col(run) == run_id)
    if df.isEmpty():
        raise FileNotFoundError(f"no rows of run {run_id} under {path}")
    return df


def read_history(spark: SparkSession, path: str, run: str = "run_id") -> DataFrame:
    """All runs; a column some runs lack is null there. Only the columns asked for are read."""
    try:
        df = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(path) from error
        raise
    return df.withColumn(run, F.col(run).cast("string"))


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Add rows to a history table."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """Header also when there are no rows."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
