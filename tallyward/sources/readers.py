"""Scans of incoming files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tallyward.functions.scalars import NUMBER, WHOLE
from tallyward.operators.schema import tidy_names

# Texts that stand for a missing value in delimited files.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


# Texts without digits that are numbers all the same.
ENDLESS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def read_records(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """Read CSV, JSON or Parquet by extension; column names come back trimmed and lower-cased.

    A given schema saves the pass that infers types. JSON has one record per line, so that files are split over tasks;
    ``multi_line`` reads files that are one array, each in one task.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported file type: {path}")
    try:
        if kind == "csv":
            df = read_csv(spark, path, schema)
        elif kind == "json":
            reader = spark.read.option("multiLine", multi_line)
            df = (reader.schema(schema) if schema else reader).json(path)
        else:
            df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    return tidy_names(df)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    if schema:
        return without_missing_texts(spark.read.schema(schema).csv(path, header=True))
    return with_inferred_types(without_missing_texts(spark.read.csv(path, header=True, inferSchema=False)))


def without_missing_texts(df: DataFrame) -> DataFrame:
    """Null wherever a text stands for a missing value."""
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`")
            for c, kind in df.dtypes
        ]
    )


def with_inferred_types(text: DataFrame) -> DataFrame:
    """Turn text columns that hold only numbers into integers or doubles. One aggregate decides for all."""
    names = text.columns
    tests = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        tests += [
            F.count(x).alias(f"n_{i}"),
            F.count(F.when(x.rlike(WHOLE), x.try_cast("bigint"))).alias(f"i_{i}"),
            F.count(F.when(x.rlike(NUMBER) | F.lower(F.trim(x)).isin(ENDLESS), x.try_cast("double"))).alias(f"d_{i}"),
        ]
    seen = text.agg(*tests).first()
    chosen = []
    for i, c in enumerate(names):
        x, n = F.col(f"`{c}`"), seen[f"n_{i}"]
        # A whole-number column with gaps stays a double, as does a column without any value.
        if seen[f"i_{i}"] == n and n:
            chosen.append(x.cast("bigint").alias(c))
        elif seen[f"d_{i}"] == n and n:
            chosen.append(x.cast("double").alias(c))
        else:
            chosen.append(x.alias(c))
    return text.select(*chosen)


def batch_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_hash) of a batch as one row, over the lines of all its files."""
    return _digest(spark.read.text(path), []).select(F.lit(path).alias("path"), "file_hash")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_hash) of every file under a path."""
    return _digest(spark.read.text(path).withColumn("path", F.col("_metadata.file_path")), ["path"])


def _digest(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A digest of file contents that is summed up from the splits of a scan, whatever the size of a file.

    Count, sum and exclusive or of two 64-bit hashes of the lines; the order of lines does not count.
    """
    one, two = F.xxhash64("value"), F.xxhash64("value", F.lit(1))
    figures = [F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.bit_xor(one), F.sum(two.cast("decimal(38,0)")), F.bit_xor(two)]
    text = F.concat_ws(",", *[F.coalesce(x.cast("string"), F.lit("")) for x in figures])
    return lines.groupBy(*keys).agg(F.md5(text).alias("file_hash"))
