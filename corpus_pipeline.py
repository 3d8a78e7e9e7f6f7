"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next.

Defined results: documents without an id go through every stage unchanged, except that quality, copies and leaks are never found
for them, and they are packed under a null id. Null and empty texts hold no line, shingle or benchmark token; whether
they stay is for the quality model to say. Rows that share an id are one document to the stages that drop: what
is decided on the id holds for all of them. Line deduplication changes each row by its own text, so none is lost.
Ties (equal texts) go to the smaller id. Texts are read whole, however long. An empty table passes through empty. Further
columns are kept as they are, whatever their names, up to packing, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import decontaminate, line_dedup, near_dup, ordinal, packing
from tallyward.llm.staging import Shelf, keep

#: No SQL says these stages (a fitted model, an alignment, a packing); tests compare them with plain versions.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids``; documents without an id stay."""
    return docs.join(ids.where("doc_id is not null").distinct(), "doc_id", "left_anti").select(docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably not of the top grade go."""
    model = ordinal.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = keep(ordinal.graded(docs, model).select("doc_id", "kept"), "verdict")
    return _without(docs, verdict.where("not kept").select("doc_id"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go; the character count follows. Every document stays."""
    cleaned = line_dedup.dedup_lines(docs).where("doc_id is not null and n_removed > 0")
    row, left = _free(docs, "row"), _free(docs, "left")
    # A row is known by its id and the hash of its text, under names that no column of the documents has.
    new = cleaned.select(F.struct("doc_id", "input_hash").alias(row), F.col("text").alias(left)).dropDuplicates([row])
    own = docs.withColumn(row, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("input_hash")))
    changed = F.col(left).isNotNull()
    columns = {"text": F.coalesce(left, "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.char_length(left).cast(kind)).otherwise(F.col("n_chars"))
    return own.join(new, row, "left").withColumns(columns).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return _without(docs, near_dup.near_duplicates(docs).where("not kept").select("doc_id"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return _without(docs, decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token sequences of at most 1,024, one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote is removed when the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Shelf(spark)
    for name, stage in STAGES:
        own = Shelf(spark)
        docs = own.put(stage(spark, docs, sf_dir), name)
        before.drop()
        before = own
    return docs
