"""Benchmark decontamination by spaced seeds, in plain DataFrame expressions.

Two fixed masks pick six tokens each out of eight or nine and ignore the others. Whatever two of ``WINDOW`` tokens in
a row are replaced, one of the masks fits somewhere between them, so every overlap that the verification accepts has
a seed that hits. Hashes of the picked tokens of all benchmark items meet those of all documents; each hit names a
document, an item and how far the one is shifted against the other, and the tokens around it are then compared.

Tokens are runs of letters and digits in lower case. Items shorter than the window are found as a whole, without
replacements.

Defined results: null texts have no tokens. Rows with a null id cannot be named and are not reported. Rows that share
an id count as found if any of them is. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.staging import Shelf, keep, small_side

WINDOW, REPLACED = 13, 2
#: Places of the tokens that a mask keeps. A test shows that they cover every two replacements in a window.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: A seed row is 20 bytes of data, so a table of this many is small for any executor; larger ones join by shuffle.
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(hashes: str, n: Column, shapes: list[tuple[int, ...]]) -> Column:
    """Seeds of all shapes at every place, one shape after the other, null where a shape does not fit."""

    def one(number: int, shape: tuple[int, ...]) -> Column:
        def at(p: Column) -> Column:
            return F.when(
                p + shape[-1] < n, F.xxhash64(F.lit(number), *(F.get(hashes, p + k if k else p) for k in shape))
            )

        return F.transform(hashes, lambda h, p: at(p))

    return F.concat(*(one(number, shape) for number, shape in enumerate(shapes)))


def _seeded(rows: DataFrame, key: str, shapes: list[tuple[int, ...]]) -> DataFrame:
    """One row per seed of every row: ``key, place, seed``. Only seeds are exploded, never texts."""
    rows = rows.select(key, F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("_hashes"))
    rows = rows.withColumn("_n", F.size("_hashes"))
    rows = rows.select(key, "_n", _seeds("_hashes", F.col("_n"), shapes).alias("_seeds"))
    # The outer form: of the inner one Spark would infer a filter on the array and build it once more for that.
    rows = rows.select(key, "_n", F.posexplode_outer("_seeds").alias("_at", "seed")).where("seed is not null")
    return rows.select(key, (F.col("_at") % F.col("_n")).alias("place"), "seed")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents and benchmark items that share ``WINDOW`` tokens in a row, up to ``REPLACED`` replaced ones.

    Takes ``docs(doc_id, text)`` and ``items(item_id, text)``; returns ``doc_id, item_id, matched, first_token``: the most
    tokens of a window that agree, and where in the document the first such window begins.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string"))
    items = items.where("item_id is not null").select("item_id", F.col("text").cast("string"))
    listed = shelf.put(items.select("item_id", tokens(F.col("text")).alias("item")).where("size(item) > 0"), "items")
    short = listed.select(F.size("item").alias("n")).where(F.col("n") < WINDOW).distinct().collect()  # at most 12 rows
    shapes = [*MASKS, *(tuple(range(r["n"])) for r in sorted(short))]

    index = shelf.put(_seeded(items, "item_id", shapes).withColumnRenamed("place", "item_place"), "seeds")
    hits = _seeded(docs, "doc_id", shapes).join(small_side(index, BROADCAST_ROWS), "seed")
    hits = hits.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    # One row per document, so that its text meets all of its hits at once.
    hits = hits.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "shift")).alias("hits"))
    named = docs.join(hits, "doc_id").select("doc_id", tokens(F.col("text")).alias("words"), "hits")
    near = named.select("doc_id", "words", F.explode("hits").alias("hit")).select(
        "doc_id", F.col("hit.item_id").alias("item_id"), F.col("hit.shift").alias("shift"), "words"
    )
    near = near.join(small_side(listed, BROADCAST_ROWS // 50), "item_id")
    n, width = F.size("item"), F.least(F.size("item"), F.lit(WINDOW))
    agree = F.transform("item", lambda w, j: F.coalesce((F.get("words", F.col("shift") + j) == w).cast("int"), F.lit(0)))
    near = near.select("doc_id", "item_id", "shift", n.alias("n"), width.alias("width"), agree.alias("agree"))
    sums = F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("width")),
        lambda s: F.aggregate(F.slice("agree", s + 1, F.col("width")), F.lit(0), lambda a, x: a + x),
    )
    near = near.withColumn("sums", sums)
    wanted = F.when(F.col("width") < WINDOW, F.col("width")).otherwise(WINDOW - REPLACED)
    near = near.withColumn("first", F.array_position(F.transform("sums", lambda x: x >= wanted), F.lit(True)))
    found = near.where("first > 0").groupBy("doc_id", "item_id").agg(
        F.max(F.array_max("sums")).cast("long").alias("matched"),
        F.min(F.greatest(F.col("shift") + F.col("first") - 1, F.lit(0))).cast("long").alias("first_token"),
    )
    result = keep(found, "overlaps")
    shelf.drop()
    return result
