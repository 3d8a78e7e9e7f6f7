"""Repeated lines by pairwise alignment: overlapping documents are found through shared runs of lines, aligned with
patience diff, and common blocks go from the later one.

Defined result: what aligning each document with every earlier one removes. A common block has at least ``BLOCK_WORDS``
words, and every line of it lies in a shortest run of so many words, counted on from the line or back from it, that lies in
the block. So only documents that share such a run are paired, and only until the run is gone.

Documents with the same sequence of lines are one class: its first document stands for all, and the others lose every line
with words (aligned with the first, all of them are one block). First documents are aligned with the first holder of each of their runs. For
the few runs that still stand, all other earlier holders are tried, in slices of two, two, four, eight ... of them (by a
hash of the holder), so that a run held by n documents takes at most log n rounds. Alignment needs line hashes only, so texts are
never joined to pairs.

Null text has no lines. Rows with a null id are neither paired nor changed. Of rows that share an id the one with the
smallest text hash is compared, and only its lines go. Lines without a word stay, and count in a block. A text of any
length is read whole; it is one row of line hashes. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm import words
from tallyward.llm.staging import Shelf, keep
from tallyward.llm.staging import shelf as shelf_of

#: Words of a block that goes, and of a run that pairs documents.
BLOCK_WORDS = 8
#: Pairs aligned at a time in a task.
BATCH = 200


def line_hash(line: Column) -> Column:
    """Hash of a line without the white space around it; 0 for a line without words."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.lit(0).cast("long")).otherwise(F.xxhash64(bare))


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def _increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (i, j), sorted by i, whose j rise too."""
    piles: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(places):
        k = bisect_left(piles, j)
        back.append(tops[k - 1] if k else -1)
        if k == len(piles):
            piles.append(j)
            tops.append(n)
        else:
            piles[k], tops[k] = j, n
    out, n = [], tops[-1] if tops else -1
    while n >= 0:
        out.append(places[n])
        n = back[n]
    return out[::-1]


def patience(one: list[int], two: list[int]) -> list[tuple[int, int]]:
    """Matched places of two line sequences: common ends, then lines unique to both in rising order, then what lies
    between them in the same way."""
    matched: list[tuple[int, int]] = []
    open_ranges = [(0, len(one), 0, len(two))]
    while open_ranges:
        a, b, c, d = open_ranges.pop()
        while a < b and c < d and one[a] == two[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        in_one, in_two = Counter(one[a:b]), Counter(two[c:d])
        place = {x: j for j, x in enumerate(two[c:d], c) if in_two[x] == 1 and x}
        anchors = _increasing([(i, place[x]) for i, x in enumerate(one[a:b], a) if in_one[x] == 1 and x in place])
        i, j = a, c
        for p, q in anchors:
            matched.append((p, q))
            open_ranges.append((i, p, j, q))
            i, j = p + 1, q + 1
        if anchors:
            open_ranges.append((i, b, j, d))
    return sorted(matched)


def common_lines(earlier: list[int], later: list[int], n_words: list[int], least: int) -> list[int]:
    """Places in the later document of the aligned blocks with at least ``least`` words."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(n_words[k] for k in block) >= least:
                out += [k for k in block if later[k]]
            block = []
        block.append(j)
        before = (i, j)
    return out


def runs_of(lines: np.ndarray, n_words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash, first and last place of the shortest runs of ``BLOCK_WORDS`` words that begin or end at each line with
    words. Places count only such lines, so a run has at most ``BLOCK_WORDS`` of them."""
    total = np.concatenate(([0], np.cumsum(n_words)))
    place = np.concatenate(([0], np.cumsum(lines != 0)))
    full = np.flatnonzero(lines)
    doc = np.searchsorted(bounds, full, side="right") - 1
    last = np.searchsorted(total, total[full] + BLOCK_WORDS, side="left") - 1
    first = np.searchsorted(total, total[full + 1] - BLOCK_WORDS, side="right") - 1
    on, back = last < bounds[doc + 1], first >= bounds[doc]
    doc = np.concatenate((doc[on], doc[back]))
    first, last = np.concatenate((full[on], first[back])), np.concatenate((last[on], full[back]))
    # As for the bytes of a word: a polynomial with the lines as coefficients, from running sums.
    value = words.mix(lines.view(np.uint64) + np.uint64(1)) * words._powers(len(lines))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    run = words.mix((sums[last + 1] - sums[first]) * words._inverses(len(lines))[first] + (last - first).astype(np.uint64))
    begin = place[bounds[doc]]
    return doc, run, place[first] - begin, place[last] - begin


def _align(batches):
    """The places of each later document that go, counted over its lines with words."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            columns = [part.column(c).to_pylist() for c in ("earlier_lines", "lines", "n_words")]
            gone = []
            for earlier, later, n_words in zip(*columns, strict=True):
                place = np.cumsum(np.array(later) != 0) - 1
                gone.append(place[np.array(common_lines(earlier, later, n_words, BLOCK_WORDS), np.int64)].tolist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "gone"])


def _runs(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            lines, n_words = part.column("lines"), part.column("n_words")
            bounds = np.concatenate(([0], np.cumsum(lines.value_lengths().to_numpy()))).astype(np.int64)
            doc, run, first, last = runs_of(lines.flatten().to_numpy(), n_words.flatten().to_numpy(), bounds)
            found = np.unique(np.stack((doc, run.view(np.int64), first, last)), axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(found[0])), pa.array(found[1]), *(pa.array(x.astype(np.int32)) for x in found[2:])],
                ["doc_id", "run", "first", "last"],
            )


def _lines_of(docs: DataFrame) -> DataFrame:
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    listed = docs.select(
        "doc_id", F.xxhash64("text").alias("_key"), F.transform(split, line_hash).alias("lines"),
        F.transform(split, lambda x: _words(x)).alias("n_words"),
    )
    one = listed.where("doc_id is not null").groupBy("doc_id")
    return one.agg(F.min_by(F.struct("lines", "n_words"), "_key").alias("_")).select("doc_id", "_.lines", "_.n_words")


def _aligned(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """The places that go from the later documents of distinct pairs ``doc_id, earlier``: ``doc_id, at``, one row per place."""
    paired = pairs.join(listed.select(F.col("doc_id").alias("earlier"), F.col("lines").alias("earlier_lines")), "earlier")
    paired = paired.join(listed, "doc_id").select("doc_id", "earlier_lines", "lines", "n_words")
    found = paired.mapInArrow(_align, "doc_id long, gone array<int>").where(F.size("gone") > 0)
    return found.select("doc_id", F.explode("gone").alias("at"))


def _standing(runs: DataFrame, gone: DataFrame) -> DataFrame:
    """The runs of which a line is not gone."""
    left = F.size(F.array_except(F.sequence("first", "last"), F.coalesce("at", F.array().cast("array<int>")))) > 0
    return runs.join(gone, "doc_id", "left").where(left).select(runs.columns)


def _slices(open_runs: DataFrame, shared: DataFrame) -> DataFrame:
    """The holders of open runs, dealt to slices by hash: 0 holds two of them on average, and each next one as many as all
    before it."""
    own = shared.join(open_runs.select("run").distinct(), "run", "left_semi").select("run", F.col("doc_id").alias("earlier")).distinct()
    sizes = own.groupBy("run").agg(F.count("*").alias("size"))
    place = F.pmod(F.xxhash64("run", "earlier"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("size")
    return own.join(sizes, "run").select("run", "earlier", F.floor(F.log2(F.greatest(place, F.lit(1.0)))).cast("int").alias("slice"))


def _removed_by_pairs(listed: DataFrame, shelf: Shelf) -> DataFrame:
    """``doc_id, at``: the places (counted over lines with words) that go from documents of different line sequences."""
    held = shelf.put(listed.mapInArrow(_runs, "doc_id long, run long, first int, last int"), "held")
    holders = held.groupBy("run").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("other")).where("other > holder")
    holders = shelf.put(holders.select("run", "holder"), "holders")
    shared = shelf.put(held.join(holders, "run").select("doc_id", "run", "first", "last", "holder"), "shared")
    pairs = shared.where("doc_id > holder").select("doc_id", F.col("holder").alias("earlier")).distinct()
    gone = shelf.put(_aligned(pairs, listed).groupBy("doc_id").agg(F.collect_set("at").alias("at")), "gone")
    open_runs = shelf.put(_standing(shared.where("doc_id > holder"), gone).select("doc_id", "run", "first", "last"), "open")
    if open_runs.isEmpty():
        return gone
    dealt = shelf.put(_slices(open_runs, shared), "dealt")
    for k in sorted(r["slice"] for r in dealt.select("slice").distinct().collect()):  # at most 64 numbers
        pairs = open_runs.join(dealt.where(F.col("slice") == k), "run").where("earlier < doc_id").select("doc_id", "earlier").distinct()
        found = shelf.put(_aligned(pairs, listed), "found")
        if found.isEmpty():
            continue
        both = found.union(gone.select("doc_id", F.explode("at").alias("at")))
        gone = shelf.put(both.groupBy("doc_id").agg(F.collect_set("at").alias("at")), "gone")
        open_runs = shelf.put(_standing(open_runs, gone), "open")
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Remove from each document the blocks of lines that align with an earlier one (of smaller id).

    Takes ``doc_id, text``; returns ``doc_id, n_lines, n_removed, words_removed, text, input_hash`` per input row, the
    last being ``xxhash64`` of the text before. Blocks are
    judged on the input, not on what is left of it.
    """
    with shelf_of(docs.sparkSession) as shelf:
        return _cleaned(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), shelf)


def _cleaned(docs: DataFrame, shelf: Shelf) -> DataFrame:
    listed = shelf.put(_lines_of(docs), "lines")
    # Two hashes of the whole sequence tell classes apart.
    sequence = [F.xxhash64("lines", F.lit(1)).alias("one"), F.xxhash64(F.reverse("lines"), F.lit(2)).alias("two"), F.size("lines").alias("n")]
    leads = shelf.put(listed.groupBy(*sequence).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "leads")
    first = shelf.put(listed.join(leads, "doc_id", "left_semi"), "first")
    copies = listed.join(leads, "doc_id", "left_anti").where(F.aggregate("n_words", F.lit(0), lambda a, x: a + x) >= BLOCK_WORDS)
    n_full = F.size(F.filter("lines", lambda x: x != 0))
    gone = _removed_by_pairs(first, shelf).unionByName(copies.select("doc_id", F.sequence(F.lit(0), n_full - 1).alias("at")))
    full = F.filter(F.transform("lines", lambda x, k: F.struct(k.alias("at"), x.alias("line"))), lambda x: x["line"] != 0)
    gone = gone.join(listed.select("doc_id", full.alias("full")), "doc_id")
    gone = shelf.put(gone.select("doc_id", F.transform("at", lambda k: F.get("full", k)).alias("gone")), "gone")

    full = docs.join(gone, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<at: int, line: bigint>>")))
    full = full.withColumn("all", F.split(F.coalesce("text", F.lit("")), "\n"))
    marked = F.transform("all", lambda x, k: F.struct(
        x.alias("line"),
        ((F.size("gone") > 0) & F.array_contains("gone", F.struct(k.alias("at"), line_hash(x).alias("line")))).alias("gone"),
    ))
    full = full.withColumn("marked", F.when(F.size("gone") > 0, marked))
    out = F.filter("marked", lambda x: x["gone"])
    stay = F.transform(F.filter("marked", lambda x: ~x["gone"]), lambda x: x["line"])
    return keep(
        full.select(
            "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_lines"),
            F.coalesce(F.size(out), F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce(F.aggregate(out, F.lit(0).cast("long"), lambda a, x: a + _words(x["line"])), F.lit(0)).alias("words_removed"),
            F.coalesce(F.array_join(stay, "\n"), F.col("text")).alias("text"), F.xxhash64("text").alias("input_hash"),
        ),
        "line_dedup",
    )
