"""Near-duplicate groups by b-bit MinHash.

Every distinct set of word shingles (a class of documents) gets 128 minima. Bands of full minima give
candidates, packed low bits of all minima estimate their similarity by bit counts, and what the estimate
leaves is confirmed on the full shingle sets. Groups are the connected components of the confirmed links.

How large groups of copies stay cheap without losing a link:

* Equal sets are one class, so exact copies never meet each other.
* First every class of a bucket is compared with the bucket's smallest class only.
* Then only pairs of a bucket that are not yet in one component are compared, in tiles of bounded size. Bit counts
  and, after them, sets of half-width hashes are compared inside the task, so that of a group of copies only about as
  many pairs leave it as it has members.

Defined results: a document without words (null or blank text) has an empty set and is linked with nothing.
A null ``doc_id`` comes back unlinked and kept, with a null component. Repeated rows of one id are kept as they
are. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import words
from tallyward.llm.links import components
from tallyward.llm.staging import Shelf, keep

HASHES, BITS = 128, 4
#: 25 bands of 5 minima miss a pair at similarity 0.85 with probability 4e-7, at 0.8 with 5e-5.
BANDS, ROWS = 25, 5
#: Standard deviations of the estimate by which it may fall short before a candidate is dropped.
SLACK = 5.0
#: Classes on one side of a tile.
TILE = 256
#: How far half-width hashes can put a similarity off, with a wide margin.
DOUBT = 0.01

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    values, bounds = words.hashed(texts, lower=True)
    shingles, own = words.runs(values, bounds, width)
    for k in range(len(texts)):
        if own[k + 1] > own[k]:
            yield np.unique(shingles[own[k] : own[k + 1]])
        elif bounds[k + 1] > bounds[k]:
            yield np.array([words.whole(values[bounds[k] : bounds[k + 1]])])
        else:
            yield np.empty(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each of the permutations of 32-bit numbers over a set."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(folded), 2048):
        part = folded[k : k + 2048, None] * FACTORS
        part += SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, sixteen to a 64-bit number."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def _sketcher(width: int):
    def run(batches):
        for part in words.slices(batches):
            sets = list(shingle_sets(part.column("text"), width))
            least = [minima(s) for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([packed(m).view(np.int64) for m in least], pa.list_(pa.int64())),
                    pa.array([band_keys(m).view(np.int64) for m in least], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "node", "sig", "bands"],
            )

    return run


def _full_sets(width: int):
    def run(batches):
        for part in words.slices(batches):
            sets = list(shingle_sets(part.column("text"), width))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["node", "shingles"],
            )

    return run


def floor_of(percent: int) -> float:
    """Estimates below this are dropped: the threshold less the slack of an estimate from 128 samples."""
    share = percent / 100
    return share - SLACK * (share * (1 - share) / HASHES) ** 0.5


def estimate(left, right):
    """Similarity from two packed signatures: share of equal low bits, corrected for chance agreement."""
    fold = F.zip_with(left, right, lambda x, y: x.bitwiseXOR(y))
    ones = F.lit(0x1111111111111111)

    def differing(x):
        any_bit = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        return F.bit_count(any_bit.bitwiseAND(ones))

    apart = F.aggregate(fold, F.lit(0), lambda total, x: total + differing(x))
    chance = 2.0**-BITS
    return ((1 - apart / F.lit(float(HASHES))) - F.lit(chance)) / F.lit(1 - chance)


def _tile_pairs(percent: int):
    """Pairs of different components in one tile that may be links, by bit counts and then by half-width sets.

    A pair is looked at in the first band that it shares. Of pairs that surely are links only those that join two
    components go out; pairs within ``DOUBT`` of the threshold all do. The full sets decide afterwards.
    """
    floor, share, bit = floor_of(percent), percent / 100, np.uint64(0x1111111111111111)

    def run(table: pa.Table) -> pa.Table:
        node, side = table.column("node").to_pylist(), table.column("side").to_numpy()
        parent: dict[bytes, bytes] = {}
        label = table.column("label").to_pylist()
        sig = np.array(table.column("sig").to_pylist(), np.int64).view(np.uint64).reshape(len(node), -1)
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(node), -1)
        here = int(np.flatnonzero(bands[0] == table.column("band")[0].as_py())[0])
        sets = [np.unique(x.values.to_numpy()) for x in table.column("folded")]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(two)
        two = one if within else two
        left, right = [], []

        def root(x: bytes) -> bytes:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for k in one:
            x = sig[two] ^ sig[k]
            x = (x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))) & bit
            same = 1 - np.bitwise_count(x).sum(axis=1) / HASHES
            likely = (same - 2.0**-BITS) / (1 - 2.0**-BITS) >= floor
            likely &= (bands[two] == bands[k]).argmax(axis=1) == here
            if within:
                likely &= two > k
            for j in two[likely]:
                ours, theirs = root(label[k]), root(label[j])
                if ours == theirs:
                    continue
                common = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                close = common / (len(sets[k]) + len(sets[j]) - common)
                if close >= share - DOUBT:
                    left.append(min(node[k], node[j]))
                    right.append(max(node[k], node[j]))
                    if close >= share + DOUBT:
                        parent[max(ours, theirs)] = min(ours, theirs)
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("n") >= percent * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Group documents whose word shingle sets have at least ``percent`` / 100 in common.

    Takes ``doc_id, text``; returns ``doc_id, n_shingles, class_key, component_id, kept`` per input row. ``class_key``
    names the distinct set, ``component_id`` is the smallest id reachable over links, ``kept`` marks that document.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketch = shelf.put(
        docs.mapInArrow(
            _sketcher(width), "doc_id long, n_shingles long, node binary, sig array<long>, bands array<long>"
        ),
        "sketch",
    )
    usable = sketch.where("node is not null and doc_id is not null")
    heads = usable.groupBy("node").agg(F.min("doc_id").alias("head"))
    distinct = usable.join(heads, "node").where("doc_id = head").dropDuplicates(["node"])
    classes = shelf.put(distinct.select("node", "head", "sig", "bands"), "classes")

    entries = classes.select(F.explode("bands").alias("band"), "node")
    buckets = entries.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = shelf.put(entries.join(buckets, "band"), "members")
    signatures = classes.select("node", "sig")

    def sided(name):
        return signatures.select(F.col("node").alias(name), F.col("sig").alias(f"sig_{name}"))

    star = members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    likely = star.join(sided("b"), "b").join(sided("a"), "a")
    first = shelf.put(likely.where(estimate(F.col("sig_a"), F.col("sig_b")) >= floor_of(percent)).select("a", "b"), "star")

    # Full sets only of classes that share a bucket with another, rebuilt from the text of one document each.
    needed = members.select("node").distinct().join(classes.select("node", F.col("head").alias("doc_id")), "node")
    wanted = docs.join(needed.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    sets = wanted.mapInArrow(_full_sets(width), "node binary, shingles array<long>").dropDuplicates(["node"])
    sets = shelf.put(sets, "sets")

    links = shelf.put(confirmed(first, sets, percent), "links")
    labels = components(links)

    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    open_rows = placed.join(mixed.select("band"), "band").withColumn("tiles", tiles)
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    copies = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    folded = F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("folded")
    detail = sets.select("node", folded).join(classes.select("node", "sig", "bands"), "node")
    tiled = copies.join(detail, "node").select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "label", "sig", "bands", "folded",
    )
    pairs = tiled.groupBy("band", "i", "j").applyInArrow(_tile_pairs(percent), "a binary, b binary").distinct()
    rest = shelf.put(confirmed(pairs.join(first, ["a", "b"], "left_anti"), sets, percent), "links")
    labels = components(links.union(rest))

    grouped = classes.select("node", "head").join(labels, "node", "left")
    grouped = grouped.withColumn("label", F.coalesce("label", "node"))
    lowest = grouped.groupBy("label").agg(F.min("head").alias("component_id"))
    named = grouped.join(lowest, "label").select("node", "component_id")
    out = sketch.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    result = keep(
        out.select(
            "doc_id", "n_shingles", F.hex("node").alias("class_key"), component.alias("component_id"),
            F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        ),
        "near_duplicates",
    )
    shelf.drop()
    return result
