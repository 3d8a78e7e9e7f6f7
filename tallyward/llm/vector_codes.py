"""Vector compression to part codes (product quantization), with nearest entries found by LAESA.

Components become integers ``floor(1024 * x)``; a vector is cut into ``PARTS`` equal consecutive parts; each part position has
a codebook of up to ``ENTRIES`` entries, refined in ``ROUNDS`` rounds of assignment and componentwise ``floor(sum / count)``.
LAESA: the distances of every part to a few fixed pivots are computed once. In each round the distances of pivots and
entries give a lower bound for every part and entry, ``max |d(part, pivot) - d(pivot, entry)|``; entries are tried in its
order, and those whose bound exceeds the best distance found are never evaluated. Evaluations are on integers, so results
are exact; ties go to the lower index.

Scale: rows stay where they are. A round is one scan that returns sums per part, entry and place (a table of fixed size,
combined in each task before it moves), which the driver turns into the next codebook. Label sums join by broadcast up to
``BROADCAST_LABELS`` labels and by shuffle beyond.

Defined results: rows whose vector is null, or holds a null or a component that is not finite, are dropped. So are vectors
without components and those of another length than the first kept one (smallest id), or if that length cannot be cut
into equal parts, all. Components beyond +-``LARGEST`` after scaling count as that, so that errors fit 64 bits. Rows
without an id are coded but never start a codebook entry unless ids run out (they come last). Repeated ids are separate
rows, ordered by their components. With fewer kept rows than entries the codebook is as small. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import words
from tallyward.llm.staging import Shelf, keep, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Fixed pivots of each part position.
PIVOTS = 24
#: Entries tried before pruning, the ones with the smallest lower bounds.
FIRST = 4
#: Rows handled at once in a task.
ROWS = 4096
LARGEST = 1 << 26
#: Label sums that are broadcast at most; a row has 24 bytes.
BROADCAST_LABELS = 100_000


@dataclass
class Codebook:
    """Entries and pivots of each part position: ``parts x entries x width`` and ``parts x pivots x width`` integers."""

    entries: np.ndarray
    pivots: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of integer rows to integer points, as doubles."""
    gaps = rows[:, None, :] - points[None, :, :]
    return np.sqrt(np.einsum("ijk,ijk->ij", gaps, gaps).astype(float))


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each next one farthest from those before it (ties to the lower index)."""
    chosen = [0]
    least = distances(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def nearest(rows: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of every row, its squared distance, and how many exact evaluations that took."""
    from_pivots = distances(entries, pivots)
    bound = np.zeros((len(rows), len(entries)))
    for k in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, k, None] - from_pivots[None, :, k]), out=bound)
    first = min(FIRST, len(entries))
    tried = np.argpartition(bound, first - 1, axis=1)[:, :first] if first < len(entries) else np.tile(np.arange(first), (len(rows), 1))
    # Components are narrow where the sums of their squares still fit.
    largest = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max()))
    if 4 * largest * largest * rows.shape[1] < 1 << 31:
        rows, entries = rows.astype(np.int32), entries.astype(np.int32)
    gaps = rows[:, None, :] - entries[tried]
    exact = np.einsum("ijk,ijk->ij", gaps, gaps).astype(np.int64)
    best = exact.min(axis=1)
    index = np.where(exact == best[:, None], tried, len(entries)).min(axis=1)
    # A bound is off by rounding (distances to pivots are kept in 32 bits) at most by this share of the distances it was made of.
    slack = 1e-6 * (1 + to_pivots.max(axis=1, initial=0) + from_pivots.max(initial=0))
    limit, n = np.sqrt(best.astype(float)) + slack, tried.size
    np.put_along_axis(bound, tried, np.inf, axis=1)
    for e in np.argsort(bound.min(axis=0), kind="stable").tolist():
        row = np.flatnonzero(bound[:, e] <= limit)
        if not len(row):
            continue
        n += len(row)
        gaps = rows[row] - entries[e]
        exact = np.einsum("ij,ij->i", gaps, gaps)
        better = (exact < best[row]) | ((exact == best[row]) & (e < index[row]))
        row, exact = row[better], exact[better]
        best[row], index[row], limit[row] = exact, e, np.sqrt(exact.astype(float)) + slack[row]
    return index, best, n


def _vectors(batches):
    """Slices of a batch with its integer rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, part.column("parts").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)


def _cut(rows: np.ndarray, part: int) -> np.ndarray:
    width = rows.shape[1] // PARTS
    return rows[:, part * width : (part + 1) * width]


def _pivot_distances(pivots: np.ndarray):
    def run(batches):
        for part, rows in _vectors(batches):
            far = np.concatenate([distances(_cut(rows, k), pivots[k]) for k in range(PARTS)], axis=1)
            lists = words.list_array(far.ravel().astype(np.float32), np.arange(len(rows) + 1) * far.shape[1])
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "far"])

    return run


def _assigned(book: Codebook):
    """Slices with the entry and squared distance of every part."""

    def run(batches):
        for part, rows in _vectors(batches):
            far = part.column("far").flatten().to_numpy().astype(float).reshape(len(rows), PARTS, -1)
            found = [nearest(_cut(rows, k), far[:, k], book.entries[k], book.pivots[k]) for k in range(PARTS)]
            yield part, rows, np.stack([x[0] for x in found], axis=1), np.stack([x[1] for x in found], axis=1)

    return run


def _sums(book: Codebook):
    assigned = _assigned(book)

    def run(batches):
        n_entries, width = book.entries.shape[1:]
        total, count = np.zeros((PARTS, n_entries, width), np.int64), np.zeros((PARTS, n_entries), np.int64)
        for _, rows, index, _ in assigned(batches):
            for k in range(PARTS):
                np.add.at(total[k], index[:, k], _cut(rows, k))
                count[k] += np.bincount(index[:, k], minlength=n_entries)
        part, entry = np.nonzero(count)
        place = np.arange(width)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width).astype(np.int32)), pa.array(np.repeat(entry, width).astype(np.int32)),
                pa.array(np.tile(place, len(part)).astype(np.int32)), pa.array(total[part, entry].ravel()), pa.array(np.repeat(count[part, entry], width)),
            ],
            ["part", "entry", "place", "total", "n"],
        )

    return run


def _codes(book: Codebook):
    assigned = _assigned(book)

    def run(batches):
        for part, _, index, exact in assigned(batches):
            code = ["".join(f"{x:02x}" for x in row) for row in index.tolist()]
            columns = [part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(exact.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def _kept(vectors: DataFrame) -> DataFrame:
    """Rows with integer components; unusable vectors are gone."""
    value = F.col("embedding").cast("array<double>")
    usable = (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = F.transform(value, lambda x: F.least(F.greatest(F.floor(F.lit(float(SCALE)) * F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15))), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    rows = vectors.where(value.isNotNull() & usable)
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), bounded.alias("parts"))


def train(staged: DataFrame, shelf: Shelf) -> tuple[DataFrame, Codebook] | None:
    """The usable rows with their pivot distances (staged), and the final codebook; None without usable rows."""
    heads = staged.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(ENTRIES)
    first = heads.limit(1).collect()
    width = len(first[0]["parts"]) if first else 0
    if not width or width % PARTS:
        return None
    staged = staged.where(F.size("parts") == width)
    rows = staged.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(ENTRIES).collect()  # the starting codebook
    start = np.array([r["parts"] for r in rows], np.int64)
    entries = np.stack([_cut(start, k) for k in range(PARTS)])
    # Pivots are as many for each part, the last one repeated where a position has fewer distinct entries.
    chosen = [spread(entries[k], PIVOTS) for k in range(PARTS)]
    most = max(map(len, chosen))
    pivots = np.stack([np.concatenate((x, np.repeat(x[-1:], most - len(x), axis=0))) for x in chosen])
    far = shelf.put(staged.mapInArrow(_pivot_distances(pivots), "vec_id long, label long, parts array<int>, far array<float>"), "pivots")
    for _ in range(ROUNDS):
        partial = far.mapInArrow(_sums(Codebook(entries, pivots)), "part int, entry int, place int, total long, n long")
        # At most parts x entries x places rows.
        found = partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        entries = entries.copy()
        for r in found:
            entries[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return far, Codebook(entries, pivots)


def encode(vectors: DataFrame) -> DataFrame:
    """Code every usable vector: ``vec_id, label, code, error, label_error, codebooks_sha256``.

    Takes ``vec_id, embedding, label``. ``error`` is the squared distance to the entries, summed over the parts;
    ``label_error`` its sum over all rows of the label, rows without one together.
    """
    schema = "vec_id long, label long, code string, error long, label_error long, codebooks_sha256 string"
    shelf = Shelf(vectors.sparkSession)
    try:
        trained = train(shelf.put(_kept(vectors), "vectors"), shelf)
        if trained is None:
            return vectors.sparkSession.createDataFrame([], schema)
        far, book = trained
        coded = shelf.put(far.mapInArrow(_codes(book), "vec_id long, label long, code string, error long"), "codes")
        key = [F.coalesce("label", F.lit(0)).alias("_label"), F.col("label").isNull().alias("_none")]
        sums = shelf.put(coded.groupBy(*key).agg(F.sum("error").alias("label_error")), "label_sums")
        out = coded.select("*", *key).join(small_side(sums, BROADCAST_LABELS), ["_label", "_none"])
        out = out.select("vec_id", "label", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
        return keep(out, "vector_codes")
    finally:
        shelf.drop()
