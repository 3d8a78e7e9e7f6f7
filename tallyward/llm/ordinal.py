"""Quality by ordinal regression: a cumulative-link model on graded ratings over hashed text.

One weight per hashed feature is shared by all grades; ordered thresholds cut the score into grades, so that
``P(grade >= k) = logistic(score - threshold_k)``. The expected grade and the probability of the upper tail rank and
select documents.

Features of a text: its lower-cased words and their beginnings of four and five bytes, each once, hashed into ``BUCKETS``;
and shares of word shapes (repeats, symbols, capitals). Ratings come from ``labels``: grade 0 for low quality, 1 for
acceptable but toxic, 2 for good.

Scale: the fit reads at most ``fit_rows`` labelled documents, the ones with the smallest hashes of their ids, so the sample
does not depend on how the table is dealt. Weights are a table of fixed size that travels with the task. Scoring reads every
document once and moves nothing.

Defined results: null or wordless texts have no features and score as the intercept. Null ids are scored. A document rated
more than once counts with its lowest grade; ratings with nulls are left out. Without usable ratings every document gets
null figures and is kept. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm import words

BUCKETS = 1 << 18
#: Buckets of the shape features, ahead of the hashed words.
SHAPES = 16
GRADES = 3
#: Labelled documents that the fit reads at most.
FIT_ROWS = 12_000
#: Words get a weight if at least so many fitted documents hold them, however many others do or do not,
LEAST_DOCUMENTS = 5
#: and if they are held by more documents below a grade than chance explains, by so many standard deviations.
LEAST_DEVIATIONS = 3.0
#: Share of the fitted documents of the top grade that the selection may lose. The penalty draws all probabilities together,
#: the more the fewer rows there are, so the limit is set on them and not at a fixed probability.
SPARED = 0.005


def grade(quality: Column, toxic: Column) -> Column:
    """0 low quality, 1 acceptable but toxic, 2 good; null if a rating is missing."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def _shapes(data: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shares of words of each text that repeat the word before, end in symbols, hold capitals or bars, and so on."""
    n = np.maximum(np.diff(bounds), 1).astype(float)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds]) / n

    end = data[last - 1] if len(last) else np.empty(0, np.uint8)
    one_before = data[np.maximum(last - 2, 0)] if len(last) else end
    start = data[first] if len(first) else end
    same = np.concatenate(([False], values[1:] == values[:-1])) if len(values) else np.empty(0, bool)
    symbols = np.isin(end, np.frombuffer(b"#*$%&|<>!", np.uint8))
    upper = lambda x: (x >= 65) & (x <= 90)
    out = [
        share(same), share(symbols), share(symbols & (one_before == end)), share(upper(start) & upper(one_before)),
        share(end == ord("|")), share(np.isin(end, np.frombuffer(b".,;:?", np.uint8))), share(last - first > 20),
        share(last - first == 1), (n < 20).astype(float), (n < 50).astype(float),
    ]
    return np.array(out)


def _beginnings(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the first four and five bytes of each word, in lower case."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    number, out = np.zeros(len(first), np.uint64), []
    for k in range(5):
        inside = first + k < last
        number = number << np.uint64(8) | np.where(inside, low[np.minimum(first + k, len(low) - 1)], 0).astype(np.uint64)
        if k >= 3:
            out.append(words.mix(number * np.uint64(8) + np.uint64(k)))
    return np.stack(out, axis=1)


def features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: places, weights, bounds of each text. Each distinct word of a text counts once."""
    texts = part.column("text")
    data, begins = words.bytes_of(texts)
    first, last, bounds = words.places(data, begins)
    values, _ = words.hashed(texts, lower=True)
    shapes = _shapes(data, first, last, values, bounds)
    both = np.concatenate((values[:, None], _beginnings(data, first, last)), axis=1) % np.uint64(BUCKETS - SHAPES)
    at, weight, ends = [], [], [0]
    for k in range(part.num_rows):
        own = np.unique(both[bounds[k] : bounds[k + 1]]).astype(np.int64) + SHAPES
        at += [np.arange(len(shapes)), own]
        weight += [4 * shapes[:, k], np.ones(len(own))]
        ends.append(ends[-1] + len(shapes) + len(own))
    empty = np.empty(0)
    return np.concatenate(at or [empty.astype(np.int64)]), np.concatenate(weight or [empty]), np.array(ends, np.int64)


def _feature_rows(batches):
    for part in words.slices(batches):
        at, weight, bounds = features(part)
        hashed = at >= SHAPES
        shapes = weight[~hashed].astype(np.float32)
        kinds = len(shapes) // max(part.num_rows, 1)
        own = np.concatenate(([0], np.cumsum(hashed)))[bounds]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("grade"),
                words.list_array(shapes, np.arange(part.num_rows + 1) * kinds),
                words.list_array(at[hashed].astype(np.int32), own),
            ],
            ["grade", "shapes", "at"],
        )


@dataclass
class Model:
    """Weights by bucket and rising thresholds; its size is fixed."""

    weights: np.ndarray
    thresholds: np.ndarray
    #: Tail probability of the top grade from which on a document is selected.
    least: float = 0.5

    def score(self, at: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[at] * weight)))
        return total[bounds[1:]] - total[bounds[:-1]]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, one row per threshold."""
        return 1 / (1 + np.exp(-np.clip(score[None, :] - self.thresholds[:, None], -40, 40)))


def telling(grades: np.ndarray, hashed: list[pa.ListArray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose words speak against a text, and the number of documents with each.

    For each threshold the documents below it that hold the word are compared with the number that a draw without regard to
    the grade would give, so a word in most documents or in a handful counts by what it tells alone.
    """
    held = np.zeros((GRADES, BUCKETS))
    begin = 0
    for lists in hashed:
        own = np.repeat(grades[begin : begin + len(lists)], lists.value_lengths())
        held += np.bincount(own * BUCKETS + lists.flatten(), minlength=GRADES * BUCKETS).reshape(GRADES, BUCKETS)
        begin += len(lists)
    found, n = held.sum(axis=0), len(grades)
    deviation = np.zeros(BUCKETS)
    for k in range(1, GRADES):
        below = np.mean(grades < k)
        spread = np.sqrt(np.maximum(found * below * (1 - below) * (1 - found / n), 1e-9))
        deviation = np.maximum(deviation, (held[:k].sum(axis=0) - found * below) / spread)
    used = np.flatnonzero((found >= LEAST_DOCUMENTS) & (deviation >= LEAST_DEVIATIONS))
    return used, found[used]


def fit(grades: np.ndarray, shapes: np.ndarray, hashed: list[pa.ListArray], rounds: int = 150, noise: float = 0.6) -> Model:
    """Likelihood less an absolute penalty on the weights, by full-batch steps with a step size per weight.

    The penalty follows the noise that a gradient over this many rows has, so features that tell nothing keep no
    weight. Words only count against a text: else many ordinary ones outweigh a bad one in long texts. Rows are weighted
    so that each grade counts alike. The thresholds are a first one and positive gaps, so their order holds throughout.
    """
    used, found = telling(grades, hashed)
    kinds = shapes.shape[1]
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used)) + kinds
    # The shapes of every text, then its words that are used; the fit works on these alone.
    row, at = [np.repeat(np.arange(len(grades)), kinds)], [np.tile(np.arange(kinds), len(grades))]
    begin = 0
    for lists in hashed:
        mapped = place[lists.flatten().to_numpy()]
        row.append((np.repeat(np.arange(len(lists)), lists.value_lengths()) + begin)[mapped >= 0])
        at.append(mapped[mapped >= 0])
        begin += len(lists)
    row, at = np.concatenate(row), np.concatenate(at)
    weight = np.concatenate((shapes.ravel(), np.ones(len(row) - shapes.size)))
    n_used = kinds + len(used)
    counts = np.bincount(grades, minlength=GRADES)
    balance = (len(grades) / (GRADES * np.maximum(counts, 1)))[grades]
    balance = balance / balance.mean()
    # A gradient is a mean over all rows, of which only those that hold the word add noise.
    penalty = noise * np.sqrt(np.concatenate((np.ones(kinds), found / len(grades))) / len(grades))
    w, squares = np.zeros(n_used), np.full(n_used, 1e-8)
    raw = np.array([-4.0, 0.7])  # first threshold, log of the gap; a text without telling features is good
    raw_squares = np.full(2, 1e-8)
    for _ in range(rounds):
        model = Model(w, np.array([raw[0], raw[0] + np.exp(raw[1])]))
        tail = model.tails(np.bincount(row, weights=w[at] * weight, minlength=len(grades)))
        upper = np.concatenate((np.ones((1, len(grades))), tail, np.zeros((1, len(grades)))))
        rows = np.arange(len(grades))
        chance = np.maximum(upper[grades, rows] - upper[grades + 1, rows], 1e-9)
        slope = upper * (1 - upper)
        lower_slope, upper_slope = slope[grades, rows], slope[grades + 1, rows]
        by_score = balance * (lower_slope - upper_slope) / chance
        gradient = np.bincount(at, weights=by_score[row] * weight, minlength=n_used) / len(grades)
        squares += gradient**2
        step = 0.25 / np.sqrt(squares)
        w = w + step * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        w[kinds:] = np.minimum(w[kinds:], 0)
        by_low = np.where(grades >= 1, -lower_slope, 0) * (grades == 1) + np.where(grades == 0, upper_slope, 0)
        by_high = np.where(grades == 2, -lower_slope, 0) + np.where(grades == 1, upper_slope, 0)
        low, high = (balance * by_low / chance).mean(), (balance * by_high / chance).mean()
        raw_gradient = np.array([low + high, high * np.exp(raw[1])])
        raw_squares += raw_gradient**2
        raw = raw + 0.5 * raw_gradient / np.sqrt(raw_squares)
    weights = np.zeros(BUCKETS)
    weights[:kinds], weights[used] = w[:kinds], w[kinds:]
    thresholds = np.array([raw[0], raw[0] + np.exp(raw[1])])
    score = np.bincount(row, weights=w[at] * weight, minlength=len(grades))
    good = Model(weights, thresholds).tails(score)[-1][grades == GRADES - 1]
    return Model(weights, thresholds, float(np.quantile(good, SPARED)) - 1e-6 if len(good) else 0.5)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Fit on at most ``fit_rows`` rated documents; None if no rating can be used.

    The driver gets their features, about 4 KB a document, and keeps those that tell a grade.
    """
    rated = labels.select(F.col("doc_id").cast("long"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = rated.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = texts.join(F.broadcast(sample), "doc_id").select("grade", "text")  # at most ``fit_rows`` rows of 12 bytes
    rows = chosen.mapInArrow(_feature_rows, "grade int, shapes array<float>, at array<int>").toArrow()
    if not rows.num_rows:
        return None
    shapes = np.concatenate([c.flatten().to_numpy() for c in rows.column("shapes").chunks]).astype(float)
    grades = rows.column("grade").to_numpy().astype(np.int64)
    return fit(grades, shapes.reshape(len(grades), -1), rows.column("at").chunks)


def _scorer(model: Model):
    small = Model(model.weights, model.thresholds)

    def run(batches):
        for part in words.slices(batches):
            tail = small.tails(small.score(*features(part)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(tail.sum(axis=0)), pa.array(tail[-1])],
                ["doc_id", "expected_grade", "p_good"],
            )

    return run


def graded(docs: DataFrame, model: Model | None) -> DataFrame:
    """Score every document: ``doc_id, expected_grade, p_good, kept``; ``p_good`` is the probability of the top grade
    and ``kept`` whether it reaches the limit of the model."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        null = F.lit(None).cast("double")
        return docs.select("doc_id", null.alias("expected_grade"), null.alias("p_good"), F.lit(True).alias("kept"))
    scored = docs.mapInArrow(_scorer(model), "doc_id long, expected_grade double, p_good double")
    return scored.withColumn("kept", F.col("p_good") >= model.least)
