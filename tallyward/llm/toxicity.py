"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: word beginnings of 3 to 10 bytes and whole words, in lower case and without punctuation at the ends,
that are told apart by the labels. An entry's strength is the log-likelihood ratio of its document counts; it has to
exceed what the best of as many entries reaches by chance. A row that is fitted is looked up in a lexicon learned from the other
folds, so that the trees see what an entry found in other documents is worth. Entries are 64-bit hashes with a weight, the log of
their odds in toxic against other documents.

Features of a text, all shares or logs of counts: lexicon words (all, and those never seen in clean documents), their
weights, distinct ones, the most within ``WINDOW`` words; second-person words, and lexicon words with one at most
``NEAR`` words away; capitals; punctuation marks, shouts and repeated marks; obfuscation: words that are in the lexicon only after digits and
signs are read as letters, words that mix letters with digits or signs, single letters, tripled letters; length.

Trees are fitted to the logistic loss on features cut into ``BINS`` quantile bins, leaves by Newton steps. Their margins are
calibrated by isotonic regression (pool adjacent violators) on held-out folds: each of ``FOLDS`` parts of the fitted rows is
scored by trees grown on the others; between the means of neighbouring blocks the score is interpolated.

Scale: the fit takes at most ``fit_rows`` labelled documents, those with the smallest hashes of their ids, however the table is
dealt. Their words are counted in the tasks and only entries found in five documents reach the next step; the driver gets
the lexicon (at most ``LEXICON`` entries, the strongest) and about 100 bytes of features per fitted row. The model has a
fixed size. Scoring reads every document once and moves nothing.

Learned from: rated rows whose crc32 of the id (as text) is not 1 modulo 3. No other column than the text is ever a feature.

Defined results: null and empty texts have all features zero and are scored as such. Rows without an id are scored, never
learned from and not held out. A document rated more than once is toxic if any rating says so; ratings that are null or not
0 or 1 are left out. Rows that share an id are each scored, and each learned from if rated; exact copies
with the same rating are learned from once. Without ratings of both kinds the score is the share of
toxic ratings (0 without any). Texts are read whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm import words
from tallyward.llm.staging import Shelf
from tallyward.llm.staging import shelf as shelf_of

#: Labelled documents that the fit reads at most, and entries of the lexicon.
FIT_ROWS, LEXICON = 20_000, 4096
#: Documents of the fit that hold an entry at least.
LEAST_DOCUMENTS = 5
#: Lengths of word beginnings in bytes.
BEGINNINGS = range(3, 11)
WINDOW, NEAR = 30, 5
BINS, TREES, DEPTH, RATE, FOLDS = 64, 60, 3, 0.2, 4
LEAST_LEAF = 4.0
#: Score from which on a document is predicted toxic.
LIMIT = 0.7

#: Words that address someone, in the languages of the corpus.
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deiner deinem deinen ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestro vuestra"
).split()
#: Digits and signs that stand for letters.
LETTERS_OF = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
READ = LOW.copy()
for _sign, _letter in LETTERS_OF.items():
    READ[ord(_sign)] = ord(_letter)
LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
MARK = np.isin(np.arange(256), np.frombuffer(b".,;:?!", np.uint8))
UPPER = np.array([65 <= b <= 90 for b in range(256)])

FEATURES = [
    "lexicon", "telling", "weight", "most_weight", "distinct", "window", "folded", "mixed", "single", "tripled", "second", "near_second",
    "capitals", "shouted", "marks", "shouts", "repeated_marks", "signs", "digits", "length", "hits",
]


@dataclass
class Lexicon:
    """Sorted hashes with their weights; ``telling`` marks those never seen in clean documents."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    telling: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    def __post_init__(self) -> None:
        #: A bit per low 16 bits of a hash, so that most words are not looked up.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.keys & np.uint64(0xFFFF)] = True

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1."""
        out = np.full(len(hashed), -1, np.int64)
        at = np.flatnonzero(self.maybe[hashed & np.uint64(0xFFFF)])
        if len(at) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, hashed[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == hashed[at], place, -1)
        return out


class Text:
    """The words of many texts as byte places, without punctuation at their ends."""

    def __init__(self, texts: pa.Array):
        self.data, self.begins = words.bytes_of(texts)
        first, last, self.bounds = words.places(self.data, self.begins)
        letter = LETTER[self.data] | DIGIT[self.data]
        # The nearest letter or digit after and before every byte.
        at = np.arange(len(self.data))
        after = np.minimum.accumulate(np.where(letter, at, len(at))[::-1])[::-1] if len(at) else at
        before = np.maximum.accumulate(np.where(letter, at, -1)) if len(at) else at
        self.whole = first, last
        self.first = np.minimum(after[first], last) if len(first) else first
        self.last = np.maximum(before[last - 1] + 1, self.first) if len(last) else last

    def hashes(self, reading: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Hashes of the beginnings and the whole of some words; 0 where a word has no such beginning."""
        value = words.VALUES[reading[self.data]] * words._powers(len(self.data))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        begin, end = first[rows], last[rows]
        scale = words._inverses(len(self.data) + 1)[begin]
        out = []
        for n in [*BEGINNINGS, 0]:
            stop = np.minimum(begin + n, end) if n else end
            key = words.mix((total[stop] - total[begin]) * scale + (stop - begin).astype(np.uint64) * np.uint64(2) + np.uint64(n == 0))
            out.append(np.where(end - begin >= max(n, 2), key, np.uint64(0)))
        return out


def _hash_of(word: str) -> np.uint64:
    text = Text(pa.array([word]))
    return text.hashes(LOW, np.array([0]), text.first, text.last)[-1][0]


def _counts(batches):
    """Entries of each slice of rated documents, with the numbers of toxic and of all documents of a fold that hold them."""
    for part in words.slices(batches):
        text = Text(part.column("text"))
        toxic, fold = (part.column(c).to_numpy().astype(np.int64) for c in ("toxic", "fold"))
        rows = np.arange(len(text.first))
        doc = np.repeat(np.arange(part.num_rows), np.diff(text.bounds))
        keys, docs = np.concatenate(text.hashes(LOW, rows, text.first, text.last)), np.tile(doc, len(BEGINNINGS) + 1)
        keys, docs = keys[keys != 0], docs[keys != 0]
        order = np.lexsort((docs, fold[docs], keys))
        keys, docs = keys[order], docs[order]
        change = lambda *x: np.concatenate(([True], np.any([y[1:] != y[:-1] for y in x], axis=0)))[: len(x[0])]
        new = change(keys, docs)
        keys, docs = keys[new], docs[new]
        starts = np.flatnonzero(change(keys, fold[docs]))
        n = np.diff(np.concatenate((starts, [len(keys)])))
        n_toxic = np.add.reduceat(toxic[docs], starts) if len(starts) else n
        columns = [pa.array(keys[starts].view(np.int64)), pa.array(fold[docs[starts]]), pa.array(n_toxic), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "fold", "n_toxic", "n"])


def learn_lexicons(rated: DataFrame, toxic: np.ndarray, rows: np.ndarray, shelf: Shelf) -> list[Lexicon]:
    """The strongest entries of rated documents ``text, toxic, fold``: from all but each fold, and last from all.

    ``toxic`` and ``rows`` are the numbers of toxic and of all documents of each fold.
    """
    counted = rated.select("text", "toxic", "fold").mapInArrow(_counts, "key long, fold long, n_toxic long, n long")
    of = lambda c, k: F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    counted = counted.groupBy("key").agg(*[of(c, k) for c in ("n_toxic", "n") for k in range(FOLDS)], F.sum("n").alias("n"))
    counted = shelf.put(counted.where(F.col("n") >= LEAST_DOCUMENTS), "entries")
    # The largest of so many ratios is about twice the log of their number by chance; what speaks for clean texts is of no use.
    chance = 2 * math.log(max(counted.count(), 1)) + 4

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    out = []
    for left_out in range(FOLDS + 1):
        own = [k for k in range(FOLDS) if k != left_out]
        n_toxic, n_all = int(toxic[own].sum()), int(rows[own].sum())
        if n_toxic in (0, n_all):
            out.append(Lexicon())
            continue
        rate = n_toxic / n_all
        a = sum((F.col(f"n_toxic{k}") for k in own), F.lit(0))
        n = sum((F.col(f"n{k}") for k in own), F.lit(0))
        b, rest = n - a, F.lit(n_all) - n
        ratio = 2 * (term(a, n * rate) + term(b, n * (1 - rate)) + term(n_toxic - a, rest * rate) + term(n_all - n_toxic - b, rest * (1 - rate)))
        odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_all - n_toxic + 1))
        strong = counted.where(n >= LEAST_DOCUMENTS).select("key", ratio.alias("ratio"), odds.alias("weight"), (b == 0).alias("telling"))
        strong = strong.where((F.col("ratio") > chance) & (F.col("weight") > 1))
        found = strong.orderBy(F.desc("ratio"), "key").limit(LEXICON).select("key", "weight", "telling").toArrow()
        keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        out.append(Lexicon(keys[order], found.column("weight").to_numpy()[order], found.column("telling").to_numpy().astype(bool)[order]))
    return out


def features(texts: pa.Array, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    text = Text(texts)
    data, bounds, (first, last) = text.data, text.bounds, text.whole
    n_words, doc = np.diff(bounds), np.repeat(np.arange(len(texts)), np.diff(bounds))
    size = np.diff(text.begins) - 1

    def per_word(flags: np.ndarray) -> np.ndarray:
        """How many bytes with the flag each word holds."""
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[last] - total[first]

    def summed(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])

    letters, digits, signs = per_word(LETTER[data]), per_word(DIGIT[data]), per_word(SIGN[data])
    inner_signs = np.maximum(signs - (text.first - first) - (last - text.last), 0)
    mixed = (letters > 0) & ((digits > 0) | (inner_signs > 0))
    weight, telling, entry = np.zeros(len(first)), np.zeros(len(first), bool), np.full(len(first), -1)

    def look(hashed: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rows), bool)
        for keys in hashed:
            place = lexicon.find(keys)
            at = np.flatnonzero(place >= 0)
            stronger = at[lexicon.weights[place[at]] > weight[rows[at]]]
            weight[rows[stronger]], entry[rows[stronger]] = lexicon.weights[place[stronger]], place[stronger]
            telling[rows[at]] |= lexicon.telling[place[at]]
            hit[at] = True
        return hit

    every = np.arange(len(first))
    plain = text.hashes(LOW, every, text.first, text.last)
    hit = look(plain, every)
    # Words of letters and signs are read again with the signs as letters, their ends included.
    odd = np.flatnonzero(~hit & (letters > 0) & ((digits > 0) | (signs > 0)))
    folded = np.zeros(len(first), bool)
    if len(odd):
        folded[odd] = look(text.hashes(READ, odd, text.first, text.last), odd)
        hit |= folded
    is_second = np.isin(plain[-1], second)
    total = np.concatenate(([0], np.cumsum(is_second)))
    lo, hi = np.maximum(every - NEAR, bounds[doc]), np.minimum(every + NEAR + 1, bounds[doc + 1])
    near = hit & (total[hi] > total[lo]) if len(every) else hit
    total = np.concatenate(([0], np.cumsum(hit)))
    in_window = total[np.minimum(every + WINDOW, bounds[doc + 1])] - total[every] if len(every) else every
    most = np.zeros((2, len(texts)))
    np.maximum.at(most[0], doc, in_window)
    np.maximum.at(most[1], doc, weight)
    pairs = np.unique(np.stack((doc[hit], entry[hit])), axis=1)[0] if hit.any() else np.empty(0, np.int64)
    distinct = np.bincount(pairs, minlength=len(texts))
    length = text.last - text.first
    tripled = np.concatenate((data[2:] == data[1:-1], [False, False])) & np.concatenate((data[1:] == data[:-1], [False])) & LETTER[data] if len(data) > 2 else np.zeros(len(data), bool)
    by_text = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[text.begins])
    mark = MARK[data]
    doubled = np.concatenate((mark[1:] & mark[:-1], [False])) if len(data) else mark
    n, b = np.maximum(n_words, 1), np.maximum(size, 1)
    return np.column_stack([
        summed(hit) / n, summed(telling) / n, summed(weight) / n, most[1], np.log1p(distinct), most[0], summed(folded) / n, summed(mixed) / n,
        summed((length == 1) & (letters == 1)) / n, summed(per_word(tripled) > 0) / n, summed(is_second) / n, summed(near) / n,
        by_text(UPPER[data]) / b, summed((per_word(UPPER[data]) == letters) & (letters > 2)) / n, by_text(mark) / b,
        by_text((data == 33) | (data == 63)) / b, by_text(doubled) / b, by_text(SIGN[data] & ~mark) / b, by_text(DIGIT[data]) / b,
        np.log1p(n_words), np.log1p(summed(hit)),
    ]).astype(np.float32)


@dataclass
class Tree:
    """A full tree of ``DEPTH`` levels: feature and bin limit per inner node, value per leaf."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[rows, self.feature[node]] > self.limit[node])
        return node - (2**DEPTH - 1)


def grow(binned: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> Tree:
    """One tree on first and second derivatives of the loss; a node without a useful cut sends all rows left."""
    inner, n_features = 2**DEPTH - 1, binned.shape[1]
    feature, limit = np.zeros(inner, np.int64), np.full(inner, BINS)
    node = np.zeros(len(binned), np.int64)
    columns = np.arange(n_features) * BINS
    for level in range(DEPTH):
        begin, n = 2**level - 1, 2**level
        flat = ((node - begin)[:, None] * (n_features * BINS) + columns + binned).ravel()
        shape = (n, n_features, BINS)
        g = np.bincount(flat, weights=np.repeat(slope, n_features), minlength=n * n_features * BINS).reshape(shape).cumsum(axis=2)
        h = np.bincount(flat, weights=np.repeat(curve, n_features), minlength=n * n_features * BINS).reshape(shape).cumsum(axis=2)
        all_g, all_h = g[:, :, -1:], h[:, :, -1:]
        gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
        gain[(h < LEAST_LEAF / 4) | (all_h - h < LEAST_LEAF / 4)] = 0
        best = gain.reshape(n, -1).argmax(axis=1)
        useful = gain.reshape(n, -1).max(axis=1) > 1e-9
        feature[begin : begin + n] = np.where(useful, best // BINS, 0)
        limit[begin : begin + n] = np.where(useful, best % BINS, BINS)
        rows = np.arange(len(binned))
        node = 2 * node + 1 + (binned[rows, feature[node]] > limit[node])
    at = node - inner
    g, h = np.bincount(at, weights=slope, minlength=inner + 1), np.bincount(at, weights=curve, minlength=inner + 1)
    return Tree(feature, limit, RATE * g / (h + 1))


def boost(binned: np.ndarray, toxic: np.ndarray) -> tuple[float, list[Tree]]:
    rate = np.clip(toxic.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(rate / (1 - rate)))
    margin, trees = np.full(len(toxic), start), []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        tree = grow(binned, toxic - chance, np.maximum(chance * (1 - chance), 1e-6))
        margin += tree.leaf[tree.leaves(binned)]
        trees.append(tree)
    return start, trees


def margins(start: float, trees: list[Tree], binned: np.ndarray) -> np.ndarray:
    out = np.full(len(binned), start)
    for tree in trees:
        out += tree.leaf[tree.leaves(binned)]
    return out


def isotonic(margin: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean margin and share of each pooled block, rising. Equal margins fall into one block."""
    at, where = np.unique(margin, return_inverse=True)
    n, hits = np.bincount(where).astype(float), np.bincount(where, weights=toxic)
    blocks: list[list[float]] = []
    for x, k, y in zip(at, n, hits, strict=True):
        blocks.append([x * k, k, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]
    at: np.ndarray
    share: np.ndarray

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, rows[:, k], side="left") for k, e in enumerate(self.edges)]) if len(rows) else np.empty((0, len(self.edges)), np.int64)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(margins(self.start, self.trees, self.binned(rows)), self.at, self.share)


def fit(rows: np.ndarray, toxic: np.ndarray, fold: np.ndarray, lexicon: Lexicon) -> Model:
    """Bins, trees and calibration on rows of features."""
    edges = [np.unique(np.quantile(rows[:, k], np.arange(1, BINS) / BINS, method="lower")) for k in range(rows.shape[1])]
    # Features that are zero for most rows get their bins from the others.
    for k in range(rows.shape[1]):
        if len(edges[k]) < BINS // 4:
            rest = rows[rows[:, k] > edges[k][-1], k]
            if len(rest):
                edges[k] = np.unique(np.concatenate((edges[k], np.quantile(rest, np.arange(BINS // 2) / (BINS // 2), method="lower"))))[: BINS - 1]
    model = Model(lexicon, edges, 0.0, [], np.zeros(1), np.zeros(1))
    binned = model.binned(rows)
    out = np.zeros(len(rows))
    for k in range(FOLDS):
        test = fold % FOLDS == k
        if test.any() and not test.all():
            out[test] = margins(*boost(binned[~test], toxic[~test]), binned[test])
    model.at, model.share = isotonic(out, toxic)
    model.start, model.trees = boost(binned, toxic)
    return model


def _second() -> np.ndarray:
    return np.array([_hash_of(w) for w in SECOND_PERSON], np.uint64)


def _feature_rows(lexicons: list[Lexicon]):
    def run(batches):
        second = _second()
        for part in words.slices(batches):
            fold = part.column("fold").to_numpy()
            for k in np.unique(fold).tolist():
                own = part.filter(pa.array(fold == k))
                rows = features(own.column("text"), lexicons[k], second)
                lists = words.list_array(rows.ravel(), np.arange(len(rows) + 1) * rows.shape[1])
                yield pa.RecordBatch.from_arrays([own.column("toxic"), own.column("fold"), lists], ["toxic", "fold", "features"])

    return run


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | float:
    """Fit on at most ``fit_rows`` rated documents outside the held-out third; the share of toxic ratings if they are all alike."""
    rated = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")
    rated = rated.where(remainder(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # of 12 bytes each
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = texts.join(F.broadcast(sample), "doc_id")
    # Copies say no more than one of them.
    chosen = chosen.groupBy(F.xxhash64("text").alias("copy"), "toxic").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    chosen = chosen.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))
    with shelf_of(docs.sparkSession) as shelf:
        chosen = shelf.put(chosen, "rated")
        n, n_toxic = np.zeros(FOLDS, np.int64), np.zeros(FOLDS, np.int64)
        for r in chosen.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect():
            n[r["fold"]], n_toxic[r["fold"]] = r["n"], r["toxic"]
        if n_toxic.sum() in (0, n.sum()):
            return float(n_toxic.sum() / n.sum()) if n.sum() else 0.0
        lexicons = learn_lexicons(chosen, n_toxic, n, shelf)
        table = chosen.mapInArrow(_feature_rows(lexicons), "toxic int, fold int, features array<float>").toArrow()
    rows = np.concatenate([c.flatten().to_numpy() for c in table.column("features").chunks]).reshape(table.num_rows, -1)
    toxic, fold = table.column("toxic").to_numpy(), table.column("fold").to_numpy()
    order = np.lexsort((*rows.T, fold, toxic))  # the same sums however the rows came
    return fit(rows[order], toxic[order].astype(float), fold[order], lexicons[-1])


def _scores(model: Model):
    def run(batches):
        second = _second()
        for part in words.slices(batches):
            score = model.score(features(part.column("text"), model.lexicon, second))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model | float) -> DataFrame:
    """Every document with its score: ``doc_id, held_out, score, predicted``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.select("doc_id", F.lit(model).alias("score")) if isinstance(model, float) else docs.mapInArrow(_scores(model), "doc_id long, score double")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
