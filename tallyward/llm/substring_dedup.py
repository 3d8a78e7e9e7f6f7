"""Repeated passages by relative parsing: every document is factored against all earlier text.

The reference is the whole corpus, indexed by the hashes of its windows of ``width`` words: each window points to
the first document that holds it. A document is parsed greedily into the longest factors that run on inside one
earlier document; where one factor ends, the windows that cross its end are looked up too, so a factor found there
goes on with the words the last one left. Factors have at least ``width`` words and are the duplicate spans.

To index every window would move several times the corpus. Three steps avoid it without losing a window:

* Documents with the same words throughout are one; all but the first are a single factor.
* Equal windows hold an equal anchor: the run of ``ANCHOR`` words with the smallest hash. Only anchors are first
  counted, about one for six words, and only windows over an anchor that occurs twice are looked up.
* What a task has seen itself is combined there: an anchor or a window that many documents share leaves a task once.

Defined results: null text has no words. Rows with a null id keep all words and are no reference. Rows that share
an id are not earlier than each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm import words
from tallyward.llm.staging import Shelf, keep

#: Words of an anchor.
ANCHOR = 8
#: Windows or anchors gathered in a task before they are combined and sent on.
GATHER = 2_000_000


def anchors(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all short runs, which of them are anchors of some window, and the bounds of each text.

    A window's anchors are its runs with the smallest hash, so equal windows have equal anchors.
    """
    size = min(ANCHOR, width)
    span = width - size + 1
    grams, own = words.runs(values, bounds, size)
    chosen = np.zeros(len(grams), bool)
    n = len(grams) - span + 1
    if n > 0:
        least = grams[:n].copy()
        for k in range(1, span):
            np.minimum(least, grams[k : n + k], out=least)
        in_one = np.arange(n) + span <= np.repeat(own[1:], np.diff(own))[:n]
        for k in range(span):
            chosen[k : n + k] |= (grams[k : n + k] == least) & in_one
    return grams, chosen, own


def _sketcher(batches):
    for part in words.slices(batches):
        texts = [t.split() for t in part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
        joined = [b" ".join(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([xxhash.xxh3_128_digest(t) for t in joined], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in joined]),
            ],
            ["doc_id", "key", "n_words", "sha"],
        )


def _rows_of(values: list[np.ndarray], docs: list[np.ndarray], local: bool):
    """Combined rows of one task: each value once with its smallest document, or the values seen in more places."""
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((doc, value))
    value, doc = value[order], doc[order]
    first = np.concatenate(([True], value[1:] != value[:-1]))
    times = np.diff(np.append(np.flatnonzero(first), len(value)))
    lead = np.repeat(doc[first], times)
    pick = np.repeat(times, times) > 1 if local else first
    return value[pick], doc[pick], lead[pick], np.repeat(times, times)[pick]


def _gather(found, local: bool, names: list[str]):
    """Pass on what ``found`` yields as (values, documents), combined as far as memory is set aside for it."""
    values, docs, held = [], [], 0

    def flush():
        value, doc, lead, times = _rows_of(values, docs, local)
        columns = {"value": value.view(np.int64), "doc": doc, "lead": lead, "times": times.astype(np.int32)}
        table = pa.table({k: columns[k] for k in names})
        yield from table.to_batches(max_chunksize=100_000)

    for value, doc in found:
        values.append(value)
        docs.append(doc)
        held += len(value)
        if held >= GATHER:
            yield from flush()
            values, docs, held = [], [], 0
    if held:
        yield from flush()


def _anchor_rows(width: int, local: bool):
    def found(batches):
        for part in words.slices(batches):
            values, bounds = words.hashed(part.column("text"), lower=False)
            grams, chosen, own = anchors(values, bounds, width)
            ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), np.diff(own))
            yield grams[chosen], ids[chosen]

    return lambda batches: _gather(found(batches), local, ["value", "doc"] if local else ["value", "doc", "times"])


def _open_windows(values: np.ndarray, bounds: np.ndarray, repeated: np.ndarray, width: int) -> tuple:
    """Hashes of all windows of one text and which of them hold an anchor that occurs elsewhere."""
    grams, chosen, _ = anchors(values, bounds, width)
    windows, _ = words.runs(values, bounds, width)
    span = width - min(ANCHOR, width) + 1
    marked = chosen & np.isin(grams, repeated)
    seen = np.concatenate(([0], np.cumsum(marked)))
    return windows, seen[span : len(windows) + span] > seen[: len(windows)]


def _each_text(batches, list_column: str):
    """Row number, word hashes, bounds and the hash list of each text."""
    for part in words.slices(batches):
        values, bounds = words.hashed(part.column("text"), lower=False)
        lists = part.column(list_column)
        for k in range(part.num_rows):
            own = values[bounds[k] : bounds[k + 1]]
            yield part, k, own, np.array([0, len(own)]), lists[k].values


def _window_rows(width: int, local: bool):
    def found(batches):
        for part, k, own, bounds, repeated in _each_text(batches, "repeated"):
            windows, is_open = _open_windows(own, bounds, repeated.to_numpy().view(np.uint64), width)
            hashes = np.unique(windows[is_open])
            yield hashes, np.full(len(hashes), part.column("doc_id")[k].as_py(), np.int64)

    return lambda batches: _gather(found(batches), local, ["value", "doc", "lead"] if local else ["value", "doc"])


def parse(windows: np.ndarray, earlier: dict[int, int], doc: int, width: int) -> list[tuple[int, int, int]]:
    """Greedy factors (start, length, earlier document) of one text from its window hashes.

    ``earlier`` gives the first document of each window that another one holds before. A window that the text
    itself repeats refers to the text.
    """
    seen: set[int] = set()
    source = []
    for w in windows.tolist():
        source.append(earlier.get(w, doc if w in seen else None))
        seen.add(w)
    factors, done, k, n = [], 0, 0, len(source)
    while k < n:
        if source[k] is None:
            k += 1
            continue
        end = k
        while end + 1 < n and source[end + 1] == source[k]:
            end += 1
        start = max(k, done)  # the words before belong to the factor that ended here
        factors.append((start, end + width - start, source[k]))
        done, k = end + width, end + 1
    return factors


def _parser(width: int):
    def run(batches):
        for part in words.slices(batches):
            values, bounds = words.hashed(part.column("text"), lower=False)
            texts = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            columns = [part.column("doc_id"), [], [], [], []]
            for k, text in enumerate(texts):
                doc, tokens = columns[0][k].as_py(), text.split()
                windows, _ = words.runs(values[bounds[k] : bounds[k + 1]], np.array([0, len(tokens)]), width)
                found = part.column("found")[k].as_py() or []
                factors = parse(windows, {x["value"] % (1 << 64): x["lead"] for x in found}, doc, width)
                kept, at = [], 0
                for start, length, _ in factors:
                    kept += tokens[at:start]
                    at = start + length
                kept += tokens[at:]
                columns[1].append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                columns[2].append(len(tokens) - len(kept))
                columns[3].append([{"start": a, "length": b, "earlier": c} for a, b, c in factors])
                columns[4].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            factor = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("earlier", pa.int64())])
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(factor), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [columns[0].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns[1:], kinds[1:], strict=True))],
                ["head", "key", "n_removed", "factors", "kept_sha256"],
            )

    return run


def repeated_spans(docs: DataFrame, width: int = 20) -> DataFrame:
    """Words of each document that lie in a window of ``width`` words which also starts earlier in the corpus.

    Earlier: in a document with a smaller id, or in the same one before. Takes ``doc_id, text``; returns ``doc_id,
    n_words, n_removed, factors, kept_sha256`` per input row; ``factors`` are disjoint spans of words in order, each
    with the document it repeats, and the hash is of the kept words joined by one space.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = docs.where("doc_id is not null")
    sketch = shelf.put(docs.mapInArrow(_sketcher, "doc_id long, key binary, n_words long, sha string"), "sketch")
    heads = sketch.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("head"))
    heads = shelf.put(heads, "heads")

    # Anchors: copies of a document are still all there; they only make more windows candidates. A window over
    # one value has at most one row per task and gathering.
    each = Window.partitionBy("value")
    asked = named.mapInArrow(_anchor_rows(width, False), "value long, doc long, times int")
    shared = asked.withColumn("n", F.sum("times").over(each)).where("n > 1").select("value", "doc")
    known = named.mapInArrow(_anchor_rows(width, True), "value long, doc long")
    repeated = shared.union(known).join(heads.select(F.col("head").alias("doc")).distinct(), "doc", "left_semi")
    repeated = repeated.groupBy("doc").agg(F.collect_set("value").alias("repeated")).withColumnRenamed("doc", "doc_id")
    open_docs = shelf.put(named.join(repeated, "doc_id"), "open")

    asked = open_docs.mapInArrow(_window_rows(width, False), "value long, doc long")
    later = asked.withColumn("lead", F.min("doc").over(each)).where("lead < doc")
    known = open_docs.mapInArrow(_window_rows(width, True), "value long, doc long, lead long")
    later = later.union(known.where("lead < doc"))
    found = later.groupBy("doc", "value").agg(F.min("lead").alias("lead"))
    found = found.groupBy("doc").agg(F.collect_list(F.struct("value", "lead")).alias("found"))
    factor = "array<struct<start: long, length: long, earlier: long>>"
    parsed = open_docs.select("doc_id", "text").join(found.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    parsed = parsed.mapInArrow(
        _parser(width), f"head long, key binary, n_removed long, factors {factor}, kept_sha256 string"
    )
    parsed = parsed.where("n_removed > 0").dropDuplicates(["head", "key"])

    rows = sketch.join(heads, "key", "left").join(parsed, ["key", "head"], "left")
    copy = (F.col("doc_id") > F.col("head")) & (F.col("n_words") >= width)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"),
                             F.col("head").alias("earlier")))
    own = F.col("doc_id") == F.col("head")
    result = keep(
        rows.select(
            "doc_id", "n_words",
            F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).alias("n_removed"),
            F.when(copy, whole).when(own, F.coalesce("factors", F.array().cast(factor)))
            .otherwise(F.array().cast(factor)).alias("factors"),
            F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(own, F.coalesce("kept_sha256", "sha"))
            .otherwise(F.col("sha")).alias("kept_sha256"),
        ),
        "repeated_spans",
    )
    shelf.drop()
    return result
