"""Spelling variants: words one edit apart, found by dense comparison of prefixes and suffixes, and their commonest forms.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z in lower case. Let h be the crc32 of ``<doc_id>:<run>``; if 97 divides
it, the run loses its code point h % length. Words are the distinct results of at least ``LEAST_LENGTH`` code points with at
least ``LEAST_COUNT`` occurrences. Two words are near if one inserted, deleted or replaced code point turns one into the other.
A word's form is its near word of largest count (ties: smallest in code-point order) if that count is at least
``TIMES`` its own; its root is the end of the chain of forms.

Method: words stand as rows of padded code-point matrices. Two blocks of rows are compared densely, all rows against all
rows: column by column from the left gives the length of the common prefix, from the right that of the common suffix, and
two words are near exactly if both together reach the longer length less one.

Which rows meet in a block: the edit lies in one half of the shorter word, so the other half is the same in both words. Blocks
hold the words (of one length, and of that length plus one) that agree outside a window; the windows of a length are
disjoint, so a pair is found exactly once, in the window where its common prefix ends. A block with over ``BLOCK_ROWS`` rows or a
window over ``WIDEST`` is cut: its window is halved, and its rows go to the smaller blocks of both halves. So however
many words share a beginning, no block grows with the vocabulary: a window of one code point holds at most the alphabet
and its square. Nothing is capped or dropped.

Scale: occurrences are counted in the tasks that read the texts; only words move. Blocks are dealt by their key and worked
off in sorted order; each returns one row per word that has near words, not the pairs. Chains double their reach per round.

Defined results: null and empty texts have no words. Rows without an id count with an empty id. Repeated rows count each
time. Texts of any length are read whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm import words
from tallyward.llm.staging import Shelf, keep

LEAST_LENGTH, LEAST_COUNT, TIMES, DELETE_EACH = 5, 3, 2, 97
#: Rows of a block, and code points of its window, up to which it is compared as it is.
BLOCK_ROWS, WIDEST = 1024, 32
#: Rows of small blocks that are compared together, and cells of one comparison.
TILE_ROWS, CELLS = 192, 1 << 21

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
FULL = 0xFFFFFFFF
#: Bytes of text counted at once in a task.
SLICE = 2 << 20
#: Longest run (in bytes) whose checksum is advanced by table.
TABLED = 64


def _advances() -> np.ndarray:
    """``[length, byte of the state, its value]``: the state of the checksum after so many zero bytes, which is linear in it."""
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for length in range(TABLED + 1):
        zeros = bytes(length)
        # By linearity a byte's value is the exclusive or of its bits' values.
        for k in range(4):
            for bit in range(8):
                one = zlib.crc32(zeros, (1 << (8 * k + bit)) ^ FULL) ^ FULL
                out[length, k] ^= np.where(np.arange(256) >> bit & 1, one, 0).astype(np.uint32)
    return out


def _counted(batches):
    """Words and counts of each slice of texts. Runs are told apart by 64-bit hashes inside a slice."""
    advance = _advances()
    for part in words.slices(batches, most=SLICE):
        data, begins = words.bytes_of(part.column("text"))
        lead = data == 0xC3  # the letters from U+00C0 to U+00FF are this byte and one more
        inside = LETTER[data] | lead
        inside[1:] |= lead[:-1]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        if not len(first):
            continue
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        value = words.VALUES[low] * words._powers(len(data))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        size = last - first
        hashed = words.mix((total[last] - total[first]) * words._inverses(len(data))[first] + size.astype(np.uint64))
        _, at, which = np.unique(hashed, return_index=True, return_inverse=True)
        raw = low.tobytes()
        runs = [raw[a:b] for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)]
        # The checksum after the id and a colon, carried on over as many zeros, and that of the run from a zero state.
        ids = pc.fill_null(part.column("doc_id").cast(pa.string()), "").to_pylist()
        state = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32) ^ np.uint32(FULL)
        own = np.array([zlib.crc32(x, FULL) ^ FULL for x in runs], np.uint32)
        doc = np.searchsorted(begins, first, side="right") - 1
        length, seed, checksum = np.minimum(size, TABLED), state[doc], own[which] ^ np.uint32(FULL)
        for k in range(4):
            checksum ^= advance[length, k, seed >> np.uint32(8 * k) & np.uint32(255)]
        for i in np.flatnonzero(size > TABLED):
            checksum[i] = zlib.crc32(runs[which[i]], int(seed[i]) ^ FULL)
        changed = np.flatnonzero(checksum % np.uint32(DELETE_EACH) == 0)
        counts = np.bincount(which, minlength=len(runs)) - np.bincount(which[changed], minlength=len(runs))
        found: Counter[str] = Counter()
        for i, h in zip(which[changed].tolist(), checksum[changed].tolist(), strict=True):
            word = runs[i].decode()
            k = h % len(word)
            found[word[:k] + word[k + 1 :]] += 1
        for run, n in zip(runs, counts.tolist(), strict=True):
            if n and len(run) >= LEAST_LENGTH:
                found[run.decode()] += n
        listed = [(w, n) for w, n in found.items() if len(w) >= LEAST_LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in listed], pa.string()), pa.array([n for _, n in listed], pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = docs.where("text is not null").mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _ends(base: list[np.ndarray], other: list[np.ndarray], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefixes and suffixes of all rows of two column lists; the other's rows are longer by ``shift``."""
    shape = (len(base[0]), len(other[0]))
    out = []
    for step in (0, 1):
        alive, length = np.ones(shape, bool), np.zeros(shape, np.int8)
        for c in range(len(base)):
            mine, theirs = (base[c], other[c]) if step == 0 else (base[-1 - c], other[-1 - c])
            alive &= mine[:, None] == theirs[None, :]
            length += alive
        out.append(length)
    return out[0], out[1]


def _near_in(window: np.ndarray, longer: np.ndarray, block: np.ndarray, width: int, last_window: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tile that are near by their windows; rows of other blocks do not meet."""
    base, more = np.flatnonzero(~longer), np.flatnonzero(longer)
    one, two = [], []
    for others, shift in ((base, 0), (more, 1)):
        if not len(base) or not len(others):
            continue
        theirs = [window[others, c] for c in range(width + shift)]
        step = max(1, CELLS // len(others))
        for start in range(0, len(base), step):
            rows = base[start : start + step]
            prefix, suffix = _ends([window[rows, c] for c in range(width)], theirs, shift)
            # The longer length less one, inside the window.
            near = (prefix + suffix >= width + shift - 1) & (block[rows][:, None] == block[others][None, :])
            if shift:
                # An insertion counts where the common prefix ends; at the end of a window that is the next one.
                near &= (prefix < width) | last_window
            else:
                near &= rows[:, None] < others[None, :]
            i, j = np.nonzero(near)
            one.append(rows[i])
            two.append(others[j])
    none = np.empty(0, np.int64)
    return np.concatenate(one or [none]), np.concatenate(two or [none])


def _tiles(key: np.ndarray, kind: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of tiles: whole blocks of one kind of window, several small ones together."""
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]).any(axis=1))))
    ends = np.concatenate((starts[1:], [len(key)]))
    out: list[tuple[int, int]] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and b - out[-1][0] <= TILE_ROWS and (kind[out[-1][0]] == kind[a]).all():
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _compared(batches):
    """Rows sorted by kind of window and key, to ``word, n_near, best_n, best`` of each tile."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        keys = table.column("key").to_numpy()
        # The last block may go on in the next batch.
        cut = int(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[-1])
        waiting = table.slice(cut)
        yield from _compare(table.slice(0, cut))
    if waiting is not None:
        yield from _compare(waiting)


def _compare(table: pa.Table):
    if not table.num_rows:
        return
    key = table.column("key").to_numpy()
    kind = np.stack([table.column(c).to_numpy() for c in ("m", "lo", "hi")], axis=1)
    longer = table.column("longer").to_numpy(zero_copy_only=False)
    listed, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
    out: dict[str, tuple[int, int, str]] = {}
    for a, b in _tiles(key, kind):
        m, lo, hi = kind[a].tolist()
        width = hi - lo
        text = [w[lo : hi + more] for w, more in zip(listed[a:b], longer[a:b].tolist(), strict=True)]
        # Padded code points of the windows, one row per word.
        window = np.array(text, dtype=f"<U{width + 1}").view(np.uint32).reshape(b - a, width + 1)
        one, two = _near_in(window, longer[a:b], key[a:b], width, hi == m)
        for i, j in zip((one + a).tolist(), (two + a).tolist(), strict=True):
            v, w = listed[i], listed[j]
            # What lies outside the window agrees, unless two keys have the same hash.
            if v[:lo] != w[:lo] or v[hi:] != w[hi + int(longer[j]) :]:
                continue
            for mine, theirs, n in ((v, w, counts[j]), (w, v, counts[i])):
                so_far = out.get(mine)
                if so_far is None:
                    out[mine] = (1, n, theirs)
                else:
                    better = n > so_far[1] or (n == so_far[1] and theirs < so_far[2])
                    out[mine] = (so_far[0] + 1, *((n, theirs) if better else so_far[1:]))
    rows = list(out.items())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([w for w, _ in rows], pa.string()), pa.array([x[0] for _, x in rows], pa.int64()),
            pa.array([x[1] for _, x in rows], pa.int64()), pa.array([x[2] for _, x in rows], pa.string()),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """The key of a row's block: its length, its window, and what stands outside the window."""
    after = F.col("hi") + F.col("longer").cast("int")
    outside = [F.expr("substring(word, 1, lo)"), F.substring(F.col("word"), after + F.lit(1), F.char_length("word"))]
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", *outside))


def _halved(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi")))


def _blocks(listed: DataFrame, shelf: Shelf) -> list[DataFrame]:
    """The rows of all blocks that hold at least two words, as one table per round of cutting."""
    length = F.char_length("word")
    roles = F.filter(
        F.array(F.struct(length.alias("m"), F.lit(False).alias("longer")), F.struct((length - 1).alias("m"), F.lit(True).alias("longer"))),
        lambda x: x["m"] >= LEAST_LENGTH,
    )
    rows = listed.select("word", "n", F.explode(roles).alias("_")).select("word", "n", "_.m", "_.longer")
    rows = rows.select("*", F.lit(0).alias("lo"), F.col("m").alias("hi"))
    out, open_ = [], True
    while open_:
        rows = rows.withColumn("_", F.explode(_halved(F.col("lo"), F.col("hi")))).select("word", "n", "m", "longer", "_.lo", "_.hi")
        rows = shelf.put(_keyed(rows), "rows")
        sizes = rows.groupBy("key").agg(
            F.count("*").alias("size"), F.count_if(~F.col("longer")).alias("base"), F.max(F.col("hi") - F.col("lo")).alias("width")
        )
        # Blocks of one word, or of words of the longer length only, hold no pair.
        sizes = sizes.where("size > 1 and base > 0")
        large = ((F.col("size") > BLOCK_ROWS) | (F.col("width") > WIDEST)) & (F.col("width") > 1)
        dealt = shelf.put(rows.join(sizes.select("key", large.alias("large")), "key"), "dealt")
        out.append(dealt.where("not large").drop("large"))
        rows = dealt.where("large").drop("large", "key")
        open_ = not rows.isEmpty()
    return out


def near_words(listed: DataFrame, shelf: Shelf) -> DataFrame:
    """``word, n_near, best_n, best``: how many words are near, and the commonest of them with its count."""
    schema = "word string, n_near long, best_n long, best string"
    found = None
    for rows in _blocks(listed, shelf):
        compared = rows.repartition("key").sortWithinPartitions("m", "lo", "hi", "key").mapInArrow(_compared, schema)
        found = compared if found is None else found.union(compared)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("_")
    per_word = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return per_word.select("word", "n_near", (-F.col("_.less")).alias("best_n"), "_.best")


def _roots(forms: DataFrame, shelf: Shelf) -> DataFrame:
    """``word, root`` of the words that have a form, by doubling the reach of every chain per round."""
    reach = shelf.put(forms.select("word", F.col("form").alias("root")), "reach")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = reach.join(onward, "root", "left")
        after = shelf.put(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "reach")
        reach = after.select("word", "root")
        if after.where("moved").isEmpty():
            return reach


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Every word with its form and root: ``word, form, root, n, n_near, form_n``. Takes ``doc_id, text``."""
    shelf = Shelf(docs.sparkSession)
    try:
        listed = shelf.put(vocabulary(docs), "words")
        near = listed.join(near_words(listed, shelf), "word", "left")
        has = F.col("best_n") >= TIMES * F.col("n")
        formed = shelf.put(
            near.select(
                "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"),
            ),
            "forms",
        )
        roots = _roots(formed.where("form is not null"), shelf)
        out = formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return keep(out.select("word", "form", "root", "n", "n_near", "form_n"), "spelling")
    finally:
        shelf.drop()
