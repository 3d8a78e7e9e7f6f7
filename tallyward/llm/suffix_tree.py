"""Language-model scores from a probabilistic suffix tree over whole words.

The tree grows level by level. A context of up to ``depth`` words is counted if it occurs ``least`` times in the training
documents, whatever their size, and every word that follows it is. Its distribution is mixed with what its shorter
suffix predicts; the weight of the suffix is the one of ``RESTS`` under which each of the context's own occurrences,
left out in turn, is best predicted. A context is kept if that gains at least ``divergence`` (nats a token) on the suffix
alone. A position is scored by the kept suffixes of what precedes it, from the word's own count up to the longest; the
text's beginning counts as the end of another.

Scale: what is learned grows with the corpus and is never gathered. Texts are dealt once to blocks of ``BLOCK_BYTES``, in a
table bucketed by block, and do not move again. Level by level each block asks for the counts of its distinct runs whose
context is frequent enough: the sorted hashes are cut into ranges, and a range travels as one packed row. One task per range
adds up what all blocks hold and answers each block in the order of its question, so no hash travels back. It also numbers
the frequent runs, and when contexts are tested blocks name them by these numbers and send the counts of the runs that they
stand for. To list the next runs a block reads back only one bit for each run, whether it is frequent. A run or context has at
most one entry per block. The driver gets two numbers.

Defined results: null text is empty and has one token, its end. A null id counts as the empty text when documents are
dealt to training and held-out ones. Repeated rows are learned and scored each. Equal gains go to the larger weight of the
suffix. A text longer than a block is a block of its own. Without training documents all counts are zero. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm import words
from tallyward.llm.staging import keep, let_go, shelf

#: Text that shares its questions.
BLOCK_BYTES = 12 << 20
#: Text that is hashed at once, so that its figures stay in a core's cache; hashes do not depend on it.
HASHED_BYTES = 256 << 10
#: Weights that the suffix of a context may have.
RESTS = (0.1, 0.3, 0.5, 0.7, 0.9)
#: Gains are rounded to so many parts of a nat for each run, so that their sums do not depend on how texts are dealt.
GRAIN = 4096
#: Stands for the hash of the end of a text.
END_WORD = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _blocks(batches):
    """Number blocks of about ``BLOCK_BYTES`` of text inside each task's rows."""
    block, size = TaskContext.get().partitionId() << 24, 0
    for part in words.slices(batches):
        size += part.column("text").nbytes
        if size > BLOCK_BYTES:
            block, size = block + 1, 0
        yield part.append_column("block", pa.array(np.full(part.num_rows, block, np.int64)))


def _packed(values: np.ndarray) -> bytes:
    """Numbers, one row each, as planes of the bytes of the same place: left out if zero, else compressed if that is shorter.

    Each plane is compressed for itself, as random low bytes would spoil the code of the others.
    """
    item = values.dtype.itemsize * int(np.prod(values.shape[1:]))
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), item).T)
    kinds, sizes, parts = np.zeros(len(planes), np.uint8), [], []
    for i, plane in enumerate(planes):
        if plane.any():
            raw, small = plane.tobytes(), pa.Codec("zstd").compress(plane, asbytes=True)
            if len(small) + 4 < len(raw):
                kinds[i] = 2
                sizes.append(len(small))
                parts.append(small)
            else:
                kinds[i] = 1
                parts.append(raw)
    return b"".join([kinds.tobytes(), np.array(sizes, np.uint32).tobytes(), *parts])


def _unpacked(data: bytes, size: int, kind: type, width: int = 1) -> np.ndarray:
    item = np.dtype(kind).itemsize * width
    kinds = np.frombuffer(data, np.uint8, item)
    sizes = iter(np.frombuffer(data, np.uint32, int((kinds == 2).sum()), item).tolist())
    at = item + 4 * int((kinds == 2).sum())
    planes = np.zeros((item, size), np.uint8)
    for i in np.flatnonzero(kinds):
        n = size if kinds[i] == 1 else next(sizes)
        part = data[at : at + n]
        planes[i] = np.frombuffer(part if kinds[i] == 1 else pa.Codec("zstd").decompress(part, size, asbytes=True), np.uint8)
        at += n
    out = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return out if width == 1 else out.reshape(size, width)


def _packed_bits(mask: np.ndarray) -> bytes:
    return _packed(np.packbits(mask))


def _unpacked_bits(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(_unpacked(data, -(-size // 8), np.uint8), count=size) > 0


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the first place of each, and for every hash its number among them.

    High bits and the place are sorted as one number; if two hashes share the high bits, all are sorted whole.
    """
    if not len(values):
        return values, np.empty(0, np.int64), np.empty(0, np.int32)
    low = np.uint64((1 << (len(values) - 1).bit_length()) - 1)
    order = (np.sort((values & ~low) | np.arange(len(values), dtype=np.uint64)) & low).astype(np.int64)
    own = values[order]
    if ((own[1:] != own[:-1]) & ((own[1:] ^ own[:-1]) <= low)).any():
        order = np.argsort(values, kind="stable")
        own = values[order]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return own[new], order[new], number


#: ``level``: length of the context, negative where contexts and not runs are asked for.
ASKED = pa.schema({"range": pa.int64(), "block": pa.int64(), "level": pa.int32(), "size": pa.int32(), "keys": pa.binary(), "figures": pa.binary(),
                   "runs": pa.binary()})
ANSWERED = pa.schema({"range": pa.int64(), "block": pa.int64(), "level": pa.int32(), "size": pa.int32(), "answer": pa.binary(), "lead": pa.binary(),
                      "often": pa.binary(), "place": pa.binary(), "kinds": pa.int64(), "total": pa.int64()})
ASKED_SQL = "range long, block long, level int, size int, keys binary, figures binary, runs binary"
ANSWERED_SQL = "range long, block long, level int, size int, answer binary, lead binary, often binary, place binary, kinds long, total long"
#: What of the answers is read to list the next runs, to test contexts, and to score.
GROWING = ["range", "block", "level", "size", "often"]
TESTING = ["range", "block", "level", "size", "answer", "lead", "place"]
SCORING = ["range", "block", "level", "size", "answer"]


def _pieces(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Range, first and past-the-last place of sorted hashes, for each of the ``2 ** bits`` ranges of hashes that holds any."""
    if not len(keys):
        return []
    own = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(keys)]
    return [(int(own[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _steps(values: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return _packed(np.diff(values, prepend=values.dtype.type(0)))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema)


def _counter(least: int, last: bool):
    """Answers to the questions of one range: how often each run stands in training documents of other blocks, whether the block
    is the one that stands for the run (the first that holds it) if that came twice, and, unless no run grows further, whether the run is frequent
    and the numbers of those that are."""

    def run(rows: pa.Table) -> pa.Table:
        asked = rows.sort_by([("block", "ascending")]).to_pylist()
        _, first, number = _distinct(np.concatenate([np.cumsum(_unpacked(r["keys"], r["size"], np.uint64), dtype=np.uint64) for r in asked]))
        n = np.concatenate([_unpacked(r["figures"], r["size"], np.uint32) for r in asked])
        sums = np.bincount(number, weights=n).astype(np.uint64)
        others = sums[number] - n
        lead = np.zeros(len(number), bool)
        lead[first] = sums > 1
        often = (sums >= least)[number]
        place = (np.cumsum(sums >= least) - 1).astype(np.uint32)[number]
        bounds = np.cumsum([0, *(r["size"] for r in asked)])
        figures = [(int((sums > 0).sum()), int(sums.sum()))] + [(0, 0)] * len(asked)
        return _table([
            (r["range"], r["block"], r["level"], r["size"], _packed(others[a:b]), _packed_bits(lead[a:b]),
             b"" if last else _packed_bits(often[a:b]), b"" if last else _steps(place[a:b][often[a:b]]), *f)
            for r, a, b, f in zip(asked, bounds[:-1], bounds[1:], figures)
        ], ANSWERED)

    return run


def _judge(divergence: float):
    """Answers for contexts: 0 if the suffix alone predicts as well, else the place of the suffix's weight, from 1.

    The gain of each run is what its occurrences, each left out in turn, gain on the suffix, for each weight of ``RESTS``.
    """
    weights = np.log(RESTS)

    def run(rows: pa.Table) -> pa.Table:
        levels: dict[int, list] = {}
        for r in rows.sort_by([("block", "ascending")]).to_pylist():
            levels.setdefault(r["level"], []).append(r)
        out = []
        for asked in levels.values():
            places = [np.cumsum(_unpacked(r["keys"], r["size"], np.uint32), dtype=np.uint32) for r in asked]
            figures = [_unpacked(r["figures"], r["size"], np.int64, 3) for r in asked]
            pairs = [_unpacked(r["runs"], int(f[:, 0].sum()), np.int64, 2) for r, f in zip(asked, figures)]
            place, figures, pairs = np.concatenate(places), np.concatenate(figures), np.concatenate(pairs)
            total, shorter = np.bincount(place, weights=figures[:, 1]), np.bincount(place, weights=figures[:, 2])
            own = np.repeat(place, figures[:, 0])
            c, suffix = pairs[:, 0], pairs[:, 1]
            ratio = (c - 1) / (total[own] - 1) / (suffix / shorter[own])
            # A next word that came once is predicted by the suffix alone when it is left out.
            once = total - np.bincount(own, weights=c, minlength=len(total))
            gains = np.stack([
                np.bincount(own, weights=np.rint(GRAIN * c * np.log((1 - rest) * ratio + rest)), minlength=len(total)) / GRAIN + once * w
                for rest, w in zip(RESTS, weights)
            ])
            best = len(RESTS) - 1 - np.argmax(gains[::-1], axis=0)
            kept = np.where(gains.max(axis=0) >= divergence * total, best + 1, 0).astype(np.uint8)
            out += [
                (r["range"], r["block"], r["level"], r["size"], _packed(kept[p]), b"", b"", b"", 0, 0) for r, p in zip(asked, places)
            ]
        return _table(out, ANSWERED)

    return run


def _joined(kind: type, parts) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *parts])


class Block:
    """Tokens of a block's texts, one text after the other, each with its end, and what is known of their runs.

    By ``k``: ``at``, the tokens that have a frequent context of ``k`` tokens; ``values``, the distinct hashes of their runs
    of ``k`` tokens and themselves; ``spot``, the number of each token's run among those; ``often``, the tokens whose run is
    frequent. Where counts are read: ``known``, how often each run stands in training documents, and ``counts`` the same by token,
    0 where ``at`` lacks it; ``leads``, the runs that the block stands for, if they came twice; ``firsts``, one token for each
    run; ``place``, the number of each frequent run in its range. There is a context of ``k`` tokens if at least ``k - 1`` come before: the text's
    beginning counts as one end.
    """

    def __init__(self, texts: pa.Table, least: int):
        self.texts, self.least, self.number = texts, least, texts.column("block")[0].as_py()
        held = [words.hashed(p.column("text"), lower=True) for p in words.slices(iter(texts.to_batches()), most=HASHED_BYTES)]
        self.size = np.concatenate([np.diff(bounds) for _, bounds in held]) + 1
        self.last = np.cumsum(self.size) - 1
        word = np.full(int(self.size.sum()), END_WORD)
        real = np.ones(len(word), bool)
        real[self.last] = False
        word[real] = np.concatenate([value for value, _ in held])
        self.word = self.run = word
        self.before = np.arange(len(word)) - np.repeat(self.last - self.size + 1, self.size)
        self.learn = np.repeat(~texts.column("held_out").to_numpy(), self.size)
        self.at, self.values, self.spot, self.often = [], [], [], []
        self.known, self.counts, self.leads, self.firsts, self.place = [], [], [], [], []
        self._list(np.arange(len(word)))

    def _list(self, at: np.ndarray) -> None:
        value, first, number = _distinct(self.run[at])
        spot = np.zeros(len(self.word), np.int32)
        spot[at] = number
        self.at.append(at)
        self.values.append(value)
        self.first = at[first]
        self.spot.append(spot)

    def earlier(self, at: np.ndarray) -> np.ndarray:
        """The token before each; before the first of the block stands its last, an end like any other."""
        return at - 1

    def own(self, k: int) -> np.ndarray:
        """How often each run stands in the block's training documents."""
        at = self.at[k]
        return np.bincount(self.spot[k][at], weights=self.learn[at], minlength=len(self.values[k])).astype(np.uint32)

    def take(self, rows: pa.Table, depth: int) -> Block:
        """Read the answers to the questions of all levels up to ``depth``, as far as ``rows`` has them."""
        found: dict[int, list] = {}
        for r in rows.sort_by([("range", "ascending")]).to_pylist():
            found.setdefault(r["level"], []).append(r)
        self.found = found
        for k in range(depth + 1):
            own = found.get(k, [])
            if "answer" in rows.column_names:
                known = _joined(np.uint64, (_unpacked(r["answer"], r["size"], np.uint64) for r in own)) + self.own(k)
                self.known.append(known)
                self.counts.append(self._by_token(k, known.astype(float)))
                self.often.append(self.counts[k] >= self.least)
            else:
                self.often.append(self._by_token(k, _joined(bool, (_unpacked_bits(r["often"], r["size"]) for r in own))))
            if "lead" in rows.column_names:
                self._read_lead(k, own, k < depth)
            if k < depth:
                self.grow()
        return self

    def _by_token(self, k: int, values: np.ndarray) -> np.ndarray:
        if not k:
            return values[self.spot[0]]
        out = np.zeros(len(self.word), values.dtype)
        out[self.at[k]] = values[self.spot[k][self.at[k]]]
        return out

    def _read_lead(self, k: int, rows: list[dict], grows: bool) -> None:
        lead = _joined(bool, (_unpacked_bits(r["lead"], r["size"]) for r in rows))
        self.leads.append(lead)
        self.firsts.append(self.first)
        place = np.zeros(len(lead), np.uint32)
        if grows:
            often = self.known[k] >= self.least
            sizes = np.add.reduceat(often, np.cumsum([0, *(r["size"] for r in rows[:-1])]), dtype=np.int64).tolist() if rows else []
            place[often] = _joined(np.uint32, (np.cumsum(_unpacked(r["place"], n, np.uint32), dtype=np.uint32) for r, n in zip(rows, sizes)))
        self.place.append(place)

    def grow(self) -> Block:
        """List the runs of one token more whose context is frequent."""
        k = len(self.at)
        context = np.concatenate(([END_WORD], self.run[:-1]))
        of = np.roll(self.often[-1], 1)
        self.run = words.mix(context * np.uint64(words.BASE) + self.word + np.uint64(k))
        self._list(np.flatnonzero((self.before >= k - 1) & of))
        return self

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the runs a level below are frequent contexts of the block, and the number of each run among those."""
        seen = np.zeros(len(self.values[k - 1]), bool)
        seen[self.spot[k - 1][self.earlier(self.at[k])]] = True
        return seen, np.cumsum(seen) - 1

    def ask(self, k: int, bits: int) -> pa.Table:
        """How often the distinct runs of ``k`` tokens and one stand in the block's training documents."""
        value, n = self.values[k], self.own(k)
        return _table([(own, self.number, k, b - a, _steps(value[a:b]), _packed(n[a:b]), b"") for own, a, b in _pieces(value, bits)], ASKED)

    def test(self, depth: int, tokens: int, bits: int) -> pa.Table:
        """Frequent contexts by their numbers. For each: how many runs after it the block stands for, and, if it stands for the
        context itself, the counts of that and of its suffix, else zeros; for each of those runs its count and its suffix's."""
        out = []
        for k in range(1, depth + 1):
            seen, number = self.contexts(k)
            value, place, stands, at = self.values[k - 1][seen], self.place[k - 1][seen], self.leads[k - 1][seen], self.firsts[k][self.leads[k]]
            context = number[self.spot[k - 1][self.earlier(at)]]
            order = np.argsort(context, kind="stable")
            runs = np.stack([self.counts[k][at], self.counts[k - 1][at]], axis=1).astype(np.int64)[order]
            held = np.bincount(context, minlength=len(value))
            shorter = self.counts[k - 2][self.firsts[k - 1][seen]] if k > 1 else tokens
            figures = np.stack([held, np.where(stands, self.known[k - 1][seen], 0), np.where(stands, shorter, 0)], axis=1).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(held)))
            out += [
                (own, self.number, -k, b - a, _steps(place[a:b]), _packed(figures[a:b]), _packed(runs[ends[a] : ends[b]]))
                for own, a, b in _pieces(value, bits)
            ]
        return _table(out, ASKED)

    def score(self, depth: int, tokens: int, kinds: int) -> pa.Table:
        base = (self.counts[0] + 0.5) / (tokens + 0.5 * (kinds + 1))
        chance = base.copy()
        weights = np.array([1.0, *RESTS])
        for k in range(1, depth + 1):
            at, before = self.at[k], self.earlier(self.at[k])
            weight = np.ones(len(self.values[k - 1]))
            weight[self.contexts(k)[0]] = weights[_joined(np.uint8, (_unpacked(r["answer"], r["size"], np.uint8) for r in self.found.get(-k, [])))]
            rest = weight[self.spot[k - 1][before]]
            own = self.counts[k][at] / self.counts[k - 1][before]
            chance[at] = np.where(rest < 1, (1 - rest) * own, 0) + rest * chance[at]
        begins = self.last - self.size + 1
        return pa.table([
            self.texts.column("doc_id"), self.texts.column("held_out"), self.size, np.add.reduceat((self.counts[0] > 0).astype(np.int64), begins),
            np.full(len(self.size), tokens, np.int64), np.add.reduceat(np.log10(base), begins), np.add.reduceat(np.log10(chance), begins),
        ], SCORED)


SCORED = pa.schema({"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
                    "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()})
SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _first_asker(least: int, bits: int):
    return lambda texts: Block(texts, least).ask(0, bits)


def _asker(level: int, least: int, bits: int):
    return lambda texts, rows: Block(texts, least).take(rows, level - 1).grow().ask(level, bits)


def _tester(depth: int, least: int, tokens: int, bits: int):
    return lambda texts, rows: Block(texts, least).take(rows, depth).test(depth, tokens, bits)


def _scorer(depth: int, least: int, tokens: int, kinds: int):
    return lambda texts, rows: Block(texts, least).take(rows, depth).score(depth, tokens, kinds)


def suffix_tree_scores(docs: DataFrame, depth: int = 3, least: int = 3, divergence: float = 0.02) -> DataFrame:
    """Score every document under the tree and under single-word counts, both learned from the training documents.

    Takes ``doc_id, text``; returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per input
    row, scores as log10 probabilities of the whole text.
    """
    least = max(least, 2)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // BLOCK_BYTES + 1
    bits = (buckets - 1).bit_length()
    spark = docs.sparkSession
    with shelf(spark) as own:
        dealt = docs.mapInArrow(_blocks, "doc_id long, text string, held_out boolean, block long")
        texts = own.deal(dealt, "texts", "block", buckets).groupBy("block")
        asked = texts.applyInArrow(_first_asker(least, bits), ASKED_SQL)
        known = own.put(asked.groupBy("range").applyInArrow(_counter(least, depth == 0), ANSWERED_SQL), "words")
        kinds, tokens = known.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        for level in range(1, depth + 1):
            let_go(spark)
            asked = texts.cogroup(known.select(GROWING).groupBy("block")).applyInArrow(_asker(level, least, bits), ASKED_SQL)
            known = known.union(own.put(asked.groupBy("range").applyInArrow(_counter(least, level == depth), ANSWERED_SQL), f"level{level}"))
        let_go(spark)
        asked = texts.cogroup(known.select(TESTING).groupBy("block")).applyInArrow(_tester(depth, least, tokens, bits), ASKED_SQL)
        known = known.union(own.put(asked.groupBy("range").applyInArrow(_judge(divergence), ANSWERED_SQL), "kept"))
        let_go(spark)
        scored = texts.cogroup(known.select(SCORING).groupBy("block")).applyInArrow(_scorer(depth, least, tokens, kinds), SCORED_SQL)
        return keep(scored, "scores")
