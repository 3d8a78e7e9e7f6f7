"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

How many pieces there are of each length is all that matters for a packing, and there are at most ``capacity``
lengths. So the instance that the reduction and the best fit work on is a table of counts of bounded size, whatever
the corpus. Its solution is a list of patterns (lengths that share a sequence) with multiplicities; every piece finds
its place from its rank among the pieces of its length. Ranks are counted in slices, so no length is sorted in one task.

Defined results: null text is empty; a document then is its end token alone. Repeated rows and null ids are packed
like any other rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm import words
from tallyward.llm.staging import Shelf, keep

#: Pieces that one slice ranks at a time.
SLICE_ROWS = 50_000
#: Highest character that takes the fast encoder; it agrees with the other one there (a test compares them).
PLAIN = 0x24F

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """A function from texts to id lists, as the vocabulary file's tokenizer gives them, without special tokens added.

    Texts in Latin letters go through an encoder with the same merges that is several times as fast.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    if vocabulary in _ENCODERS:
        return _ENCODERS[vocabulary]
    full = Tokenizer.from_file(vocabulary)
    special = {token.content: n for n, token in full.get_added_tokens_decoder().items()}
    byte_of = _bytes_of_symbols()
    ranks = {
        bytes(byte_of[c] for c in token): n for token, n in full.get_vocab(with_added_tokens=False).items() if token not in special
    }
    fast = tiktoken.Encoding("same merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if text.isascii() or (max(text) <= chr(PLAIN) and "\x85" not in text):
            if not any(s in text for s in special):
                return fast.encode_ordinary(text)
        return full.encode(text, add_special_tokens=False).ids

    _ENCODERS[vocabulary] = encode
    return encode


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of one document: full ones, after a first one that may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(k, capacity) for k in range(first, length, capacity)]


def _cutter(vocabulary: str, end_id: int, capacity: int):
    def run(batches):
        encode = encoder(vocabulary)
        for part in words.slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                rows += [
                    (doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()))
                    for k, (start, n) in enumerate(cuts(len(ids), capacity))
                ]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def reduce_counts(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction on ``counts`` of each length: fixes sets that dominate every other set with their
    largest piece, takes them out of ``counts``, and returns them as (lengths, how often).

    A set dominates another if single pieces of it weigh at least as much as disjoint groups of the other. For the
    largest piece ``a``, with ``b`` the largest that fits beside it, the sets looked at have up to three pieces:

    * ``a`` alone, if nothing fits beside it;
    * ``a, b``, if the two fill the sequence, or no two pieces fit beside ``a``, or no three do and no two that fit
      weigh more than ``b``;
    * ``a, b`` and the largest ``c`` that fits beside both, if no three pieces fit beside ``a`` and no two that are
      both larger than ``c`` do.

    Where none of these holds, the reduction ends for this length and the best fit takes what is left of it.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        uses = {x: lengths.count(x) for x in lengths}
        times = min(int(counts[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            counts[x] -= n * times
        fixed.append((lengths, times))

    def two_smallest_fit(above: int, room: int) -> bool:
        low = np.flatnonzero(counts[above + 1 : room + 1])[:2] + above + 1
        return len(low) > 0 and (2 * low[0] <= room and counts[low[0]] > 1 or len(low) > 1 and low[0] + low[1] <= room)

    for a in range(capacity, 0, -1):
        while counts[a]:
            room = capacity - a
            counts[a] -= 1
            there = np.flatnonzero(counts[: room + 1])
            b = int(there[-1]) if len(there) else 0
            smallest = [x for x in there[:3] for _ in range(min(3, int(counts[x])))][:3]
            chosen: tuple[int, ...] | None = None
            if not b:
                chosen = (a,)
            elif b == room or not two_smallest_fit(0, room):
                chosen = (a, b)
            elif len(smallest) < 3 or sum(smallest) > room:
                counts[b] -= 1
                c = int(np.flatnonzero(counts[: room - b + 1])[-1:].sum())
                counts[b] += 1
                if _best_pair(counts, there, room) <= b:
                    chosen = (a, b)
                elif c and not two_smallest_fit(c, room):
                    chosen = (a, b, c)
            counts[a] += 1
            if chosen is None:
                break
            take(chosen)
    return fixed


def _best_pair(counts: np.ndarray, there: np.ndarray, room: int) -> int:
    """The most that two pieces which fit into ``room`` weigh together; 0 if no two fit."""
    best = 0
    for x in there[::-1]:
        second = there[there <= min(x, room - x)]
        if len(second) and second[-1] == x and counts[x] < 2:
            second = second[:-1]
        best = max(best, int(x + second[-1]) if len(second) else 0)
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts of each length: every piece goes where the least room stays.

    Sequences with the same content are handled together, so the work follows the number of lengths.
    """
    open_by_room: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for a in range(capacity, 0, -1):
        left = int(counts[a])
        room = a
        while left:
            while room <= capacity and not open_by_room[room]:
                room += 1
            if room > capacity:
                each = capacity // a  # new sequences, filled with this length as far as it goes
                full, over = divmod(left, each)
                for n, times in ((each, full), (over, 1 if over else 0)):
                    if times:
                        space = open_by_room[capacity - n * a]
                        space[(a,) * n] = space.get((a,) * n, 0) + times
                break
            held, times = next(iter(open_by_room[room].items()))
            fits = min(room // a, left)  # best fit goes on with the same sequence: its room is now the least
            used = min(times, left // fits)
            if used == times:
                del open_by_room[room][held]
            else:
                open_by_room[room][held] = times - used
            new = held + (a,) * fits
            space = open_by_room[room - fits * a]
            space[new] = space.get(new, 0) + used
            left -= used * fits
    return [(held, n) for space in open_by_room for held, n in space.items()]


def solve(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and multiplicities that hold all pieces: the fixed sets, then the best fit of what is left."""
    left = counts.copy()
    return reduce_counts(left, capacity) + best_fit(left, capacity)


def _placer(patterns: list[tuple[tuple[int, ...], int]]):
    """Sequence and offset from length and rank: each slot of a pattern serves a run of ranks of its length."""
    slots, used, base = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            begin = used.get(n, 0)
            slots.append((n, begin, base, offset))
            used[n] = begin + times
            offset += n
        base += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 48) | table[:, 1]

    def run(batches):
        for part in batches:
            length, rank = part.column("length").to_numpy(), part.column("rank").to_numpy()
            slot = table[np.searchsorted(keys, (length << 48) | rank, side="right") - 1] if len(length) else table[:0]
            place = [pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])]
            kept = part.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *place], [*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack every document's tokens into sequences of at most ``capacity``.

    Takes ``doc_id, text``; returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. ``vocabulary`` is a byte-level tokenizer file that every executor can read.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = shelf.put(docs.mapInArrow(_cutter(vocabulary, end_id, capacity), schema), "pieces")
    by_length = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_length:
        counts[row["length"]] = row["count"]

    slices = max(1, -(-int(counts.sum()) // SLICE_ROWS))
    dealt = pieces.withColumn("slice", F.pmod(F.xxhash64(*pieces.columns), F.lit(slices)))
    sizes = dealt.groupBy("length", "slice").count()
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("inside", inside).join(offsets, ["length", "slice"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("inside") - 1).alias("rank"))
    placed = ranked.mapInArrow(_placer(solve(counts, capacity)), schema + ", sequence_id long, offset long")
    result = keep(placed, "packed")
    shelf.drop()
    return result
