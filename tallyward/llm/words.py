"""Words of many texts at once: flat arrays of 64-bit hashes, for use inside Arrow tasks.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once in a task; one longer text is handled alone.
SLICE_BYTES = 4 << 20

IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Words of letters, digits and everything outside ASCII, without punctuation.
PLAIN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])

_rng = np.random.default_rng(19260817)
VALUES = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
LOWER_VALUES = VALUES.copy()
LOWER_VALUES[65:91] = VALUES[97:123]
#: 5 modulo 8, so that its powers keep as many bits apart as they can.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``most`` bytes of text, so that memory does not follow batch sizes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        start = 0
        while start < len(size):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one separator after each, and where each text begins (and the last ends)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b"\n".join(pc.fill_null(texts, "").cast(pa.binary()).to_pylist()) + b"\n"
    data = np.frombuffer(joined if len(texts) else b"", np.uint8)
    return data, np.concatenate(([0], np.cumsum(size + 1)))


def places(data: np.ndarray, begins: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word, and the bounds of each text among the words."""
    inside = np.concatenate(([False], in_word[data]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    return first, last, np.searchsorted(first, begins).astype(np.int64)


def hashed(texts: pa.Array, lower: bool, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and the bounds of each text among them.

    Each byte stands for a random 64-bit number; a word is the value of the polynomial with these coefficients,
    taken from running sums, and scrambled.
    """
    data, begins = bytes_of(texts)
    first, last, bounds = places(data, begins, in_word)
    value = (LOWER_VALUES if lower else VALUES)[data]
    powers = _powers(len(data))
    value *= powers
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    # The factor that brings the word to power zero is the inverse power at its first byte.
    out = (total[last] - total[first]) * _inverses(len(data))[first]
    return mix(out + (last - first).astype(np.uint64)), bounds


_POWERS: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        size = max(n, 1 << 16)
        found = np.full(size, base, np.uint64)
        found[0] = 1
        _POWERS[base] = found = np.cumprod(found, dtype=np.uint64)
    return found[:n]


def _powers(n: int) -> np.ndarray:
    return _table(BASE, n)


def _inverses(n: int) -> np.ndarray:
    return _table(INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside one text, and the bounds of each text among the runs."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    own = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    n = len(values) - width + 1
    if n <= 0 or not own[-1]:
        return np.empty(0, np.uint64), own
    out = values[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += values[k : n + k]
    inside = np.arange(n) + width <= np.repeat(bounds[1:], np.diff(bounds))[:n]
    return mix(out[inside]), own


def whole(values: np.ndarray) -> np.uint64:
    """Hash of one short sequence of word hashes, told apart by its length."""
    return np.uint64(xxhash.xxh3_64_intdigest(values.tobytes(), seed=len(values)))


def list_array(flat: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
