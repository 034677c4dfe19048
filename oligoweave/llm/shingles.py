"""Sets of word shingles as 64-bit numbers, worked out on the bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_MASK = (1 << 64) - 1
_STEP = 0x2545F4914F6CDD1D
_BACK = pow(_STEP, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def spread(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mixing of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _byte_values() -> np.ndarray:
    """A number per byte; capital letters have that of the small ones."""
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += 32
    return spread(low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567))


_VALUES = _byte_values()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """Distinct shingle hashes of texts."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self._up = self._down = np.empty(0, np.uint64)

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document number, hash), both sorted, without repeats; data: bytes of the texts one after the other, ends: where each ends.

        Documents of fewer words than a shingle have one hash for the whole sequence.
        """
        if len(self._up) < len(data) + 1:
            self._up, self._down = _powers(_STEP, len(data) + 1), _powers(_BACK, len(data) + 1)
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        word = ~_SPACES[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True
        cut[0] = True
        before = np.concatenate([[False], word[:-1]]) & ~cut[:-1]
        after = np.concatenate([word[1:], [False]]) & ~cut[1:]
        starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        sums = np.cumsum(_VALUES[data] * self._up[: len(data)], dtype=np.uint64)
        head = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        lengths = (stops - starts + 1).astype(np.uint64)
        hashes = spread((sums[stops] - head) * self._down[starts] + spread(lengths))
        doc = np.searchsorted(ends, starts, side="right")
        k = self.words
        rows, found = [], []
        if len(hashes) >= k:
            whole = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
            rows.append(doc[whole])
            found.append(self._sequence(hashes, whole, k))
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        counts = np.diff(np.append(first, len(doc)))
        for n in range(1, k):
            short = first[counts == n]
            rows.append(doc[short])
            found.append(self._sequence(hashes, short, n))
        row, value = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        return row[new], value[new]

    @staticmethod
    def _sequence(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(at), spread(np.array([n], np.uint64))[0])
        for j in range(n):
            out = spread(out + hashes[at + j] * np.uint64(2 * j + 0x632BE59BD9B4E019))
        return out


def text_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and end offsets of a string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return held, at[1:] - at[0]


def blocks(data: np.ndarray, ends: np.ndarray, most: int = 1_500_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, ends) of runs of whole documents of about `most` bytes."""
    at = 0
    while at < len(ends):
        start = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield at, data[start : ends[stop - 1]], ends[at:stop] - start
        at = stop


def sets_of(texts: pa.Array, shingler: Shingler) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all sets one after the other, size of each set, two 64-bit keys of each set)."""
    data, ends = text_arrays(texts)
    values, sizes, keys = [], np.zeros(len(ends), np.int64), np.zeros((len(ends), 2), np.uint64)
    for at, part, part_ends in blocks(data, ends):
        row, value = shingler.of(part, part_ends)
        values.append(value)
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            docs = row[first] + at
            sizes[docs] = np.diff(np.append(first, len(row)))
            for j, salt in enumerate((0x51ED270B5A1C9F37, 0xA3C59AC2F1E6B8D5)):
                keys[docs, j] = np.add.reduceat(spread(value ^ np.uint64(salt)), first)
    return np.concatenate(values) if values else np.empty(0, np.uint64), sizes, keys
