"""Least even spacers of many panels at once, by bounds.

A spacer of one sequence can be told to be out of the question from the columns where its
bases find no room any more. Room only shrinks as sequences are added, so the least spacer
that each sequence left still has room for bounds the total, and the longest spacer, of
all combos that begin as a prefix does. A beam search finds a good combo of each panel
first; then prefixes are left as soon as their bound is above the best combo known.

Prefixes are rows of arrays, of many panels at once, and are grown block by block, so
memory is bounded by blocks and sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from oligoweave.functions import constants as C

#: Prefixes of a panel that the beam search keeps.
BEAM = 64
#: Panels of a beam search, and prefixes of a search, that are grown together.
PANELS, BLOCK = 32, 8192
#: Above any key.
NONE = np.int64(1) << 60


@dataclass
class Prefixes:
    """Combos of the first sequences: number of the panel, counts of its columns, and the bounds of what is left."""

    panel: np.ndarray
    counts: np.ndarray
    combo: np.ndarray
    total: np.ndarray
    longest: np.ndarray
    # least spacers of the sequences after the next one: their sum and their longest
    rest: np.ndarray
    rest_longest: np.ndarray
    # which spacers the next sequence has room for
    room: np.ndarray
    key: np.ndarray

    def at(self, rows: np.ndarray) -> Prefixes:
        return Prefixes(*(getattr(self, name)[rows] for name in self.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.panel)


class Search:
    """Panels of ``n`` sequences in fields of ``bits`` bits, ``per`` in a number; ``longest``: by the longest spacer first."""

    def __init__(self, seqs: list[list[str | None]], n: int, width: int, limit: int, bits: int, per: int, longest: bool):
        self.n, self.limit, self.longest = n, limit, longest
        self.words = words = -(-width // per)
        self.bits, self.quota, self.fraction = bits, -(-n // 4), n % 4
        self.each = sum(1 << (bits * i) for i in range(per))
        self.top = self.each << (bits - 1)
        text = "".join((q or "")[:width].ljust(width) for panel in seqs for q in panel).encode("ascii", "replace")
        letters = np.frombuffer(text, np.uint8).reshape(len(seqs), n, 1, width)
        found = np.zeros((len(seqs), n, len(C.BASES), words * per), bool)
        found[..., :width] = letters == np.frombuffer("".join(C.BASES).encode(), np.uint8)[:, None]
        one = np.int64(1) << (np.int64(bits) * np.arange(per))
        #: what a sequence behind a spacer adds: panel, sequence, spacer, base and word
        self.added = np.zeros((len(seqs), n, limit + 1, len(C.BASES) * words), np.int64)
        for s in range(min(limit, width) + 1):
            moved = np.zeros_like(found)
            moved[..., s:width] = found[..., : width - s]
            self.added[:, :, s] = (moved.reshape(len(seqs), n, -1, per) * one).sum(-1)

    def keys(self, total: np.ndarray, longest: np.ndarray) -> np.ndarray:
        return longest * (self.n * self.limit + 1) + total if self.longest else total

    def _at_least(self, counts: np.ndarray, least: int) -> np.ndarray:
        return (counts + (self.top - self.each * least)) & self.top

    def _blocked(self, counts: np.ndarray) -> np.ndarray:
        """The columns, as lowest bits of their fields, where one base more could not become even."""
        own = counts.reshape(len(counts), len(C.BASES), self.words)
        full = self._at_least(own, self.quota)
        if self.fraction:
            many = (full >> (self.bits - 1)).sum(1, keepdims=True)
            full = full | (self._at_least(own, self.quota - 1) & self._at_least(many, self.fraction))
        return (full >> (self.bits - 1)).reshape(counts.shape)

    def _fits(self, blocked: np.ndarray, panel: np.ndarray, k: int, s: int) -> np.ndarray:
        return ~(blocked & self.added[panel, k, s]).any(1)

    def _least(self, blocked: np.ndarray, panel: np.ndarray, k: int) -> np.ndarray:
        """The least spacer of sequence k that there is room for; above the limit if none."""
        out, left = np.full(len(panel), self.limit + 1), np.arange(len(panel))
        for s in range(self.limit + 1):
            fits = self._fits(blocked[left], panel[left], k, s)
            out[left[fits]] = s
            left = left[~fits]
            if not len(left):
                break
        return out

    def _bounded(self, panel: np.ndarray, counts: np.ndarray, combo: np.ndarray, most: np.ndarray) -> Prefixes:
        """Prefixes with their bounds, those up to ``most`` (a key per panel); a panel goes out where a sequence has no room."""
        k = combo.shape[1]
        total, longest = combo.sum(1), combo.max(1, initial=0)
        blocked, alive = self._blocked(counts), np.ones(len(panel), bool)
        rest, rest_longest = np.zeros(len(panel), np.int64), np.zeros(len(panel), np.int64)
        for r in range(self.n - 1, k, -1):
            rows = np.flatnonzero(alive)
            least = self._least(blocked[rows], panel[rows], r)
            rest[rows] += least
            rest_longest[rows] = np.maximum(rest_longest[rows], least)
            key = self.keys(total[rows] + rest[rows], np.maximum(longest[rows], rest_longest[rows]))
            alive[rows] = (least <= self.limit) & (key <= most[panel[rows]])
        rows = np.flatnonzero(alive)
        panel, counts, combo, total, longest, rest, rest_longest = (x[rows] for x in (panel, counts, combo, total, longest, rest, rest_longest))
        if k < self.n:
            room = np.stack([self._fits(blocked[rows], panel, k, s) for s in range(self.limit + 1)], 1)
            least = np.where(room.any(1), room.argmax(1), self.limit + 1)
        else:
            room, least = np.ones((len(rows), 0), bool), np.zeros(len(rows), np.int64)
        key = self.keys(total + rest + least, np.maximum(np.maximum(longest, rest_longest), least))
        found = Prefixes(panel, counts, combo, total, longest, rest, rest_longest, room, key)
        return found.at(np.flatnonzero((key <= most[panel]) & (room.any(1) | (k == self.n))))

    def start(self, panel: np.ndarray, combo: np.ndarray, most: np.ndarray) -> Prefixes:
        """Given prefixes; those without an even combo go."""
        counts = np.zeros((len(panel), self.added.shape[3]), np.int64)
        for k in range(combo.shape[1]):
            fits = self._fits(self._blocked(counts), panel, k, combo[:, k])
            panel, combo, counts = panel[fits], combo[fits], counts[fits]
            counts = counts + self.added[panel, k, combo[:, k]]
        return self._bounded(panel, counts, combo, most)

    def grown(self, rows: Prefixes, most: np.ndarray) -> Prefixes:
        """The prefixes with one sequence more."""
        i, s = np.nonzero(rows.room)
        key = self.keys(rows.total[i] + s + rows.rest[i], np.maximum(np.maximum(rows.longest[i], rows.rest_longest[i]), s))
        kept = key <= most[rows.panel[i]]
        i, s = i[kept], s[kept]
        panel, k = rows.panel[i], rows.combo.shape[1]
        combo = np.concatenate([rows.combo[i], s[:, None]], 1)
        return self._bounded(panel, rows.counts[i] + self.added[panel, k, s], combo, most)

    def beam(self) -> np.ndarray:
        """The key of a good combo per panel, the bound that the search starts with; NONE where the beam finds none."""
        best = np.full(len(self.added), NONE)
        for first in range(0, len(best), PANELS):
            panel = np.arange(first, min(first + PANELS, len(best)))
            rows = self.start(panel, np.zeros((len(panel), 0), np.int64), best)
            for _ in range(self.n):
                rows = self.grown(rows, best)
                rows = rows.at(np.lexsort((rows.key, rows.panel)))
                rank = np.arange(len(rows)) - np.searchsorted(rows.panel, rows.panel)
                rows = rows.at(np.flatnonzero(rank < BEAM))
            np.minimum.at(best, rows.panel, rows.key)
        return best

    def least(self, panel: np.ndarray, combo: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(panel, combo): the least combos, and of these the least by reversed digits, that begin with the given prefixes."""
        most, best = most.copy(), {}
        stack = [self.start(panel, combo, most)]
        while stack:
            rows = stack.pop()
            rows = rows.at(np.flatnonzero(rows.key <= most[rows.panel]))
            if rows.combo.shape[1] == self.n:
                order = np.lexsort((*rows.combo.T, rows.key, rows.panel))
                rows = rows.at(order[np.flatnonzero(np.diff(rows.panel[order], prepend=-1))])
                for p, key, digits in zip(rows.panel.tolist(), rows.key.tolist(), rows.combo, strict=True):
                    best[p] = min(best.get(p, (NONE, ())), (key, tuple(digits[::-1].tolist())))
                np.minimum.at(most, rows.panel, rows.key)
                continue
            if len(rows) > BLOCK:
                # the best ones are grown first
                rows = rows.at(np.argsort(-rows.key, kind="stable"))
                stack += [rows.at(slice(at, at + BLOCK)) for at in range(0, len(rows), BLOCK)]
            elif len(rows):
                stack.append(self.grown(rows, most))
        for p, (_, digits) in best.items():
            yield p, np.array(digits[::-1], np.int64)
