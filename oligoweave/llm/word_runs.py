"""Periodic runs of words: maximal stretches that repeat themselves with a smallest period.

The branching-tandem test on an enhanced suffix array. Of every LCP interval of depth d all
children but the largest are walked; a suffix i of them, with i + d or i - d in the interval
too (by the inverse suffix array), begins or follows a square of two times d words. Such a
square is branching if the word after it differs from the one that would go on with it.
Rotating a branching square to the left as long as the words allow gives the run that it
ends; squares of a multiple of a run's period end with it and are merged into it. Children
are ranges of the suffix array, so no tree nodes are made.

A run of MIN_LENGTH words or more consists of words in places where CORE words in a row
occur twice in the text: its period is at most half its length, so what is left beside one
period has MIN_LENGTH / 2 words at least. All other words are left out first, which is most
of a common text, and what is left is taken as pieces with a sign of its own after each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoweave.llm.chunks import text_blocks
from oligoweave.llm.common import free_names, rows_of, text_or_empty

MIN_LENGTH = 12
#: Places of suffixes that are looked at in one go.
SLICE = 2_000_000
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _numbered(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For n places: a number for each key that occurs twice or more among `keys` of places `at`, else -1."""
    out = np.full(n, -1)
    if len(keys):
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        number = np.cumsum(new) - 1
        out[at] = np.where(np.bincount(number)[number] > 1, number, -1)
    return out


def _both(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """Numbers of what is numbered `left` here and `right` `step` places on, -1 where either is not or the two occur once."""
    n = len(left)
    at = np.flatnonzero((left[: n - step] >= 0) & (right[step:] >= 0)) if n > step else np.zeros(0, np.int64)
    return _numbered(left[at] * (right.max(initial=0) + 1) + right[at + step], at, n)


def covered(symbols: np.ndarray, core: int) -> np.ndarray:
    """Which places lie within `core` symbols in a row that occur twice or more."""
    done, n = 0, len(symbols)
    powers = [_numbered(symbols, np.arange(n), n)]
    while 2 << (len(powers) - 1) <= core:
        powers.append(_both(powers[-1], powers[-1], 1 << (len(powers) - 1)))
    whole = None
    for k in range(len(powers) - 1, -1, -1):
        if core >> k & 1:
            whole = powers[k] if whole is None else _both(whole, powers[k], done)
            done += 1 << k
    edge = np.zeros(n + core + 1, np.int64)
    starts = np.flatnonzero(whole >= 0)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + core, -1)
    return np.cumsum(edge)[:n] > 0


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the LCP of each suffix with the one before; the last symbol must occur once.

    Prefixes double; only suffixes that still share one are sorted again. The ranks of each
    doubling are kept, and the LCP is read off them from the longest to the shortest.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    new = np.concatenate([[True], symbols[sa][1:] != symbols[sa][:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank.copy()], 1
    active = np.flatnonzero(~new | ~np.concatenate([new[1:], [True]]))
    while len(active):
        at = sa[active]
        key = rank[at] * n + rank[at + width]
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        sa[active] = at
        rank[at] = np.maximum.accumulate(np.where(new, active, 0))
        active = active[~new | ~np.concatenate([new[1:], [True]])]
        width *= 2
        if len(active):
            levels.append(rank.copy())
    lcp = np.zeros(n, np.int64)
    if n > 1:
        lower, upper = sa[:-1].copy(), sa[1:].copy()
        for level in range(len(levels) - 1, -1, -1):
            same = levels[level][lower] == levels[level][upper]
            step = same * (1 << level)
            lower += step
            upper += step
        lcp[1:] = lower - sa[:-1]
    return sa, rank, lcp


def small_children(lcp: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """All children but one largest of every LCP interval: first, end, interval's first and last place, depth; in slices."""
    out: list[tuple[int, int, int, int, int]] = []
    held = 0
    stack: list[tuple[int, list[int]]] = [(0, [0])]  # depth, where the children begin
    for k, depth in enumerate([*lcp[1:].tolist(), 0], 1):
        first = k - 1
        while stack[-1][0] > depth:
            d, begins = stack.pop()
            first = begins[0]
            ends = [*begins[1:], k]
            largest = max(range(len(begins)), key=lambda x: ends[x] - begins[x])  # noqa: B023
            for x, (a, b) in enumerate(zip(begins, ends, strict=True)):
                if x != largest:
                    out.append((a, b, first, k - 1, d))
                    held += b - a
            if held > SLICE:
                yield tuple(np.array(out, np.int64).T)
                out, held = [], 0
        if stack[-1][0] == depth:
            stack[-1][1].append(k)
        else:
            stack.append((depth, [first, k]))
    if out:
        yield tuple(np.array(out, np.int64).T)


def branching_squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and half lengths of the squares that the next symbol does not go on with, by end, then half length."""
    sa, isa, lcp = suffix_array(symbols)
    n, found = len(symbols), [np.zeros(0, np.int64)]
    for first, end, low, high, depth in small_children(lcp):
        size = end - first
        which = np.repeat(np.arange(len(size)), size)
        at = sa[first[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)]
        low, high, depth = low[which], high[which], depth[which]
        for start, other in ((at, at + depth), (at - depth, at - depth)):
            inside = other >= 0
            place = isa[np.where(inside, other, 0)]
            inside &= (place >= low) & (place <= high)
            i, d = start[inside], depth[inside]
            open_end = symbols[i + d] != symbols[i + 2 * d]
            found.append((i + 2 * d)[open_end] * n + d[open_end])
    ends, halves = np.divmod(np.unique(np.concatenate(found)), n)
    return ends - 2 * halves, halves


def rotated(symbols: np.ndarray, start: int, period: int) -> int:
    """How far to the left the square at `start` can be rotated: where its run begins."""
    step = 16
    while start > 0:
        a = max(0, start - step)
        differ = np.flatnonzero(symbols[a:start] != symbols[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, step * 4
    return start


def runs_of(symbols: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of `least` symbols or more; the last symbol must occur once."""
    out, ending, end = [], [], -1
    for i, d in zip(*(x.tolist() for x in branching_squares(symbols)), strict=True):
        if i + 2 * d != end:
            end, ending = i + 2 * d, []
        if any(d % q == 0 and s <= i for s, q in ending):
            continue
        start = rotated(symbols, i, d)
        ending.append((start, d))
        if end - start >= least:
            out.append((start, end, d))
    return out


def word_runs(texts: list[list], least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Per list of words its runs (start, length, period) of `least` words or more, by start, then period."""
    parts, base = [], 0
    for words in texts:
        number = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        base += len(number) + 1
        parts.append(np.array([base - 1]))  # a sign that occurs nowhere else
    symbols = np.concatenate([np.zeros(0, np.int64), *parts])
    starts = np.cumsum([0, *(len(words) + 1 for words in texts)])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kept = np.flatnonzero(covered(symbols, -(-least // 2))) if len(symbols) else symbols
    if not len(kept):
        return runs
    # a sign after each piece of words in a row
    piece_end = np.concatenate([kept[1:] != kept[:-1] + 1, [True]])
    slots = np.arange(len(kept)) + np.cumsum(piece_end) - piece_end
    pieces = np.full(slots[-1] + 2, -1)
    pieces[slots] = symbols[kept]
    gaps = np.flatnonzero(pieces < 0)
    pieces[gaps] = base + np.arange(len(gaps))
    place = np.zeros(len(pieces), np.int64)
    place[slots] = kept
    for start, end, period in runs_of(pieces, least):
        at = int(place[start])
        text = int(np.searchsorted(starts, at, side="right")) - 1
        runs[text].append((at - int(starts[text]), end - start, period))
    for found in runs:
        found.sort(key=lambda x: (x[0], x[2]))
    return runs


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """Per row of `df`: doc_id, n_words, runs (start word from 0, length, period; by start, then period), collapsed.

    Words stand between spaces and tabs, line ends and the like (U+0009 to U+000D). Runs have
    `least` words (2 or more) and two periods at least. `collapsed` has the words that no run
    holds after its first period, with one space between. A null text is empty: no words, no
    runs; repeated rows give equal rows; null ids stay null; an empty table gives no rows;
    other columns are left out. Every text is handled by itself, so none is ever grouped.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for block in text_blocks(texts):
                # bytes are split at these signs alone, strings at others too
                words = [texts[i].encode().split() for i in block]
                found = word_runs(words, least)
                kept = [b" ".join(without_repeats(w, x)).decode() for w, x in zip(words, found, strict=True)]
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(block)), pa.array([len(w) for w in words], pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return rows_of(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty()).mapInArrow(run, RUNS)


def with_planted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with a tenth of its texts, picked by the CRC-32 h of the id, made periodic from some word on.

    If h % 10 is 0, the words from word a on become those of one period p: a = g % n and
    p = 1 + (n - a) div (3 + g % 8) for n words and g = h div 10. Null ids are not picked.
    """
    words, n, g, a, p = free_names(df, "words", "n", "g", "a", "p")
    split = F.filter(F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    picked = F.crc32(F.col(id_col).cast("string")) % 10 == 0
    sized = df.withColumn(words, F.when(picked, split)).withColumns({n: F.size(words), g: F.floor(F.crc32(F.col(id_col).cast("string")) / 10)})
    some = F.col(n) > 0
    placed = sized.withColumn(a, F.when(some, F.col(g) % F.col(n)).cast("int"))
    placed = placed.withColumn(p, F.when(some, 1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8))).cast("int"))
    times = F.ceil((F.col(n) - F.col(a)) / F.col(p)).cast("int")
    periodic = F.flatten(F.array_repeat(F.slice(words, F.col(a) + 1, F.col(p)), times))
    text = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), F.col(a)), periodic), F.lit(1), F.col(n)), " ")
    return placed.withColumn(text_col, F.when(some, text).otherwise(F.col(text_col))).select(*df.columns)


def run_digests(found: DataFrame) -> DataFrame:
    """Of found runs: the number, the longest one (ties: least start, then period), and digests of all and of what is left."""
    order = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.withColumn("top", order)
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
