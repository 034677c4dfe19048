"""Adjusts the binding lengths of each target by its rejections, without making its pairs.

Whether a pair is rejected, and why, depends on its two melting temperatures and its
amplicon. For a forward region the reverse regions of each verdict are ranges of places and
of temperature ranks, so cumulative counts over (place, rank) answer with a few lookups.
The counts of a reverse length serve every forward length, and only lengths that a target
comes by are counted. A target is one row: its regions, at most window times lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoweave.functions import constants as C

TARGET = ["panel_id", "target"]
REASONS = ("f_high", "f_low", "r_high", "r_low")
COUNTERS = ("total", "good", *(f"n_{x}" for x in REASONS), "n_no_gc")
REGIONS = "array<struct<five_p:int,len:int,tm:double,gc_end:boolean>>"
STEPS = "array<struct<f_try:int,r_try:int," + ",".join(f"{x}:bigint" for x in COUNTERS) + ">>"


def deviations(tm: np.ndarray, low: float, high: float) -> np.ndarray:
    """Signed largest deviation from any temperature in [low, high]."""
    above, below = tm - low, tm - high
    return np.where(np.abs(above) >= np.abs(below), above, below)


class Reverse:
    """Reverse regions of one length: counts over places and temperature ranks.

    ``rows[p, k]`` counts regions at the first p places with a rank below k; ``clamped`` those
    of them with a GC clamp. Regions without a temperature are in no rank.
    """

    def __init__(self, places: np.ndarray, tm: np.ndarray, clamp: np.ndarray, low: float, high: float, limit: float):
        order = np.argsort(places)
        self.places, tm, clamp = places[order], tm[order], clamp[order]
        known = ~np.isnan(tm)
        ranked = np.flatnonzero(known)[np.argsort(tm[known], kind="stable")]
        self.tm = tm[ranked]
        self.deviation = deviations(self.tm, low, high)
        cells = np.zeros((len(tm) + 1, len(ranked) + 1), np.int32)
        cells[ranked + 1, np.arange(1, len(ranked) + 1)] = 1
        self.rows = cells.cumsum(0).cumsum(1)
        cells[ranked + 1, np.arange(1, len(ranked) + 1)] = clamp[ranked]
        self.clamped = cells.cumsum(0).cumsum(1)
        self.cold = int(np.searchsorted(self.deviation, -limit, "left"))
        self.hot = int(np.searchsorted(self.deviation, limit, "right"))
        # from a hotter forward region the pair deviates more than the reverse region itself; and from a colder one
        self.below = self.tm + self.deviation
        self.middle = int(np.searchsorted(np.abs(self.tm - low) >= np.abs(self.tm - high), True)) if len(self.tm) else 0


def rejections(f_places: np.ndarray, f_tm: np.ndarray, f_clamp: np.ndarray, reverse: Reverse, window: dict) -> dict[str, int]:
    """Pairs of forward regions with one length of reverse regions inside the window, by verdict."""
    low, high, limit = window["tm_low"], window["tm_high"], window["limit"]
    start = np.searchsorted(reverse.places, np.maximum(window["r_lo"], f_places + window["amp_lo"] - 1), "left")
    end = np.searchsorted(reverse.places, np.minimum(window["r_hi"], f_places + window["amp_hi"] - 2), "right")
    end = np.maximum(start, end)
    counts = {"total": int((end - start).sum())}
    known = ~np.isnan(f_tm)
    tm, clamp, start, end = f_tm[known], f_clamp[known], start[known], end[known]
    n = len(reverse.tm)

    def within(rows: np.ndarray, first, last) -> np.ndarray:
        """Regions of each forward region's places with a rank from first on and before last."""
        last = np.maximum(first, last)
        return rows[end, last] - rows[start, last] - rows[end, first] + rows[start, first]

    own = deviations(tm, low, high)
    out = np.abs(own) > limit
    every = within(reverse.rows, 0, np.full(len(tm), n))
    near = np.searchsorted(reverse.tm, tm - limit, "left"), np.searchsorted(reverse.tm, tm + limit, "right")
    fits = np.maximum(near[0], reverse.cold), np.minimum(near[1], reverse.hot)
    in_range = np.where(out, 0, within(reverse.rows, *fits))
    counts["good"] = int(np.where(out | ~clamp, 0, within(reverse.clamped, *fits)).sum())
    counts["n_no_gc"] = int(in_range.sum()) - counts["good"]
    # pairs that are further apart than either is off: ranks below `left`, and from `right` to `to`
    apart = np.maximum(limit, own)
    left = np.minimum(np.searchsorted(reverse.tm, tm - apart, "left"), np.searchsorted(reverse.below, tm, "left"))
    right = np.searchsorted(reverse.tm, tm + apart, "right")
    to = np.where(tm < low, n, np.where(tm < high, reverse.middle, 0))
    hotter = np.searchsorted(reverse.deviation, own, "left")  # ranks below are less hot than the forward region

    def far(first, last) -> np.ndarray:
        """Those pairs with a rank from first on and before last."""
        return within(reverse.rows, first, np.minimum(left, last)) + within(reverse.rows, np.maximum(right, first), np.minimum(to, last))

    zero, all_ranks = np.zeros(len(tm), np.int64), np.full(len(tm), n)
    counts["n_f_high"] = int(np.where(out & (own > 0), every, far(zero, hotter)).sum())
    counts["n_f_low"] = int(np.where(out & (own <= 0), every, far(hotter, all_ranks)).sum())
    cold, hot = np.full(len(tm), reverse.cold), np.full(len(tm), reverse.hot)
    counts["n_r_high"] = int((within(reverse.rows, hot, all_ranks) + far(hotter, hot)).sum())
    counts["n_r_low"] = int((within(reverse.rows, zero, cold) + far(cold, hotter)).sum())
    return counts


class Lengths:
    """The regions of one target by length, and the counters of lengths that were asked for."""

    def __init__(self, row: dict):
        self.row = row
        self.sides: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
        for side in "FR":
            places = np.array([x["five_p"] for x in row[side]], np.int64)
            lengths = np.array([x["len"] for x in row[side]], np.int64)
            tm = np.array([x["tm"] for x in row[side]], float)
            clamp = np.array([bool(x["gc_end"]) for x in row[side]], bool)
            for n in np.unique(lengths).tolist():
                own = lengths == n
                self.sides[side, n] = places[own], tm[own], clamp[own]
        self.reverse: dict[int, Reverse] = {}

    def counters(self, f_try: int, r_try: int) -> dict[str, int] | None:
        """None where there is no pair of these lengths."""
        row, forward = self.row, self.sides.get(("F", f_try))
        if forward is None or ("R", r_try) not in self.sides:
            return None
        if r_try not in self.reverse:
            self.reverse[r_try] = Reverse(*self.sides["R", r_try], row["tm_low"], row["tm_high"], row["max_tm_deviation"])
        ideal, both = row["ideal_binding_size"], f_try + r_try
        core = row["min_reverse"] - row["max_forward"] - 1
        window = {
            "r_lo": row["r_lo"] + r_try - ideal, "r_hi": row["r_hi"], "amp_lo": max(row["target_len_min"], core) + both,
            "amp_hi": min(row["target_len_max"] + both + 1, row["max_binding_target_len"]),
            "tm_low": row["tm_low"], "tm_high": row["tm_high"], "limit": row["max_tm_deviation"],
        }
        places, tm, clamp = forward
        own = (places >= row["f_lo"]) & (places <= row["f_hi"] - (f_try - ideal))
        found = rejections(places[own], tm[own], clamp[own], self.reverse[r_try], window)
        return found if found["total"] else None


def next_length(counts: dict[str, int], side: str, now: int, low: int, high: int) -> tuple[bool, int]:
    """Whether a side calls for another length, and which one it would take."""
    net = counts[f"n_{side}_high"] - counts[f"n_{side}_low"]
    off = abs(net) / counts["total"] * 100 > C.RETRY_PERCENT
    moved = now + (0 if not off else -1 if net > 0 else 1)
    return off and low < now < high, moved if low <= moved <= high else now


def walk(row: dict) -> tuple[tuple[int, int] | None, list[dict]]:
    """The lengths that a target ends at, and the counters of all that it came by.

    From the ideal lengths on, until nothing calls for a move, lengths have no pair, or they
    come up again. Of those visited the last with a valid pair counts; the ideal ones only
    if nothing called for a move.
    """
    lengths, low, high = Lengths(row), row["binding_len_min"], row["binding_len_max"]
    at, best, seen, steps = (row["ideal_binding_size"],) * 2, None, [], []
    while (counts := lengths.counters(*at)) is not None:
        steps.append({"f_try": at[0], "r_try": at[1], **counts})
        (f_calls, f_to), (r_calls, r_to) = (next_length(counts, side, now, low, high) for side, now in zip("fr", at, strict=True))
        onward = (f_to, r_to) if f_calls or r_calls else at
        stop = onward == at or onward in seen
        if counts["good"] and (seen or stop):
            best = at
        if stop:
            break
        seen.append(at)
        at = onward
    return best, steps


def walked_lengths(windows: DataFrame, singles: DataFrame, temperatures: DataFrame) -> DataFrame:
    """Per target of ``windows``: f_try, r_try, found, and the counters of every pair of lengths visited (``steps``)."""
    region = F.struct("five_p", "len", "tm", "gc_end")
    sides = singles.groupBy(*TARGET).agg(*(F.collect_list(F.when(F.col("side") == side, region)).alias(side) for side in "FR"))
    columns = [
        "f_lo", "f_hi", "r_lo", "r_hi", "min_reverse", "max_forward", "target_len_min", "target_len_max", "max_binding_target_len",
        "binding_len_min", "binding_len_max", "ideal_binding_size", "max_tm_deviation",
    ]
    none = F.array().cast(REGIONS)
    rows = (
        windows.select(*TARGET, *columns).join(temperatures, "panel_id").join(sides, TARGET, "left")
        .withColumns({side: F.coalesce(F.col(side).cast(REGIONS), none) for side in "FR"})
    )
    kinds = {f.name: f.dataType.simpleString() for f in windows.select(*TARGET).schema}
    schema = f"panel_id {kinds['panel_id']}, target {kinds['target']}, f_try int, r_try int, found boolean, steps {STEPS}"
    step_type = pa.list_(pa.struct([("f_try", pa.int32()), ("r_try", pa.int32()), *((x, pa.int64()) for x in COUNTERS)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walked = [walk(row) for row in batch.to_pylist()]
            ends = [best or (None, None) for best, _ in walked]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("panel_id"), batch.column("target"), pa.array([x for x, _ in ends], pa.int32()), pa.array([x for _, x in ends], pa.int32()),
                    pa.array([best is not None for best, _ in walked], pa.bool_()), pa.array([steps for _, steps in walked], step_type),
                ],
                ["panel_id", "target", "f_try", "r_try", "found", "steps"],
            )

    return rows.mapInArrow(run, schema)
