"""Even columns, compositions by number, and selection by counts against plain searches."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oligoweave.operators import balance as B
from oligoweave.operators import least_spacers as L
from oligoweave.operators import ranking as W


def even(seqs, combo, width):
    n = len(seqs)
    want = sorted([n // 4 + (i < n % 4) for i in range(4)])
    for col in range(width):
        counts, free = dict.fromkeys("ATCG", 0), 0
        for q, s in zip(seqs, combo, strict=True):
            if col < s:
                free += 1
            else:
                counts[q[col - s]] += 1
        values = sorted(counts.values())
        for _ in range(free):
            values[0] += 1
            values.sort()
        if values != want:
            return False
    return True


def panel_rows(rng, sizes, width):
    return [(i, ["".join(rng.choice("ATCG") for _ in range(width + 2)) for _ in range(n)]) for i, n in enumerate(sizes)]


@pytest.mark.parametrize(("width", "limit", "sizes"), [(4, 4, [1, 2, 3, 4, 5, 4]), (25, 3, [2, 3, 4]), (2, 2, [7, 8]), (1, 0, [4, 1])])
def test_even_combos_equal_brute_force(spark, width, limit, sizes):
    """Widths beyond one number too: 25 columns of four copies take two."""
    rows = panel_rows(random.Random(width), sizes, width)
    df = spark.createDataFrame(rows, "panel_id long, seqs array<string>")
    totals = {r.panel_id: r for r in B.smallest_total(df, width, limit).collect()}
    longest = {r.panel_id: r for r in B.smallest_longest(df, width, limit).collect()}
    counted = {r.panel_id: r.n_balanced for r in B.balanced_spacer_search(df, width, limit).collect()}
    for panel, seqs in rows:
        good = [c for c in itertools.product(range(limit + 1), repeat=len(seqs)) if even(seqs, c, width)]
        assert (panel in totals) == (panel in longest) == bool(good)
        if good:
            assert tuple(totals[panel].combo) == min(good, key=lambda c: (sum(c), c[::-1]))
            assert tuple(longest[panel].combo) == min(good, key=lambda c: (max(c), sum(c), c[::-1]))
            assert counted[panel] == len(good)


@pytest.mark.parametrize("longest", [False, True])
def test_bounds_lose_no_least_combo(longest):
    """Searched from pairs of first spacers, with bounds of a beam, as the queries do."""
    seqs = [q for _, q in panel_rows(random.Random(7), [5] * 6, 6)]
    columns = B.Columns(5, 6)
    search = L.Search(seqs, 5, 6, 6, columns.bits, columns.per, longest)
    pieces = [(p, a, b) for p in range(6) for a in range(7) for b in range(7)]
    found = {p: tuple(c.tolist()) for p, c in search.least(np.array([x[0] for x in pieces]), np.array([x[1:] for x in pieces]), search.beam())}
    for p, panel in enumerate(seqs):
        good = [c for c in itertools.product(range(7), repeat=5) if even(panel, c, 6)]
        assert found[p] == min(good, key=lambda c: (max(c) if longest else 0, sum(c), c[::-1]))


@pytest.mark.parametrize("longest", [False, True])
def test_wide_panels_are_searched_by_bounds(longest, monkeypatch):
    """Nine sequences, twelve columns: tens of thousands of prefixes, not tens of millions, and blocks of bounded size."""
    seqs = [q for _, q in panel_rows(random.Random(3), [9] * 4, 12)]
    grown, sizes = L.Search.grown, []
    monkeypatch.setattr(L.Search, "grown", lambda self, rows, most: (sizes.append(len(rows)), grown(self, rows, most))[1])
    columns = B.Columns(9, 12)
    search = L.Search(seqs, 9, 12, 12, columns.bits, columns.per, longest)
    found = dict(search.least(np.arange(4), np.zeros((4, 0), np.int64), search.beam()))
    assert len(found) == 4 and all(even(seqs[p], c.tolist(), 12) for p, c in found.items())
    assert sum(sizes) < 4 * 200_000 and max(sizes) <= L.BLOCK


def test_long_spacers_in_wide_panels(spark):
    """Shifts by more columns than one number holds."""
    seqs = ["A" * 40, "T" * 40, "C" * 40, "G" * 40]
    columns = B.Columns(4, 38)
    assert columns.words == 3
    for spacer in (0, 1, 14, 15, 16, 29, 30, 31, 38):
        df = spark.createDataFrame([(seqs, spacer)], "seqs array<string>, s int").withColumn("masks", columns.masks(F.col("seqs")))
        got = df.select(*columns.shifted(F.col("masks"), 1, F.col("s"))).first()
        for base in range(4):
            fields = [got[base * 3 + col // columns.per] >> (columns.bits * (col % columns.per)) & 15 for col in range(38)]
            assert fields == [int(base == 1 and col >= spacer) for col in range(38)]


def test_numbers_and_compositions(spark):
    for n, limit in ((1, 5), (3, 3), (4, 2)):
        want = {}
        for combo in itertools.product(range(limit + 1), repeat=n):
            want.setdefault(sum(combo), []).append(combo)
        rows = [(t, limit, t, i) for t, combos in want.items() for i in range(len(combos))]
        df = B.with_ways(spark.createDataFrame(rows, "panel_id int, limit int, total int, i int"), n, "limit", "total")
        got = df.withColumn("combo", B.composition_at(F.col("ways"), F.col("i"), n, F.col("limit"), F.col("total")))
        for r in got.withColumn("rank", B.rank_of(F.col("ways"), F.col("combo"), F.col("total"))).collect():
            combos = sorted(want[r.total], key=lambda c: c[::-1])
            assert tuple(r.combo) == combos[r.i] and r["rank"] == r.i and r.ways[n][r.total] == len(combos)


def test_draws_are_even(spark):
    df = spark.createDataFrame([(i, 4) for i in range(40)], "panel_id int, total int")
    drawn = [tuple(r.combo) for r in B.drawn_compositions(df, 3, 3, 50, "seed").collect()]
    counts = Counter(drawn)
    assert len(drawn) == 2000 and len(counts) == 12 and all(sum(c) == 4 and max(c) <= 3 for c in counts)
    assert max(counts.values()) < 2 * min(counts.values())


def test_sampled_search_finds_what_can_be_found(spark):
    rows = panel_rows(random.Random(1), [3, 4], 3)
    df = spark.createDataFrame(rows, "panel_id long, seqs array<string>")
    got = {r.panel_id: r for r in B.sampled_search(df, 3, 3, 400, "seed").collect()}
    for panel, seqs in rows:
        best = min(c for c in itertools.product(range(4), repeat=len(seqs)) if even(seqs, c, 3))
        assert even(seqs, got[panel].combo, 3) and len(got[panel].combo) == len(best)


def test_lowest_by_counts(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(6), i) for g in range(4) for i in range(50 * g + 1)]
    df = spark.createDataFrame(rows, "g int, score int, i int")
    sizes = spark.createDataFrame([(0, 5), (1, 0), (2, 20), (3, 40)], "g int, k int")
    kept = {(r.g, r.i) for r in W.lowest_by_counts(df, ["g"], "score", "i", sizes.withColumn("k", F.col("k").cast("long")), "k").collect()}
    want = {(g, i) for g, k in sizes.collect() for _, s, i in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))[:k]}
    assert kept == want
    means = {r.g: r.mean for r in W.mean_of_lowest(df, ["g"], "score", sizes, "k").collect()}
    for g, k in ((2, 20), (3, 40), (0, 5)):
        low = sorted(r[1] for r in rows if r[0] == g)[:k]
        assert means[g] == pytest.approx(sum(low) / len(low))


def test_panels_of_no_rows(spark):
    none = spark.createDataFrame([], "panel_id long, seqs array<string>")
    assert B.smallest_total(none, 3, 2).collect() == [] and B.smallest_longest(none, 3, 2).collect() == []
    assert B.spacer_landscape(none, 3, 2).collect() == []
