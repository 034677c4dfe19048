"""The threshold join and the length walk against every pair, one by one."""

import random

import pytest

from oligoweave.operators import candidates as C
from oligoweave.operators import length_walk as L
from oligoweave.operators import scoring as G
from oligoweave.operators import threshold_join as T
from pyspark.sql import functions as F

TARGET, PAIR = C.TARGET, G.PAIR
LIMITS = dict(
    f_lo=0, f_hi=30, r_lo=55, r_hi=90, min_reverse=46, max_forward=41, target_len_min=4, target_len_max=40, max_binding_target_len=75,
    binding_len_min=8, binding_len_max=12, ideal_binding_size=10, max_tm_deviation=12.0, primer_primer_distance=0,
)


def regions(spark, seed, panels=2, targets=2):
    rng = random.Random(seed)
    rows = []
    for p in range(panels):
        for t in range(targets):
            for side, places in (("F", range(0, 35)), ("R", range(53, 91))):
                for five_p in places:
                    for n in range(8, 13):
                        seq = "".join(rng.choice("ACGT") for _ in range(n))
                        rows.append((p, f"t{t}", side, five_p, n, seq, rng.choice([50.0, 80.0, 99.0]) + rng.random(), rng.gauss(25, 7), rng.random() < 0.7))
    return spark.createDataFrame(rows, "panel_id long, target string, side string, five_p int, len int, seq string, mean_cons double, tm double, gc_end boolean").withColumn(
        "weighted", F.col("mean_cons")
    ).withColumn("aln_id", F.lit(0).cast("long"))


def windows(spark, panels=2, targets=2, **changes):
    rows = [(p, f"t{t}") for p in range(panels) for t in range(targets)]
    return spark.createDataFrame(rows, "panel_id long, target string").select(
        *TARGET, F.lit(0).cast("long").alias("aln_id"), *(F.lit(v).alias(k) for k, v in (LIMITS | changes).items())
    )


ADAPTERS = [(0, "ACACTCTTTCC", "GTGACTGGAGT"), (1, "GGGTACCATGCCA", "TTTACGACGCAT"), (2, "ACG", "T")]


def adapters(spark, panels=2):
    rows = [(p, *a) for p in range(panels) for a in ADAPTERS]
    return spark.createDataFrame(rows, "panel_id long, i int, forward string, reverse string")


@pytest.mark.parametrize("n", [1, 25])
def test_threshold_join_equals_all_pairs(spark, n):
    singles, opened = regions(spark, 1).cache(), C.open_length_windows(windows(spark))
    got = T.best_pairs(opened, singles, adapters(spark), n).select(*TARGET, *PAIR, "adapter", "penalty").collect()
    every = G.scored_region_pairs(C.enumerate_pairs(opened, singles), adapters(spark)).cache()
    want = G.best_region_pairs(every, n).select(*TARGET, *PAIR, "adapter", "penalty").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert T.candidate_pairs(opened, singles, adapters(spark), n).count() < every.count() / 10


def test_few_and_no_pairs(spark):
    """Targets with fewer pairs than asked for give all they have; without a pair they give none."""
    singles = regions(spark, 2, 1, 1).where("(side = 'F' and five_p < 2) or (side = 'R' and five_p > 88)")
    opened = C.open_length_windows(windows(spark, 1, 1, max_binding_target_len=95, target_len_max=90))
    every = C.enumerate_pairs(opened, singles).count() * len(ADAPTERS)
    assert T.best_pairs(opened, singles, adapters(spark, 1), 10 ** 6).count() == every > 0
    assert T.best_pairs(C.open_length_windows(windows(spark, 1, 1, target_len_max=0)), singles, adapters(spark, 1), 5).count() == 0
    assert T.best_pairs(opened, singles.limit(0), adapters(spark, 1), 5).count() == 0


def test_bounds_lie_below_the_scores(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ACGTN" if i % 5 == 0 else "ACGT") for _ in range(rng.randrange(1, 15))), "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 15)))) for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(
        T.least_overlap(F.col("a"), F.col("b"), T.word_masks(F.col("a")), T.word_masks(G.S.reverse_complement(F.col("b")))).alias("bound"),
        F.coalesce(G.S.overlap_dimer_score("a", "b"), F.lit(0.0)).alias("score"),
    ).collect()
    assert all(r.bound <= r.score + 1e-9 for r in got) and sum(r.bound > 0.6 * r.score > 0 for r in got) > 200


@pytest.mark.parametrize(("low", "high", "limit"), [(25.0, 25.0, 12.0), (20.0, 31.0, 9.0), (24.0, 26.0, 1.0)])
def test_walk_counts_like_every_pair(spark, low, high, limit):
    singles = regions(spark, 4).cache()
    where = windows(spark, max_tm_deviation=limit)
    temperatures = spark.createDataFrame([(0, low, high), (1, low, high)], "panel_id long, tm_low double, tm_high double")
    walked = L.walked_lengths(where, singles, temperatures).collect()
    params = where.select("panel_id", "max_tm_deviation").distinct()
    grid = G.judged_pairs(C.enumerate_pairs(C.length_grid_windows(where), singles, ["f_try", "r_try"]), params, temperatures)
    counters = G.rejection_counters(grid, [*TARGET, "f_try", "r_try"]).cache()
    want = {(r.panel_id, r.target, r.f_try, r.r_try): tuple(r[c] for c in L.COUNTERS) for r in counters.collect()}
    for row in walked:
        assert row.steps
        for s in row.steps:
            assert want[row.panel_id, row.target, s.f_try, s.r_try] == tuple(s[c] for c in L.COUNTERS)
    sizes = where.select(*TARGET, "binding_len_min", "binding_len_max", "ideal_binding_size")
    steps = G.adjusted_lengths(G.next_lengths(counters.join(sizes, TARGET))).collect()
    assert sorted(tuple(r)[:5] for r in walked) == sorted(map(tuple, steps))


def test_walk_without_regions_or_temperatures(spark):
    where = windows(spark, 1, 2)
    temperatures = spark.createDataFrame([(0, 25.0, 25.0)], "panel_id long, tm_low double, tm_high double")
    none = regions(spark, 5, 1, 2).where("target = 't0'").withColumn("tm", F.when(F.col("five_p") % 2 == 0, F.col("tm")))
    rows = {r.target: r for r in L.walked_lengths(where, none, temperatures).collect()}
    assert not rows["t1"].found and rows["t1"].steps == [] and rows["t1"].f_try is None
    assert all(s.total >= s.good + s.n_no_gc for s in rows["t0"].steps)
