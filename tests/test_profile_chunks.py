"""Consensus chunks, and tiles of all pairs: any size gives the same result."""

import random

from pyspark.sql import functions as F

from oligoweave.functions import sequence as S
from oligoweave.operators import multiplex as M
from oligoweave.operators import profile as P
from oligoweave.operators import spacers as H


def test_spans_from_chunks_equal_slices(spark):
    rng = random.Random(1)
    whole = {a: "".join(rng.choice("ACGT-") for _ in range(n)) for a, n in ((1, 100), (2, 7), (3, 64))}
    profile = spark.createDataFrame(
        [(a, i, b, 50.0) for a, bases in whole.items() for i, b in enumerate(bases)], "aln_id int, pos int, cons_base string, conservation double"
    )
    spans = [(a, rng.randrange(n), rng.randrange(1, 60)) for a, n in ((1, 100), (2, 7), (3, 64)) for _ in range(40)]
    for size in (1, 8, 64, 4096):
        chunks = P.consensus_chunks(profile, size)
        assert chunks.agg(F.max(F.length("bases"))).first()[0] <= size
        got = P.consensus_spans(spark.createDataFrame(spans, "aln_id int, start int, len int"), chunks, size).collect()
        assert {tuple(r) for r in got} == {(a, s, n, whole[a][s : s + n]) for a, s, n in spans}
        assert {r.aln_id: r.consensus for r in P.consensus_string(profile, size).collect()} == whole


def test_tiles_of_any_size_give_all_pairs(spark):
    rng = random.Random(2)
    rows = [(p, i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(8, 30)))) for p, n in ((1, 23), (2, 1), (3, 6)) for i in range(n)]
    oligos = spark.createDataFrame(rows, "panel_id int, idx int, primer string")
    want = None
    for size in (1, 4, 256):
        got = {tuple(r) for r in M.all_pairs_energy(oligos, ["panel_id"], size).collect()}
        assert len(got) == 23 * 24 // 2 + 1 + 21 and all(i <= j for _, i, j, _ in got)
        assert want is None or got == want
        want = got
    seqs = {(p, i): s for p, i, s in rows}
    some = rng.sample(sorted(want), 25)
    df = spark.createDataFrame([(seqs[p, i], seqs[p, j], e) for p, i, j, e in some], "a string, b string, e double")
    assert all(r.e == r.again for r in df.select("e", S.dimer_energy("a", "b").alias("again")).collect())


def test_a_tile_travels_once_for_each_it_meets(spark):
    oligos = spark.range(2000).select(F.lit(1).alias("panel_id"), F.col("id").cast("int").alias("idx"), F.lit("ACGTACGT").alias("primer"))
    tiles = M.tiled(oligos, ["panel_id"], F.col("primer"), 256)
    assert tiles.count() == 8 and tiles.agg(F.max(F.size("members"))).first()[0] == 256


def test_tiles_of_sets_meet_all_partners(spark):
    rows = [(locus, s, k) for locus, n in ((1, 5), (2, 1), (3, 9)) for s in range(n) for k in range(2)]
    sets = spark.createDataFrame(rows, "locus int, set_no int, k int")
    fewer = sets.where("locus < 3 or set_no % 4 = 1")
    want = {(x[0], *x[1:], *y[1:]) for x in rows for y in map(tuple, fewer.collect()) if x[0] == y[0]}
    for size in (1, 4, 16):
        got = H.tile_pairs(sets, fewer, ["locus"], size).select("locus", "f.set_no", "f.k", F.col("r.set_no").alias("s2"), F.col("r.k").alias("k2")).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
