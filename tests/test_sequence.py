"""Sequence functions against literals and plain-Python brute force."""

import random

from pyspark.sql import functions as F

from oligoweave.functions import constants as C
from oligoweave.functions import sequence as S

SWAP = str.maketrans("ATCG", "TAGC")


def random_dna(rng, size):
    return "".join(rng.choice("ATCG") for _ in range(size))


def brute_overlap(a, b, f_skip, r_skip):
    if len(a) < len(b):
        a, b, f_skip, r_skip = b, a, r_skip, f_skip
    m, n = len(a), len(b)
    rc = b.translate(SWAP)[::-1]
    shifts = set(range(0, m - n)) | set(range(0, 1 - n + f_skip, -1)) | set(range(m - n, m - 1 - r_skip))
    total = run = 0
    for s in shifts:
        marks = "".join(
            "1" if 0 <= p - s < n and a[p] == rc[p - s] else "0" for p in range(m)
        )
        total = max(total, marks.count("1"))
        run = max([run, *map(len, marks.split("0"))])
    return total, run


def brute_energy(a, b):
    table = C.step_table()
    if len(a) < len(b):
        a, b = b, a
    rc = b.translate(SWAP)[::-1]
    best = 0
    for s in range(2 - len(b), len(a) - 1):
        energy, before = 0, False
        for p in range(max(0, s), min(len(a), len(b) + s)):
            paired = a[p] == rc[p - s]
            energy = energy + table[a[p - 1 : p + 1]][2] if paired and before else 0
            best, before = min(best, energy), paired
    return best / 100


def test_overlap_and_energy_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(120):
        a = random_dna(rng, rng.choice([0, 1, 2, 12, 30, 60, 63, 64, 90]))
        b = random_dna(rng, rng.choice([1, 2, 5, 20, 61, 63, 70]))
        rows.append((a, b, rng.randint(0, 6), rng.randint(0, 6)))
    df = spark.createDataFrame(rows, "a string, b string, f int, r int")
    got = df.select(
        "*",
        S.max_overlap_total("a", "b", "f", "r").alias("total"),
        S.max_overlap_run("a", "b", "f", "r").alias("run"),
        S.dimer_energy("a", "b").alias("energy"),
    ).collect()
    for row in got:
        assert (row.total, row.run) == brute_overlap(row.a, row.b, row.f, row.r)
        assert row.energy == brute_energy(row.a, row.b)


def test_overlap_literals(spark):
    cases = [
        ("AAAAA", "AAAAA", 0, 0, 0), ("AAAAA", "TTTTT", 0, 0, 5), ("AATT", "AATT", 0, 0, 4),
        ("ACAAGTGCTAGTAGCTGATCG", "TTGATGAGATCAATGCTGTAG"[::-1], 0, 0, 5),
        ("CTAGTACAAGTGAGCTGATCG", "TTGATGAATGCTGTAGGATCA"[::-1], 0, 0, 5),
        ("AKAAGTGCTNGTAGCTGATNG", "TTGATGAGANCAATGCTGTNG"[::-1], 0, 0, 5),
        ("CTAGTACAAGTGAGCTGTATA", "ATATTGAATGCTGTAGGATCA"[::-1], 5, 0, 4),
        ("CTAGTACAAGTGAGCTGTATA", "ATATTGAATGCTGTAGGATCA"[::-1], 0, 5, 5),
    ]
    df = spark.createDataFrame(cases, "a string, b string, f int, r int, want int")
    got = df.select("want", S.max_overlap_run("a", "b", "f", "r").alias("run")).collect()
    assert [r.run for r in got] == [r.want for r in got]


def test_contained_and_site_literals(spark):
    row = spark.createDataFrame([("ATCGA", "ATTCAGACC")], "o string, s string").select(
        S.max_contained_complementarity("o", "s").alias("best"),
        S.max_contained_complementarity("o", "o").alias("equal_lengths"),
        S.site_complementarity(F.lit("ATCG"), F.lit("TTAGCCC"), F.lit(1)).alias("site"),
        S.site_complementarity_run(F.lit("ATCG"), F.lit("TTAGCCC"), F.lit(1)).alias("run"),
    ).first()
    assert (row.equal_lengths, row.site, row.run) == (0, 4, 4)
    # TAGCT against ATTCA, TTCAG, TCAGA, CAGAC: 1, 1, 1, 2 matches (the last offset is not compared)
    assert row.best == 2


def test_melting_temperature_long_path_agrees(spark):
    rng = random.Random(2)
    seqs = [(random_dna(rng, n),) for n in (63, 64, 70)] + [("ACGNT",), ("A",)]
    got = spark.createDataFrame(seqs, "s string").select("s", S.melting_temperature("s").alias("tm")).collect()
    assert all(40 < r.tm < 90 for r in got[:3])
    assert got[3].tm is None and got[4].tm is None


def test_iupac(spark):
    row = spark.range(1).select(
        S.iupac_match_probability(F.lit("N"), F.lit("A")).alias("na"),
        S.iupac_match_probability(F.lit("R"), F.lit("Y")).alias("ry"),
        S.iupac_compatible(F.lit("R"), F.lit("W")).alias("rw"),
        S.same_base_unless_ignored(F.lit("I"), F.lit("I")).alias("ii"),
    ).first()
    assert (row.na, row.ry, row.rw, row.ii) == (0.25, 0.0, True, False)
