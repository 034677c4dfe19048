"""Operators on small literal inputs, with brute force where the search is large."""

import itertools
from math import ceil

import pytest
from pyspark.sql import functions as F

from oligoweave.operators import batch as B
from oligoweave.operators import candidates as C
from oligoweave.operators import balance
from oligoweave.operators import multiplex as M
from oligoweave.operators import profile as P
from oligoweave.operators import ranking as W
from oligoweave.operators import scoring as G
from oligoweave.operators import spacers as H
from oligoweave.sources import reports as R
from oligoweave.sources.alignments import scan_alignments, scan_block_alignment, scan_fasta
from oligoweave.sources.lines import carry_down
from oligoweave.sources.sinks import append_run_log
from oligoweave.streaming.ingest import append_batches, stream_fasta

KNOWN = ["AAAAAAAAAAAAAAAA", "TTTTAAAAAAAAAAAA", "CCCCCCCCAAAAAAAA", "GGGGCCCCGGGGAAAA"]


def alignment(spark, seqs, aln="a"):
    return spark.createDataFrame(
        [(aln, i, f"s{i}", s) for i, s in enumerate(seqs)], "aln_id string, seq_idx int, name string, seq string"
    )


def test_profile_literals(spark):
    rows = {r.pos: r for r in P.profile(alignment(spark, KNOWN)).collect()}
    assert [rows[p].conservation for p in range(4)] == [25.0] * 4
    assert [rows[p].conservation for p in range(12, 16)] == [100.0] * 4
    gaps = ["GG-T--CCC", "GC-T-CCCC", "GT-NTCCCC", "GAANTTCCA"]
    rows = {r.pos: r for r in P.profile(alignment(spark, gaps)).collect()}
    assert (rows[0].conservation, rows[1].conservation, rows[2].conservation) == (100.0, 25.0, 25.0)
    assert (rows[0].pct_gap, rows[2].pct_gap) == (0.0, 75.0)
    assert [rows[p].pct_missed for p in (0, 2, 4, 5)] == [0.0, 25.0, 50.0, 25.0]


def test_sliding_profile_crosses_chunks(spark, monkeypatch):
    profiles = P.profile(alignment(spark, ["ACGTACGTACGTACGTACGTA", "AAGTACTTACGGACGTACGTC"]))
    whole = {r.pos: r.mean_value for r in P.sliding_profile(profiles, "conservation", 4).collect()}
    monkeypatch.setattr(P, "CHUNK", 5)
    cut = {r.pos: r.mean_value for r in P.sliding_profile(profiles, "conservation", 4).collect()}
    assert cut == whole and sorted(cut) == list(range(17))


def test_pair_enumeration_count(spark):
    """99..149 forward, 399..449 reverse, amplicons 285..315: 1340 pairs per length pair."""
    window = spark.createDataFrame(
        [(1, "t", 99, 149, 399, 449, 285, 316, [20, 21, 22], [20, 21, 22])],
        "panel_id int, target string, f_lo int, f_hi int, r_lo int, r_hi int, amp_lo int, amp_hi int, f_lens array<int>, r_lens array<int>",
    ).withColumn("aln_id", F.lit(1))
    assert C.count_pairs(window).first().n_pairs == 12060

    def side(name, lo, hi):
        return spark.range(lo, hi + 1).select(
            F.lit(1).alias("panel_id"), F.lit("t").alias("target"), F.lit(name).alias("side"), F.col("id").cast("int").alias("five_p"),
            F.explode(F.array(*[F.lit(x) for x in (20, 21, 22)])).alias("len"), F.lit("A").alias("seq"), F.lit(1.0).alias("weighted"),
            F.lit(1.0).alias("mean_cons"), F.lit(1.0).alias("tm"), F.lit(True).alias("gc_end"),
        )

    pairs = C.enumerate_pairs(window, side("F", 99, 149).unionByName(side("R", 399, 449)))
    assert pairs.count() == pairs.distinct().count() == 12060


def test_interval_pairs_across_buckets(spark):
    rows = [(1, 1, f"t{i}", 130 * i, 130 * i + 140, False) for i in range(12)]
    regions = spark.createDataFrame(
        rows, "panel_id int, aln_id int, target string, designated_start int, designated_end int, overlap_ignore boolean"
    )
    got = {(r.first_target, r.second_target) for r in C.interval_overlap_join(regions, 5).collect()}
    assert got == {(f"t{i}", f"t{i + 1}") for i in range(11)}


def test_length_walk_stops_on_cycles(spark):
    steps = [(1, "t", 10, 10, 11, 10, 0), (1, "t", 11, 10, 10, 10, 3), (1, "u", 10, 10, 10, 10, 5), (1, "v", 10, 10, 9, 10, 4)]
    df = spark.createDataFrame(
        steps, "panel_id int, target string, f_try int, r_try int, f_next int, r_next int, good bigint"
    ).withColumn("ideal_binding_size", F.lit(10))
    got = {r.target: (r.found, r.f_try, r.r_try) for r in G.adjusted_lengths(df).collect()}
    assert got["t"] == (True, 11, 10) and got["u"] == (True, 10, 10)
    assert got["v"] == (False, None, None)


@pytest.mark.parametrize(
    "counts,want",
    [((0, 0, 0, 0, 4), 100), ((5, 5, 2, 10, 0), 256130), ((0, 0, 0, 1, 1), 2500), ((0, 0, 1, 1, 1), 37037),
     ((6, 1, 2, 3, 4), 390625), ((0, 1, 1, 1, 1), 390625), ((4, 1, 1, 1, 1), 390625)],
)
def test_column_diversity_literals(spark, counts, want):
    u, *bases = (F.lit(c).cast("bigint") for c in counts)
    assert spark.range(1).select(M.column_diversity(u, F.array(*bases)).alias("d")).first().d == want


def test_min_diversity_literals(spark):
    rows = [(["ATCGATCGA"] * 4, s, w) for s, w in (([0, 1, 0, 1], 2500), ([0, 1, 2, 3], 390625))]
    df = spark.createDataFrame(rows, "seqs array<string>, s array<int>, want bigint")
    for r in df.select("want", M.min_diversity(F.col("seqs"), F.col("s"), F.lit(6)).alias("d")).collect():
        assert r.d == r.want


def test_compositions_order_and_ranges(spark):
    req = spark.createDataFrame([(1, 3, 3)], "panel_id int, limit int, total int")
    rows = balance.fixed_total_compositions(req, 3, "limit", "total").orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(10)) and [r.combo for r in rows] == sorted((r.combo for r in rows), key=lambda c: c[::-1])
    parts = balance.compositions_at(req, 3, "limit", "total", 5).orderBy("part").collect()
    assert [r.combo for r in parts] == [[3, 0, 0], [1, 2, 0], [2, 0, 1], [0, 2, 1], [0, 1, 2]]
    assert [r.range_size for r in parts] == [2] * 5


def brute_diversity(seqs, combo, n_hetero):
    worst = 25**4
    for col in range(n_hetero):
        counts = {b: 0 for b in "ATCG"}
        free = 0
        for q, s in zip(seqs, combo):
            if col < s:
                free += 1
            else:
                counts[q[col - s]] += 1
        values = sorted(counts.values())
        for _ in range(free):
            values[0] += 1
            values.sort()
        product = 1.0
        for v in values:
            product *= max(v / len(seqs) * 100, 1)
        worst = min(worst, int(product + 1e-6))
    return worst


def test_balanced_search_matches_brute_force(spark):
    panels = [(1, ["ATGCATGCA", "ATGCATGCA", "ATGCATGCA", "ATGCATGCA"]), (2, ["AACCGGTTA", "ACGTACGTA", "TTGGCCAAT", "GATTACAGA"])]
    for n_hetero, limit in ((4, 4),):
        df = spark.createDataFrame(panels, "panel_id int, seqs array<string>")
        got = {r.panel_id: r for r in balance.balanced_spacer_search(df, n_hetero, limit).collect()}
        for panel, seqs in panels:
            good = [c for c in itertools.product(range(limit + 1), repeat=4) if brute_diversity(seqs, c, n_hetero) == 390625]
            best = min(good, key=lambda c: (sum(c), c[::-1]))
            assert tuple(got[panel].combo) == best and got[panel].n_balanced == len(good)


def test_four_copy_combos_match_brute_force(spark):
    seq, h = "GCCGGCATGGTCATGAAG", 8

    def clash(a, b):
        for p in range(h - b):
            q = p + b - a
            if q >= len(seq) or seq[q] == seq[p]:
                return True
        return False

    want = {
        c for c in itertools.combinations_with_replacement(range(h + 1), 4)
        if not any(clash(x, y) for x, y in itertools.combinations(c, 2))
    }
    df = spark.createDataFrame([(1, seq)], "seq_id int, seq string")
    got = {tuple(r) for r in H.spacer_length_combos(df, h, h).select(*H.COMBO).collect()}
    assert got == want and want


def test_random_spacers_keep_columns_distinct_and_avoid_repeats(spark):
    df = spark.createDataFrame([(1, "ATCGGATCTA"), (2, "GCCGGCATGGTCATGAAG")], "seq_id int, seq string")
    best = H.best_combo(H.spacer_length_combos(df, 6, 6))
    rows = H.random_spacer_sets(best, 5, "x").collect()
    assert len(rows) == 2 * 5 * 4
    for (_, _), group in itertools.groupby(sorted(rows, key=lambda r: (r.seq_id, r.set_id, r.k)), key=lambda r: (r.seq_id, r.set_id)):
        copies = [r.spacer + r.seq for r in group]
        for col in range(max(r.s4 for r in rows)):
            column = [c[col] for c in copies]
            assert len(set(column)) == 4 or col >= 6


def test_pool_energy_pairs_of_a_hot_pool(spark):
    oligos = spark.createDataFrame([(1, i, "ACGTTGCA"[i % 5 :]) for i in range(40)] + [(2, 0, "ACGT")], "panel_id int, idx int, primer string")
    rows = M.all_pairs_energy(oligos, ["panel_id"]).groupBy("panel_id").count().collect()
    assert {r.panel_id: r["count"] for r in rows} == {1: 40 * 41 // 2, 2: 1}


def test_pool_score_counts(spark):
    e = spark.createDataFrame([(1, i, j, float(-i - j)) for i in range(4) for j in range(i, 4)], "panel_id int, i int, j int, energy double")
    loci = spark.createDataFrame([(1, 2)], "panel_id int, n_loci int")
    assert M.pool_score(e, ["panel_id"], loci).first().score == -5.5
    single = spark.createDataFrame([(1, 1)], "panel_id int, n_loci int")
    assert M.pool_score(e, ["panel_id"], single).first().score == pytest.approx(-3.0)


def test_worst_share(spark):
    values = [3.0, -1.0, -4.0, 0.5, -2.0]
    k = ceil(len(values) / 4)
    want = sum(sorted(values)[:k]) / k
    got = spark.range(1).select(G.worst_share_mean(F.array(*[F.lit(v) for v in values])).alias("m")).first().m
    assert got == want


def test_n_lowest_first_occurrence(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 1, 4, 1, 0])], "run string, idx int, score int")
    assert [r.idx for r in W.n_lowest_overall(df, "score", ["idx"], 3).collect()] == [4, 1, 3]
    assert [r.idx for r in W.n_lowest(df, ["run"], "score", ["idx"], 2, highest=True).orderBy("position").collect()] == [0, 2]


def test_replicates_stop_after_successes(spark):
    rows = [(1, i, i % 3 != 0, f"m{i}") for i in range(12)] + [(2, 0, False, "x")]
    df = spark.createDataFrame(rows, "run int, rep int, ok boolean, message string")
    got = {r.run: r for r in B.replicate_summary(df, 4).collect()}
    assert (got[1].n_reps, got[1].n_success, got[1].n_failure, got[1].last_failure) == (6, 4, 2, "m3")
    assert (got[2].n_success, got[2].n_failure) == (0, 1)


REPORT = """Self-Dimers:

2 dimers for F12
  ATCG
  ||
 GCTA

ATCG
|||
  GCTA

0 dimers for R1
Cross Primer Dimers:
F1 with R10
F1 lead
   ATCG
   ||||
     GC

R2 with F3
R2 lead
ATCG
||
 GCTAGG

"""


def test_report_with_small_chunks(spark):
    lines = spark.createDataFrame(
        [("r", i, t) for i, t in enumerate(REPORT.split("\n"))], "file string, line_no bigint, text string"
    )
    homo = [tuple(r)[1:5] for r in R.parse_homodimers(lines).orderBy("ord").collect()]
    assert homo == [(12, True, -1, 2), (12, True, 2, 3)]
    hetero = [tuple(r)[1:5] for r in R.parse_heterodimers(lines).orderBy("ord").collect()]
    assert hetero == [(1, 10, 5, 4), (3, 2, 3, 2)]
    value = F.when(F.col("text").contains("dimers for"), F.col("line_no"))
    for chunk in (3, 1000):
        got = [r.h for r in carry_down(lines, value, "h", chunk).orderBy("line_no").collect()]
        assert got[:3] == [None, None, 2] and got[10] == 2 and got[11] == 11 and got[-1] == 11


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.fas").write_text(">first seq\nACGT\nAC-T\n>second\nACGTACGT\n")
    (folder / "two.fasta").write_text(">x\nTTTT\n")
    rows = scan_fasta(spark, str(folder)).orderBy("aln_id", "seq_idx").collect()
    assert [(r.aln_id.rsplit("/", 1)[1], *r[1:]) for r in rows] == [
        ("one.fas", 0, "first seq", "ACGTAC-T"), ("one.fas", 1, "second", "ACGTACGT"), ("two.fasta", 0, "x", "TTTT")
    ]
    out = str(tmp_path / "out")
    query = append_batches(
        stream_fasta(spark, str(folder)), lambda b, n: append_run_log(b, out, batch_id=n), str(tmp_path / "cp")
    )
    query.awaitTermination(120)
    assert {(r.name, r.seq) for r in spark.read.parquet(out).collect()} == {
        ("first seq", "ACGTAC-T"), ("second", "ACGTACGT"), ("x", "TTTT")
    }


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    rows, out = spark.range(3), str(tmp_path / "log")
    for batch in (0, 1, 1, 0):
        append_run_log(rows, out, batch_id=batch)
    assert spark.read.parquet(out).count() == 6


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for sub, base in (("a", "A"), ("b", "T")):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "aln.fasta").write_text(f">x\n{base}{base}\n>y\n{base}C\n")
        (tmp_path / sub / "aln.aln").write_text(f"CLUSTAL W\n\nx   {base}{base}\n\nx   GG\n")
    rows = scan_alignments(spark, str(tmp_path), "clustal").collect()
    got = sorted((*r.aln_id.split("/")[-2:], r.seq_idx, r.name, r.seq) for r in rows)
    assert got == [
        ("a", "aln.aln", 0, "x", "AAGG"), ("a", "aln.fasta", 0, "x", "AA"), ("a", "aln.fasta", 1, "y", "AC"),
        ("b", "aln.aln", 0, "x", "TTGG"), ("b", "aln.fasta", 0, "x", "TT"), ("b", "aln.fasta", 1, "y", "TC"),
    ]


def test_block_formats(spark, tmp_path):
    texts = {
        "clustal": "CLUSTAL W\n\na   ACGT\nb   AC-T\n    ** *\n\na   GG\nb   GC\n",
        "stockholm": "# STOCKHOLM 1.0\na   ACGT\nb   AC-T\n\na   GG\nb   GC\n//\n",
        "phylip-relaxed": " 2 6\na   ACGT\nb   AC-T\n\nGG\nGC\n",
    }
    for fmt, text in texts.items():
        folder = tmp_path / fmt
        folder.mkdir()
        (folder / "x.aln").write_text(text)
        rows = scan_block_alignment(spark, str(folder), fmt).orderBy("seq_idx").collect()
        assert [(r.name, r.seq) for r in rows] == [("a", "ACGTGG"), ("b", "AC-TGC")], fmt
