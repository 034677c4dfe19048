"""Registered profiling queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoweave.operators import profile as P
from oligoweave.plans import views as V
from oligoweave.plans.views import duck_with

WIDTH = 10


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region per document, on the alignment the document belongs to."""
    d = F.col("doc_id")
    start = F.pmod(d * 7, F.lit(80)).cast("int")
    return V.table(spark, sf_dir, "documents").select(
        d.alias("region_id"),
        F.floor(d / V.ALIGNMENT_ROWS).cast("bigint").alias("aln_id"),
        start.alias("start"),
        (start + 5 + F.pmod(d, F.lit(9)).cast("int")).alias("stop"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One primer pair per document."""
    d = F.col("doc_id")
    f_5p = F.pmod(d, F.lit(30)).cast("int")
    return V.table(spark, sf_dir, "documents").select(
        d.alias("pair_id"),
        F.floor(d / V.ALIGNMENT_ROWS).cast("bigint").alias("aln_id"),
        f_5p.alias("f_5p"),
        (8 + F.pmod(d, F.lit(5))).cast("int").alias("f_len"),
        (f_5p + 40 + F.pmod(d, F.lit(20)).cast("int")).alias("r_5p"),
        (8 + F.pmod(d, F.lit(4))).cast("int").alias("r_len"),
    )


V.DUCK["v_regions"] = """
SELECT doc_id AS region_id, doc_id//125 AS aln_id, CAST(doc_id*7%80 AS INTEGER) AS start,
  CAST(doc_id*7%80 + 5 + doc_id%9 AS INTEGER) AS stop FROM documents"""
V.DUCK["v_pairs"] = """
SELECT doc_id AS pair_id, doc_id//125 AS aln_id, CAST(doc_id%30 AS INTEGER) AS f_5p, CAST(8+doc_id%5 AS INTEGER) AS f_len,
  CAST(doc_id%30+40+doc_id%20 AS INTEGER) AS r_5p, CAST(8+doc_id%4 AS INTEGER) AS r_len FROM documents"""


def ragged(spark, sf_dir):
    """Alignments in which some sequences lost their last residue."""
    cut = F.pmod("seq_idx", F.lit(37)) == 5
    return V.alignments(spark, sf_dir).withColumn(
        "seq", F.when(cut, F.left("seq", F.lit(V.ALIGNMENT_WIDTH - 1))).otherwise(F.col("seq"))
    )


def profiles(spark, sf_dir):
    return P.profile(V.alignments(spark, sf_dir))


def primers(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select(
        (F.col("pair_id") * 2).alias("primer_id"), "aln_id", F.col("f_5p").alias("five_p"),
        F.col("f_len").alias("len"), F.lit(False).alias("is_reverse"),
    ).unionByName(
        p.select(
            (F.col("pair_id") * 2 + 1).alias("primer_id"), "aln_id", F.col("r_5p").alias("five_p"),
            F.col("r_len").alias("len"), F.lit(True).alias("is_reverse"),
        )
    )


def wide_regions(spark, sf_dir):
    """Regions of which some start before or end after the alignment."""
    return regions(spark, sf_dir).select(
        "region_id", "aln_id", (F.col("start") - 3).alias("start"), (F.col("stop") + 4).alias("stop")
    )


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


QUERIES = {
    "alignment_length_check": lambda s, d: P.alignment_length_check(ragged(s, d)),
    "explode_alignment": lambda s, d: P.explode_alignment(V.alignments(s, d)),
    "column_base_counts": lambda s, d: P.column_base_counts(V.alignments(s, d)),
    "column_consensus": lambda s, d: P.column_consensus(
        P.column_base_counts(V.alignments(s, d))
    ).select("aln_id", "pos", "cons_base", "n_cons"),
    "column_conservation": lambda s, d: profiles(s, d).select("aln_id", "pos", *six("conservation")),
    "column_gap_pct": lambda s, d: profiles(s, d).select("aln_id", "pos", *six("pct_gap")),
    "column_missed_pct": lambda s, d: profiles(s, d).select("aln_id", "pos", *six("pct_missed")),
    "sliding_profile": lambda s, d: P.sliding_profile(profiles(s, d), "conservation", WIDTH).select(
        "aln_id", "pos", *six("mean_value")
    ),
    "consensus_string": lambda s, d: P.consensus_string(profiles(s, d)).select(
        "aln_id", "consensus", *six("mean_conservation")
    ),
    "region_total_conservation": lambda s, d: P.region_total_conservation(
        regions(s, d), profiles(s, d)
    ).select("region_id", *six("total_conservation")),
    "region_mean_conservation": lambda s, d: P.region_total_conservation(
        P.mirrored_regions(regions(s, d), P.alignment_lengths(profiles(s, d))), profiles(s, d)
    ).select("region_id", "start", "stop", *six("mean_conservation")),
    "primer_conservation_array": lambda s, d: P.primer_conservation(
        primers(s, d), profiles(s, d)
    ).select("primer_id", "i", "pos", *six("conservation")),
    "region_polymorphisms": lambda s, d: P.region_polymorphisms(
        regions(s, d), V.alignments(s, d)
    ).select("region_id", "name", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions")),
    "region_worst_gap": lambda s, d: P.region_worst_gap(regions(s, d), profiles(s, d)).select(
        "region_id", "worst_pos", *six("worst_pct")
    ),
    "region_low_conservation": lambda s, d: P.region_low_conservation(
        regions(s, d), profiles(s, d)
    ).select("region_id", "pos", *six("conservation")),
    "region_warning_summary": lambda s, d: P.region_warning_summary(
        wide_regions(s, d), V.alignments(s, d), profiles(s, d)
    ).select(
        "region_id", "in_bounds", "n_polymorphic", "worst_pos", "n_low",
        *six("worst_pct", "min_conservation"),
    ),
    "annotate_regions": lambda s, d: P.annotate_regions(pairs(s, d)),
}

_SPAN = """SELECT r.region_id, r.start, r.stop, p.* FROM v_regions r JOIN v_profile p
  ON p.aln_id = r.aln_id AND p.pos >= r.start AND p.pos < r.stop"""

ORACLE = {
    "alignment_length_check": duck_with(["v_alignments"], """
SELECT aln_id, seq_idx, name, len, expected_len FROM (
  SELECT aln_id, seq_idx, name, len, first_value(len) OVER (PARTITION BY aln_id ORDER BY seq_idx) AS expected_len
  FROM (SELECT aln_id, seq_idx, name, length(seq) - CASE WHEN seq_idx % 37 = 5 THEN 1 ELSE 0 END AS len FROM v_alignments))
WHERE len <> expected_len"""),
    "explode_alignment": duck_with(["v_cells"], "SELECT aln_id, seq_idx, name, pos, base FROM v_cells"),
    "column_base_counts": duck_with(["v_counts"], "SELECT * FROM v_counts"),
    "column_consensus": duck_with(["v_profile"], "SELECT aln_id, pos, cons_base, greatest(n_a,n_t,n_c,n_g) AS n_cons FROM v_profile"),
    "column_conservation": duck_with(["v_profile"], "SELECT aln_id, pos, round(conservation,6) AS conservation FROM v_profile"),
    "column_gap_pct": duck_with(["v_profile"], "SELECT aln_id, pos, round(pct_gap,6) AS pct_gap FROM v_profile"),
    "column_missed_pct": duck_with(["v_profile"], "SELECT aln_id, pos, round(pct_missed,6) AS pct_missed FROM v_profile"),
    "sliding_profile": duck_with(["v_profile"], f"""
SELECT a.aln_id, a.pos, round(avg(b.conservation),6) AS mean_value FROM v_profile a JOIN v_profile b
  ON a.aln_id=b.aln_id AND b.pos >= a.pos AND b.pos < a.pos+{WIDTH}
WHERE a.pos < {V.ALIGNMENT_WIDTH}-{WIDTH} GROUP BY 1,2"""),
    "consensus_string": duck_with(["v_profile"], """
SELECT aln_id, string_agg(cons_base,'' ORDER BY pos) AS consensus, round(avg(conservation),6) AS mean_conservation FROM v_profile GROUP BY 1"""),
    "region_total_conservation": duck_with(["v_profile", "v_regions"], """
SELECT region_id, round(sum(conservation),6) AS total_conservation FROM v_regions r JOIN v_profile p
  ON p.aln_id=r.aln_id AND p.pos BETWEEN r.start AND r.stop GROUP BY 1"""),
    "region_mean_conservation": duck_with(["v_profile", "v_regions"], f"""
SELECT region_id, {V.ALIGNMENT_WIDTH}-1-r.stop AS start, {V.ALIGNMENT_WIDTH}-1-r.start AS stop,
  round(sum(conservation)/(r.stop-r.start+1),6) AS mean_conservation FROM v_regions r JOIN v_profile p
  ON p.aln_id=r.aln_id AND {V.ALIGNMENT_WIDTH}-1-p.pos BETWEEN r.start AND r.stop GROUP BY region_id, r.start, r.stop"""),
    "primer_conservation_array": duck_with(["v_profile", "v_pairs"], """
SELECT pair_id*2 AS primer_id, p.pos-f_5p AS i, p.pos, round(conservation,6) AS conservation FROM v_pairs v JOIN v_profile p
  ON p.aln_id=v.aln_id AND p.pos BETWEEN f_5p AND f_5p+f_len-1
UNION ALL SELECT pair_id*2+1, r_5p-p.pos, p.pos, round(conservation,6) FROM v_pairs v JOIN v_profile p
  ON p.aln_id=v.aln_id AND p.pos BETWEEN r_5p-r_len+1 AND r_5p"""),
    "region_polymorphisms": duck_with(["v_cells", "v_regions"], """
SELECT region_id, name, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM v_regions r JOIN v_cells c
  ON c.aln_id=r.aln_id AND c.pos >= r.start AND c.pos < r.stop AND c.base NOT IN ('A','T','C','G') GROUP BY 1,2"""),
    "region_worst_gap": duck_with(["v_profile", "v_regions"], f"""
SELECT region_id, pos AS worst_pos, round(pct_missed,6) AS worst_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY pct_missed DESC, pos) AS rn FROM ({_SPAN})) WHERE rn=1 AND pct_missed > 0"""),
    "region_low_conservation": duck_with(["v_profile", "v_regions"], f"""
SELECT region_id, pos, round(conservation,6) AS conservation FROM ({_SPAN}) WHERE conservation < 85"""),
    "region_warning_summary": duck_with(["v_profile", "v_regions"], """
SELECT b.region_id, in_bounds, coalesce(sp.n,0) AS n_polymorphic, wp.pos AS worst_pos, coalesce(n_low,0) AS n_low,
  CASE WHEN mx > 0 THEN round(mx,6) END AS worst_pct, round(mn,6) AS min_conservation
FROM b LEFT JOIN sp USING (region_id) LEFT JOIN co USING (region_id) LEFT JOIN wp USING (region_id)""", {
        "b": f"SELECT region_id, aln_id, start-3 AS start, stop+4 AS stop, start-3 >= 0 AND start-3 < stop+4 AND stop+4 < {V.ALIGNMENT_WIDTH} AS in_bounds FROM v_regions",
        "sp": """SELECT region_id, count(DISTINCT seq_idx) AS n FROM b JOIN v_cells c ON c.aln_id=b.aln_id AND c.pos >= start AND c.pos < stop
        AND base NOT IN ('A','T','C','G') WHERE in_bounds GROUP BY 1""",
        "co": """SELECT region_id, count(*) FILTER (conservation < 85) AS n_low, min(conservation) AS mn, max(pct_missed) AS mx
        FROM b JOIN v_profile p ON p.aln_id=b.aln_id AND p.pos >= start AND p.pos < stop WHERE in_bounds GROUP BY 1""",
        "wp": """SELECT co.region_id, min(p.pos) AS pos FROM co JOIN b USING (region_id) JOIN v_profile p
        ON p.aln_id=b.aln_id AND p.pos >= start AND p.pos < stop AND p.pct_missed = mx WHERE mx > 0 GROUP BY 1""",
    }),
    "annotate_regions": duck_with(["v_pairs"], """
SELECT pair_id, aln_id, pos, CASE WHEN pos < f_5p+f_len OR pos > r_5p-r_len THEN 'primer' ELSE 'amplicon' END AS label
FROM (SELECT *, CAST(unnest(range(f_5p, r_5p+1)) AS INTEGER) AS pos FROM v_pairs)"""),
}
