"""Primer-panel inputs derived from the star-schema test tables.

Each view is a row-local expression over one table (plus small grouped views), so its
size and its work grow with the table. ``DUCK`` holds the same relations as SQL text,
written separately, for the value checks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oligoweave.session import spread

ALIGNMENT_WIDTH = 96
ALIGNMENT_ROWS = 125

# Parameters of every derived panel.
PARAMS = {
    "primer_primer_distance": 0,
    "primer_target_distance": 2,
    "target_len_min": 4,
    "target_len_max": 30,
    "binding_len_min": 8,
    "binding_len_max": 12,
    "ideal_binding_size": 10,
    "max_binding_target_len": 60,
    "target_tm": 25.0,
    "max_tm_deviation": 12.0,
}

# A published sequencing adapter pair, and a short pair for small oligos.
ADAPTERS = [
    (0, "ACACTCTTTCCCTACACGACGCTCTTCCGATCT", "GTGACTGGAGTTCAGACGTGTGCTCTTCCGATCT"),
    (1, "ACACTCTTTCC", "GTGACTGGAGT"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(tag: str, key: Column, suffix: str = "") -> Column:
    return F.md5(F.concat(F.lit(tag), key.cast("string"), F.lit(suffix)))


def _dna(digest: Column) -> Column:
    return F.translate(digest, "0123456789abcdef", "ACGTACGTACGTACGT")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned sequences: conserved columns with rare gaps, variable columns with noise."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    aln = F.floor(F.col("doc_id") / ALIGNMENT_ROWS).cast("bigint")
    parts = docs.select(
        aln.alias("aln_id"),
        F.col("doc_id").alias("seq_idx"),
        F.concat(*[_digest("o", F.col("doc_id"), s) for s in "abc"]).alias("own"),
        _dna(F.concat(*[_digest("c", aln, s) for s in "abc"])).alias("cons"),
        F.concat(*[_digest("s", aln, s) for s in "abc"]).alias("site"),
    )
    cells = parts.select(
        "aln_id",
        "seq_idx",
        F.transform(
            F.sequence(F.lit(1), F.lit(ALIGNMENT_WIDTH)),
            lambda p: F.when(
                F.substring("site", p, F.lit(1)) < "8",
                F.when(F.substring("own", p, F.lit(1)) == "f", "-").otherwise(
                    F.substring("cons", p, F.lit(1))
                ),
            )
            .when(F.substring("own", p, F.lit(1)) < "a", F.substring("cons", p, F.lit(1)))
            .otherwise(F.translate(F.substring("own", p, F.lit(1)), "abcdef", "ACGTN-")),
        ).alias("bases"),
    )
    return cells.select(
        "aln_id",
        "seq_idx",
        F.concat(F.lit("seq_"), F.col("seq_idx").cast("string")).alias("name"),
        F.array_join("bases", "").alias("seq"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two targets per alignment, two alignments per panel."""
    alns = (
        table(spark, sf_dir, "documents")
        .select(F.floor(F.col("doc_id") / ALIGNMENT_ROWS).cast("bigint").alias("aln_id"))
        .distinct()
    )
    return alns.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.floor(F.col("aln_id") / 2).cast("bigint").alias("panel_id"),
        F.format_string("t%d_%d", F.col("aln_id"), F.col("k")).alias("target"),
        "aln_id",
        F.array((30 + 35 * F.col("k")).cast("int"), (33 + 35 * F.col("k")).cast("int")).alias(
            "sites"
        ),
    )


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        targets(spark, sf_dir)
        .select("panel_id")
        .distinct()
        .select("panel_id", *[F.lit(v).alias(k) for k, v in PARAMS.items()])
    )


def panel_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter list of every panel."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(f).alias("forward"), F.lit(r).alias("reverse"))
        for i, f, r in ADAPTERS
    ])
    panels = targets(spark, sf_dir).select("panel_id").distinct()
    return panels.withColumn("a", F.explode(rows)).select("panel_id", "a.*")


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 24-base sequence per part; one part in sixteen carries an N."""
    key = F.col("p_partkey")
    return spread(table(spark, sf_dir, "part").select(key)).select(
        key.alias("seq_id"),
        F.when(
            F.substring(_digest("n", key), 1, 1) == "0",
            F.concat(F.substring(_dna(_digest("b", key)), 1, 11), F.lit("N"),
                     F.substring(_dna(_digest("b", key)), 13, 12)),
        ).otherwise(F.substring(_dna(_digest("b", key)), 1, 24)).alias("seq"),
    )


def oligo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two oligos of different length per part, with end exclusions."""
    key = F.col("p_partkey")
    return spread(table(spark, sf_dir, "part").select(key)).select(
        key.alias("pair_id"),
        F.substring(_dna(_digest("x", key)), F.lit(1), 14 + F.pmod(key, F.lit(9)).cast("int")).alias("s1"),
        F.substring(_dna(_digest("y", key)), F.lit(1), 12 + F.pmod(key, F.lit(11)).cast("int")).alias("s2"),
        F.pmod(key, F.lit(5)).cast("int").alias("f_skip"),
        F.pmod(key, F.lit(7)).cast("int").alias("r_skip"),
    )


def long_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two oligos per supplier, the first of 61 to 90 bases, the second of 20 to 90."""
    key = F.col("s_suppkey")
    both = [F.concat(*(_dna(_digest(f"{tag}{i}", key)) for i in range(3))) for tag in ("lx", "ly")]
    return spread(table(spark, sf_dir, "supplier").select(key)).select(
        key.alias("pair_id"),
        F.substring(both[0], F.lit(1), 61 + F.pmod(key, F.lit(30)).cast("int")).alias("s1"),
        F.substring(both[1], F.lit(1), 20 + F.pmod(key * 7, F.lit(71)).cast("int")).alias("s2"),
    )


def panel_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of four loci: adapters and binding sequences per direction."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.floor(key / 4).cast("bigint").alias("panel_id"),
        F.pmod(key, F.lit(4)).cast("int").alias("i"),
        F.substring(_dna(_digest("fb", key)), 1, 14).alias("f_bind"),
        F.substring(_dna(_digest("rb", key)), 1, 14).alias("r_bind"),
        F.substring(_dna(_digest("fa", key)), 1, 10).alias("f_adapt"),
        F.substring(_dna(_digest("ra", key)), 1, 10).alias("r_adapt"),
    )


def mixed_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binding sequences of ``panel_seqs`` in panels of three, four and five."""
    key, part = F.col("s_suppkey"), F.pmod("s_suppkey", F.lit(12))
    size = F.when(part < 3, 0).when(part < 7, 1).otherwise(2)
    first = F.when(part < 3, 0).when(part < 7, 3).otherwise(7)
    return table(spark, sf_dir, "supplier").select(
        (F.floor(key / 12) * 3 + size).cast("bigint").alias("panel_id"),
        (part - first).cast("int").alias("i"),
        F.substring(_dna(_digest("fb", key)), 1, 14).alias("f_bind"),
    )


def spacer_sets(spark: SparkSession, sf_dir: str, n_sets: int = 3) -> DataFrame:
    """Four-copy primer sets: per supplier, direction and set four primers in long form."""
    key = F.col("s_suppkey")
    base = spread(table(spark, sf_dir, "supplier").select(key)).select(
        key.alias("locus"), F.explode(F.array(F.lit("F"), F.lit("R"))).alias("dir")
    )
    tag = F.concat_ws(":", "dir", F.col("locus").cast("string"))
    return (
        base.withColumn("set_no", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .select(
            "locus",
            "dir",
            "set_no",
            "k",
            F.substring(_dna(F.md5(F.concat(F.lit("ad:"), tag))), 1, 9).alias("adapter"),
            F.lit("").alias("index_seq"),
            F.substring(
                _dna(F.md5(F.concat_ws(":", F.lit("sp"), tag, F.col("set_no").cast("string"),
                                       F.col("k").cast("string")))),
                F.lit(1),
                F.col("k") + F.lit(1),
            ).alias("spacer"),
            F.substring(_dna(F.md5(F.concat(F.lit("bi:"), tag))), 1, 12).alias("binding"),
        )
    )


def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 35 x 35 matrix of scores per run (ship-year and line number)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat_ws("-", F.year("l_shipdate").cast("string"), F.col("l_linenumber").cast("string")).alias("run"),
            F.pmod("l_suppkey", F.lit(35)).cast("int").alias("f"),
            F.pmod("l_partkey", F.lit(35)).cast("int").alias("r"),
        )
        .agg(F.avg("l_quantity").alias("score"))
    )


def homodimers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"),
        F.col("l_linenumber").alias("primer"),
        (F.col("l_returnflag") == "N").alias("is_forward"),
        (F.pmod("l_partkey", F.lit(21)) - 10).cast("int").alias("offset"),
        F.col("l_quantity").cast("int").alias("comp"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"),
    )


def heterodimers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"),
        F.pmod("l_linenumber", F.lit(4)).cast("int").alias("f"),
        F.pmod("l_suppkey", F.lit(4)).cast("int").alias("r"),
        (F.pmod("l_partkey", F.lit(21)) - 10).cast("int").alias("offset"),
        F.col("l_quantity").cast("int").alias("comp"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"),
    )


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report file names; one order in sixteen has a malformed one."""
    key = F.col("o_orderkey")
    name = F.concat(
        F.lit("rig"), (F.pmod(key, F.lit(21)) - 10).cast("string"), F.lit("@set"),
        F.pmod(key, F.lit(5)).cast("string"),
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("run"),
        F.when(F.pmod(key, F.lit(16)) == 3, F.concat(name, F.lit("@x1.txt")))
        .when(F.pmod(key, F.lit(16)) == 5, F.concat(name, F.lit(".csv")))
        .otherwise(F.concat(name, F.lit(".txt")))
        .alias("file_name"),
    )


#: The order of the blocks of a report, after their part.
BLOCK_ORDER = ["primer", "partner", "comp", "lead", "tail", "twice"]


def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of dimer reports, one report per supplier: what their lines are made from, and how many they are.

    Every line item gives one self-dimer block (one or two four-line drawings, part 1) and one
    cross-dimer block (part 3); parts 0 and 2 are headings. ``report_block`` makes the lines.
    """
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("primer"),
        F.pmod("l_orderkey", F.lit(40)).cast("int").alias("partner"),
        F.col("l_quantity").cast("int").alias("comp"),
        F.pmod("l_partkey", F.lit(13)).cast("int").alias("lead"),
        F.pmod("l_orderkey", F.lit(7)).cast("int").alias("tail"),
        (F.pmod("l_partkey", F.lit(2)) == 0).alias("twice"),
    )
    heads = items.select("supp").distinct().select(
        "supp", *[F.lit(0).alias(c) for c in BLOCK_ORDER[:-1]], F.lit(False).alias("twice"), F.explode(F.array(F.lit(0), F.lit(2))).alias("part")
    )
    size = F.when(F.col("part") == 1, F.when(F.col("twice"), 9).otherwise(5)).when(F.col("part") == 3, 6).otherwise(1)
    return items.withColumn("part", F.explode(F.array(F.lit(1), F.lit(3)))).unionByName(heads).withColumn("n_lines", size)


def report_block() -> Column:
    """The lines of a block as an array."""
    flag = F.when(F.pmod("partner", F.lit(2)) == 0, "F").otherwise("R")
    other = F.when(F.pmod("partner", F.lit(2)) == 0, "R").otherwise("F")
    drawing = F.array(
        F.concat(F.repeat(F.lit(" "), F.col("lead")), F.lit("ATCGATCG")),
        F.concat(F.repeat(F.lit(" "), F.col("lead")), F.repeat(F.lit("|"), F.col("comp"))),
        F.concat(F.repeat(F.lit(" "), F.col("tail")), F.lit("GCTAGCTA")),
        F.lit(""),
    )
    primer, part = F.col("primer").cast("string"), F.col("part")
    self_block = F.when(
        F.col("twice"),
        F.concat(F.array(F.concat(F.lit("2 dimers for "), flag, primer)), drawing, drawing),
    ).otherwise(F.concat(F.array(F.concat(F.lit("1 dimer for "), flag, primer)), drawing))
    cross_block = F.concat(
        F.array(
            F.concat(flag, primer, F.lit(" with "), other, F.col("partner").cast("string")),
            F.lit("leading primer"),
        ),
        drawing,
    )
    return (
        F.when(part == 0, F.array(F.lit("Self-Dimers:")))
        .when(part == 1, self_block)
        .when(part == 2, F.array(F.lit("Cross Primer Dimers:")))
        .otherwise(cross_block)
    )


def report_name() -> Column:
    """File name of a supplier's report."""
    return F.format_string("rig%d@set%d.txt", F.pmod("supp", F.lit(21)) - 10, F.col("supp"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimer reports as numbered text lines. The numbering window is part of the fixture only.

    Blocks are numbered before they have their lines, so nothing but whole numbers is shuffled.
    """
    # A block starts after all lines of the blocks before it; equal rows are equal blocks.
    so_far = Window.partitionBy("supp").orderBy("part", *BLOCK_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    placed = report_blocks(spark, sf_dir).withColumn("start", F.coalesce(F.sum("n_lines").over(so_far), F.lit(0)))
    # A name serves all lines of its block.
    named = placed.select(report_name().alias("file"), "start", report_block().alias("block"))
    return named.select("file", "start", F.posexplode("block").alias("row", "text")).select(
        "file", (F.col("start") + F.col("row")).cast("bigint").alias("line_no"), "text"
    )


def site_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed-in site lists and ranges; some are malformed."""
    key, size = F.col("p_partkey"), F.col("p_size")
    plain = F.concat_ws(", ", size.cast("string"), (size + 3).cast("string"), (size * 2).cast("string"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(F.pmod(key, F.lit(16)) == 3, F.concat(size.cast("string"), F.lit(", 1 2")))
        .when(F.pmod(key, F.lit(16)) == 5, F.concat(F.lit("a, "), size.cast("string")))
        .when(F.pmod(key, F.lit(16)) == 7, F.concat(F.lit("-"), size.cast("string"), F.lit(",4bp")))
        .when(F.pmod(key, F.lit(16)) == 9, F.concat(F.lit("site "), size.cast("string")))
        .otherwise(plain)
        .alias("sites_text"),
        F.concat_ws(", ", size.cast("string"), F.pmod(key, F.lit(60)).cast("string")).alias("range_text"),
        F.concat_ws(":", F.pmod(key, F.lit(7)).cast("string"), size.cast("string"),
                    F.when(F.pmod(key, F.lit(11)) == 0, "x").otherwise("30")).alias("time_text"),
    )


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("rep"),
        (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("failure "), F.col("props")).alias("message"),
    )


# --- the same relations for DuckDB --------------------------------------------------

_T = "'0123456789abcdef','ACGTACGTACGTACGT'"
_P = ", ".join(
    f"CAST({v} AS DOUBLE) AS {k}" if isinstance(v, float) else f"{v} AS {k}"
    for k, v in PARAMS.items()
)
_A = " UNION ALL ".join(f"SELECT {i} AS i, '{f}' AS forward, '{r}' AS reverse" for i, f, r in ADAPTERS)

DUCK = {
    "v_raw": f"""
SELECT doc_id, doc_id // {ALIGNMENT_ROWS} AS aln_id,
  md5('o'||doc_id||'a')||md5('o'||doc_id||'b')||md5('o'||doc_id||'c') AS own,
  translate(md5('c'||(doc_id // {ALIGNMENT_ROWS})||'a')||md5('c'||(doc_id // {ALIGNMENT_ROWS})||'b')||md5('c'||(doc_id // {ALIGNMENT_ROWS})||'c'), {_T}) AS cons,
  md5('s'||(doc_id // {ALIGNMENT_ROWS})||'a')||md5('s'||(doc_id // {ALIGNMENT_ROWS})||'b')||md5('s'||(doc_id // {ALIGNMENT_ROWS})||'c') AS site
FROM documents""",
    "v_cells": f"""
SELECT aln_id, doc_id AS seq_idx, 'seq_'||doc_id AS name, pos,
  CASE WHEN substr(site,pos+1,1) < '8'
       THEN CASE WHEN substr(own,pos+1,1) = 'f' THEN '-' ELSE substr(cons,pos+1,1) END
       WHEN substr(own,pos+1,1) < 'a' THEN substr(cons,pos+1,1)
       ELSE translate(substr(own,pos+1,1),'abcdef','ACGTN-') END AS base
FROM v_raw, (SELECT CAST(unnest(range(0,{ALIGNMENT_WIDTH})) AS INTEGER) AS pos)""",
    "v_alignments": """
SELECT aln_id, seq_idx, name, string_agg(base, '' ORDER BY pos) AS seq FROM v_cells GROUP BY 1,2,3""",
    "v_counts": """
SELECT aln_id, pos, count(*) AS n,
  count(*) FILTER (base='A') AS n_a, count(*) FILTER (base='T') AS n_t,
  count(*) FILTER (base='C') AS n_c, count(*) FILTER (base='G') AS n_g,
  count(*) FILTER (base='-') AS n_gap,
  count(*) FILTER (base NOT IN ('A','T','C','G','-')) AS n_other
FROM v_cells GROUP BY 1,2""",
    "v_profile": """
SELECT *, CASE WHEN n_a >= n_t AND n_a >= n_c AND n_a >= n_g THEN 'A'
            WHEN n_t >= n_c AND n_t >= n_g THEN 'T' WHEN n_c >= n_g THEN 'C' ELSE 'G' END AS cons_base,
  greatest(n_a,n_t,n_c,n_g)*100.0::DOUBLE/n AS conservation,
  n_gap*100.0::DOUBLE/n AS pct_gap,
  least(n_gap*100.0::DOUBLE/n, 100.0::DOUBLE - n_gap*100.0::DOUBLE/n) AS pct_missed
FROM v_counts""",
    "v_targets": """
SELECT aln_id // 2 AS panel_id, 't'||aln_id||'_'||k AS target, aln_id, CAST(30+35*k AS INTEGER) AS site1, CAST(33+35*k AS INTEGER) AS site2
FROM (SELECT DISTINCT doc_id // 125 AS aln_id FROM documents), (SELECT unnest([0,1]) AS k)""",
    "v_params": f"SELECT DISTINCT panel_id, {_P} FROM v_targets",
    "v_adapters": _A,
    "v_binding": f"""
SELECT p_partkey AS seq_id,
  CASE WHEN substr(md5('n'||p_partkey),1,1) = '0'
       THEN substr(translate(md5('b'||p_partkey),{_T}),1,11)||'N'||substr(translate(md5('b'||p_partkey),{_T}),13,12)
       ELSE substr(translate(md5('b'||p_partkey),{_T}),1,24) END AS seq FROM part""",
    "v_oligo_pairs": f"""
SELECT p_partkey AS pair_id, substr(translate(md5('x'||p_partkey),{_T}),1,14+p_partkey%9) AS s1,
  substr(translate(md5('y'||p_partkey),{_T}),1,12+p_partkey%11) AS s2,
  CAST(p_partkey%5 AS INTEGER) AS f_skip, CAST(p_partkey%7 AS INTEGER) AS r_skip FROM part""",
    "v_long_pairs": f"""
SELECT s_suppkey AS pair_id,
  substr(translate(md5('lx0'||s_suppkey)||md5('lx1'||s_suppkey)||md5('lx2'||s_suppkey),{_T}),1,CAST(61+s_suppkey%30 AS INTEGER)) AS s1,
  substr(translate(md5('ly0'||s_suppkey)||md5('ly1'||s_suppkey)||md5('ly2'||s_suppkey),{_T}),1,CAST(20+s_suppkey*7%71 AS INTEGER)) AS s2
FROM supplier""",
    "v_panel_seqs": f"""
SELECT s_suppkey // 4 AS panel_id, CAST(s_suppkey % 4 AS INTEGER) AS i,
  substr(translate(md5('fb'||s_suppkey),{_T}),1,14) AS f_bind, substr(translate(md5('rb'||s_suppkey),{_T}),1,14) AS r_bind,
  substr(translate(md5('fa'||s_suppkey),{_T}),1,10) AS f_adapt, substr(translate(md5('ra'||s_suppkey),{_T}),1,10) AS r_adapt
FROM supplier""",
    "v_mixed_panels": f"""
SELECT s_suppkey // 12 * 3 + CASE WHEN s_suppkey % 12 < 3 THEN 0 WHEN s_suppkey % 12 < 7 THEN 1 ELSE 2 END AS panel_id,
  s_suppkey % 12 - CASE WHEN s_suppkey % 12 < 3 THEN 0 WHEN s_suppkey % 12 < 7 THEN 3 ELSE 7 END AS i,
  substr(translate(md5('fb'||s_suppkey),{_T}),1,14) AS f_bind FROM supplier""",
    "v_spacer_sets": f"""
SELECT s_suppkey AS locus, dir, set_no, k,
  substr(translate(md5('ad:'||dir||':'||s_suppkey),{_T}),1,9) AS adapter,
  substr(translate(md5('sp:'||dir||':'||s_suppkey||':'||set_no||':'||k),{_T}),1,k+1) AS spacer,
  substr(translate(md5('bi:'||dir||':'||s_suppkey),{_T}),1,12) AS binding
FROM supplier, (SELECT unnest(['F','R']) AS dir), (SELECT CAST(unnest([0,1,2]) AS INTEGER) AS set_no), (SELECT CAST(unnest([0,1,2,3]) AS INTEGER) AS k)""",
    "v_score_matrix": """
SELECT year(l_shipdate)||'-'||l_linenumber AS run, CAST(l_suppkey%35 AS INTEGER) AS f, CAST(l_partkey%35 AS INTEGER) AS r, avg(l_quantity) AS score
FROM lineitem GROUP BY 1,2,3""",
    "v_homodimers": """
SELECT l_orderkey AS run, l_linenumber AS primer, l_returnflag='N' AS is_forward,
  CAST(l_partkey%21-10 AS INTEGER) AS "offset", CAST(l_quantity AS INTEGER) AS comp, l_partkey*100000+l_suppkey AS ord FROM lineitem""",
    "v_heterodimers": """
SELECT l_orderkey AS run, CAST(l_linenumber%4 AS INTEGER) AS f, CAST(l_suppkey%4 AS INTEGER) AS r,
  CAST(l_partkey%21-10 AS INTEGER) AS "offset", CAST(l_quantity AS INTEGER) AS comp, l_partkey*100000+l_suppkey AS ord FROM lineitem""",
    "v_run_names": """
SELECT o_orderkey AS run, 'rig'||(o_orderkey%21-10)||'@set'||(o_orderkey%5)||
  CASE o_orderkey%16 WHEN 3 THEN '@x1.txt' WHEN 5 THEN '.csv' ELSE '.txt' END AS file_name FROM orders""",
    "v_replicates": """
SELECT user_id AS run, event_id AS rep, event_type <> 'error' AS ok, 'failure '||props AS message FROM events""",
}

_NEEDS = {
    "v_cells": ["v_raw"],
    "v_alignments": ["v_cells"],
    "v_counts": ["v_cells"],
    "v_profile": ["v_counts"],
    "v_params": ["v_targets"],
}


def duck_with(views: list[str], query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` preceded by the views it names, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    parts = [f"{name} AS MATERIALIZED ({DUCK[name]})" for name in ordered]
    # what a query names more than once is worked out once
    once = {name for name in extra or {} if sum(len(re.findall(rf"\b{name}\b", text)) for text in [*extra.values(), query]) > 1}
    parts += [f"{name} AS {'MATERIALIZED ' if name in once else ''}({text})" for name, text in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {query}"
