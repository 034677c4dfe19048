"""Registered source/sink, ranking, dimer-report and batch queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from oligoweave.functions import dimensions as D
from oligoweave.functions import sequence as S
from oligoweave.operators import batch as B
from oligoweave.operators import dimers as R
from oligoweave.operators import ranking as W
from oligoweave.plans import views as V
from oligoweave.plans.views import duck_with
from oligoweave.session import cut_lineage, scratch_path, shuffles_dropped
from oligoweave.sources import alignments as A
from oligoweave.sources import panels as PT
from oligoweave.sources import reports as RP
from oligoweave.sources import sinks as K
from oligoweave.sources import text_fields as T

FASTA_WIDTH = 60


def fasta_files(spark, sf_dir):
    """The alignments as FASTA folders, one per alignment."""
    path = scratch_path(spark, "fasta")
    wrapped = F.concat_ws("\n", F.transform(
        F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / FASTA_WIDTH)),
        lambda b: F.substring("seq", (b * FASTA_WIDTH + 1).cast("int"), F.lit(FASTA_WIDTH)),
    ))
    (
        V.alignments(spark, sf_dir)
        .repartition("aln_id")
        .sortWithinPartitions("aln_id", "seq_idx")
        .select("aln_id", F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("text"))
        .write.partitionBy("aln_id")
        .text(path)
    )
    return path


def scan_fasta(spark, sf_dir):
    return numbered(A.scan_fasta(spark, fasta_files(spark, sf_dir)))


def numbered(scanned):
    """The number of an alignment is that of its folder; files of several folders share their names."""
    return scanned.select(
        F.regexp_extract("aln_id", r"aln_id=(\d+)", 1).cast("bigint").alias("aln_id"),
        F.col("seq_idx").cast("bigint").alias("nth"), "name", "seq",
    )


def scan_block_alignment(spark, sf_dir):
    path = scratch_path(spark, "clustal")
    blocks = K.clustal_text(V.alignments(spark, sf_dir), 40)
    heads = blocks.select("aln_id").distinct().select(
        "aln_id", F.lit(-1).alias("block"), F.lit(-1).cast("bigint").alias("seq_idx"), F.lit("CLUSTAL W").alias("text")
    )
    gaps = blocks.select("aln_id", "block").distinct().select(
        "aln_id", "block", F.lit(-1).cast("bigint").alias("seq_idx"), F.lit("").alias("text")
    )
    (
        blocks.unionByName(heads).unionByName(gaps)
        .repartition("aln_id")
        .sortWithinPartitions("aln_id", "block", "seq_idx")
        .select("aln_id", "text")
        .write.partitionBy("aln_id")
        .text(path)
    )
    return numbered(A.scan_block_alignment(spark, path, "clustal"))


def report_files(spark, sf_dir):
    """Reports written out, one folder per report.

    A written row is a whole block, and blocks are shuffled before they have their lines. Files are
    compressed: as plain text the reports take more disk than all else.
    """
    path = scratch_path(spark, "reports")
    lines = F.transform(V.report_block(), lambda x: F.coalesce(x, F.lit("")))  # a line without text is an empty one
    blocks = (
        V.report_blocks(spark, sf_dir)
        .repartition("supp")
        .withColumn("file", V.report_name())
        .sortWithinPartitions("file", "part", *V.BLOCK_ORDER)
        .select("file", F.array_join(lines, "\n").alias("text"))
    )
    with shuffles_dropped(spark):
        blocks.write.partitionBy("file").text(path, compression="gzip")
    return path


def written_lines(spark, sf_dir):
    """The numbered lines as a table: the fixture's numbering is not part of the parser."""
    return cut_lineage(V.report_lines(spark, sf_dir))


def load_results_dir(spark, sf_dir):
    """Reports read from files; run parameters from the folder named after the report."""
    folder = F.url_decode(F.regexp_extract("file", r"file=([^/]+)/", 1))
    found = RP.load_results_dir(spark, report_files(spark, sf_dir), folder)
    # Two numbers of the parameters, not the map: a map would have all drawings sorted by file.
    number = lambda key, alias: F.first(F.try_element_at("params", F.lit(key))).alias(alias)
    homo, hetero = (
        df.groupBy("file").agg(number("rig", "rig"), number("set", "set_no"), F.count(F.lit(1)).alias(f"n_{kind}"), F.sum("comp").alias(f"{kind}_comp"))
        for df, kind in zip(found, ("homo", "hetero"), strict=True)
    )
    rig, set_no = (F.coalesce(homo[c], hetero[c]).alias(c) for c in ("rig", "set_no"))
    return homo.join(hetero, "file", "full").select(rig, set_no, "n_homo", "homo_comp", "n_hetero", "hetero_comp")


def load_panel_tables(spark, sf_dir):
    root = scratch_path(spark, "panel")
    for name, rows in (("targets", V.targets), ("params", V.params), ("adapters", V.panel_adapters)):
        rows(spark, sf_dir).write.json(f"{root}/{name}")
    tables = PT.load_panel_tables(spark, root)
    return tables["targets"].join(tables["params"], "panel_id").join(tables["adapters"], "panel_id").select(
        "panel_id", "target", "aln_id",
        F.get("sites", F.lit(0)).alias("site1"), F.get("sites", F.lit(1)).alias("site2"),
        "ideal_binding_size", "max_binding_target_len", "target_tm", F.col("i").alias("adapter"), "forward", "reverse",
    )


def pool_rows(spark, sf_dir):
    """Complete primers of each panel, unnamed in odd panels."""
    p = V.panel_seqs(spark, sf_dir)
    return p.select(
        "panel_id", "i",
        F.when(F.pmod("panel_id", F.lit(2)) == 0, F.concat(F.lit("locus"), F.col("i").cast("string"))).alias("target"),
        S.assemble_primer("f_adapt", F.lit(""), F.lit(""), "f_bind").alias("f_primer"),
        S.assemble_primer("r_adapt", F.lit(""), F.lit(""), "r_bind").alias("r_primer"),
    )


def sink_fasta_pool(spark, sf_dir):
    path = scratch_path(spark, "pool")
    K.sink_fasta_pool(pool_rows(spark, sf_dir), path)
    back = spark.read.text(path, lineSep="\n>")
    fields = A.fasta_fields(F.col("value"))
    return back.select(
        F.col("panel_id").cast("bigint").alias("panel_id"),
        fields["name"].alias("name"), fields["seq"].alias("seq"),
    )


def sink_scores_csv(spark, sf_dir):
    path = scratch_path(spark, "scores")
    scores = V.score_matrix(spark, sf_dir).groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("min_score"), F.round(F.max("score"), 6).alias("max_score")
    )
    K.sink_scores_csv(scores, path)
    return spark.read.schema("run string, n bigint, min_score double, max_score double").option("header", True).csv(path)


def append_run_log(spark, sf_dir):
    path = scratch_path(spark, "runlog")
    reps = V.replicates(spark, sf_dir)
    K.append_run_log(B.replicate_failures(reps, 5), path)
    K.append_run_log(
        B.replicate_summary(reps, 5).select(
            "run", F.lit(-1).cast("bigint").alias("rep"),
            F.concat(F.lit("Num Failures = "), F.col("n_failure").cast("string")).alias("message"),
        ), path,
    )
    return spark.read.parquet(path)


def picks(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pick"),
        F.concat_ws("-", (F.lit(1996) + F.pmod("c_custkey", F.lit(3))).cast("string"), (F.lit(1) + F.pmod("c_custkey", F.lit(7))).cast("string")).alias("run"),
        F.pmod("c_custkey", F.lit(35)).cast("int").alias("f"),
        F.col("c_nationkey").alias("r"),
    )


def arrangements(spark, sf_dir):
    """Every pairing of a panel's four forward with its four reverse sequences."""
    perms = D.arrangements(spark, 4, 4).select("perm_id", F.posexplode("perm").alias("i", "j"))
    seqs = V.panel_seqs(spark, sf_dir)
    return (
        seqs.select("panel_id", "i", "f_bind")
        .join(F.broadcast(perms), "i")
        .join(seqs.select("panel_id", F.col("i").alias("j"), "r_bind"), ["panel_id", "j"])
        .select("panel_id", "perm_id", "i", "j", "f_bind", "r_bind")
    )


def param_grid(spark, sf_dir):
    ranges = V.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        (F.pmod("s_suppkey", F.lit(3)) - 1).cast("int").alias("a0"),
        (F.pmod("s_suppkey", F.lit(3)) + 1).cast("int").alias("a1"),
        F.lit(1).alias("b0"),
        (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int").alias("b1"),
    )
    return B.param_grid(ranges, {"rig": ("a0", "a1"), "set": ("b0", "b1")}).select("s_suppkey", "name")


def dimer_stats(spark, sf_dir):
    return R.run_dimer_stats(V.homodimers(spark, sf_dir), V.heterodimers(spark, sf_dir))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def first_dimers(spark, sf_dir):
    homo = V.homodimers(spark, sf_dir).select("run", F.col("primer").alias("p"), "comp", "offset")
    hetero = V.heterodimers(spark, sf_dir).select("run", F.col("f").alias("p"), "comp", "offset")
    return W.dedupe_keep_first([homo, hetero], ["run", "p", "comp"], ["offset"])


def set_files(spark, sf_dir):
    """Four-primer sets written as FASTA and read back: records by name and sequence."""
    path = scratch_path(spark, "sets")
    K.sink_fasta_sets(V.spacer_sets(spark, sf_dir), path)
    fields = A.fasta_fields(F.col("value"))
    back = spark.read.text(path, lineSep="\n>").select(fields["name"].alias("name"), fields["seq"].alias("seq"))
    return back.groupBy("name", "seq").agg(F.count(F.lit(1)).alias("n"))


def set_text(spark, sf_dir):
    sets = V.spacer_sets(spark, sf_dir)
    plain = K.fasta_set_text(sets, fasta=False).select("locus", "dir", "set_no", "k", F.col("text").alias("plain"))
    return K.fasta_set_text(sets).select("locus", "dir", "set_no", "k", "text").join(plain, ["locus", "dir", "set_no", "k"])


def scan_dimer_report(spark, sf_dir):
    """Dimers of every report and kind: how many, and their complementarity."""
    homo, hetero = RP.scan_dimer_report(written_lines(spark, sf_dir))
    both = homo.select("file", F.lit("self").alias("kind"), "comp", "offset").unionByName(
        hetero.select("file", F.lit("cross").alias("kind"), "comp", "offset")
    )
    return both.groupBy("file", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("comp").alias("comp"), F.sum("offset").alias("shift")
    )


QUERIES = {
    "scan_dimer_report": scan_dimer_report,
    "scan_fasta": scan_fasta,
    "scan_block_alignment": scan_block_alignment,
    "scan_dimer_report_self": lambda s, d: RP.parse_homodimers(written_lines(s, d)).select(
        "file", "primer", "is_forward", "offset", "comp", "misaligned"
    ),
    "scan_dimer_report_cross": lambda s, d: RP.parse_heterodimers(written_lines(s, d)).select(
        "file", "f", "r", "offset", "comp", "misaligned"
    ),
    "load_results_dir": load_results_dir,
    "load_panel_tables": load_panel_tables,
    "sink_fasta_pool": sink_fasta_pool,
    "sink_fasta_sets": set_text,
    "sink_fasta_sets_files": set_files,
    "sink_scores_csv": sink_scores_csv,
    "append_run_log": append_run_log,
    # ranking
    "n_lowest": lambda s, d: W.n_lowest(
        V.score_matrix(s, d).withColumn("idx", F.col("f") * 35 + F.col("r")), ["run"], "score", ["idx"], 20
    ).select("run", "idx", "position", F.round("score", 6).alias("score")),
    "n_lowest_matrix": lambda s, d: W.n_lowest(
        V.score_matrix(s, d), ["run"], "score", ["f", "r"], 10, highest=True
    ).select("run", "f", "r", "position", F.round("score", 6).alias("score")),
    "merge_top_n": lambda s, d: W.merge_top_n(
        [V.homodimers(s, d).select("run", F.lit("self").alias("kind"), "comp", "ord"),
         V.heterodimers(s, d).select("run", F.lit("cross").alias("kind"), "comp", "ord")],
        ["run"], [F.col("comp").desc(), F.col("kind"), F.col("ord")], 3,
    ).select("run", "kind", "comp"),
    "co_sort": lambda s, d: W.co_sort(
        V.score_matrix(s, d).withColumn("idx", F.col("f") * 35 + F.col("r")), ["run"], "score", ["idx"]
    ).select("run", "idx", F.round("score", 6).alias("score")),
    "keep_lowest_scores": lambda s, d: W.keep_lowest_scores(
        V.score_matrix(s, d).select("run", (F.col("f") * 35 + F.col("r")).alias("idx"), F.floor("score").cast("bigint").alias("bucket")),
        ["run"], "bucket", "idx", 200,
    ).withColumn("kept", F.lit("lowest")).unionByName(W.keep_lowest_scores(
        V.score_matrix(s, d).select("run", (F.col("f") * 35 + F.col("r")).alias("idx"), F.floor("score").cast("bigint").alias("bucket")),
        ["run"], "bucket", "idx", 50, reverse=True,
    ).withColumn("kept", F.lit("highest"))),
    "pick_by_index": lambda s, d: W.pick_by_index(picks(s, d), V.score_matrix(s, d), ["run", "f", "r"]).select(
        "pick", F.round("score", 6).alias("score")
    ),
    "arrangements": arrangements,
    "latin_rounds": lambda s, d: V.score_matrix(s, d).select(
        "run", "f", "r", D.latin_round("f", "r", 35).cast("int").alias("visit")
    ),
    "dedupe_keep_first": first_dimers,
    # dimer reports
    "prune_mismatched_heteros": lambda s, d: R.prune_mismatched_heteros(V.heterodimers(s, d)),
    "most_stable_homodimers": lambda s, d: R.most_stable_homodimers(V.homodimers(s, d)),
    "most_stable_heterodimers": lambda s, d: R.most_stable_heterodimers(V.heterodimers(s, d)),
    "run_dimer_stats": lambda s, d: rounded(dimer_stats(s, d), "homo_mean", "hetero_mean"),
    "stats_by_param": lambda s, d: rounded(
        R.stats_by_param(dimer_stats(s, d), V.run_names(s, d), "rig"), "homo_mean", "hetero_mean"
    ),
    "direction_means": lambda s, d: rounded(
        R.direction_means(V.homodimers(s, d), V.heterodimers(s, d)), "forward_mean", "reverse_mean", "hetero_mean"
    ),
    # batches
    "param_grid": param_grid,
    "spacer_sweep": lambda s, d: B.spacer_sweep(V.panel_seqs(s, d).select("panel_id").distinct()),
    "replicate_summary": lambda s, d: B.replicate_summary(V.replicates(s, d), 8),
    "replicate_failures": lambda s, d: B.replicate_failures(V.replicates(s, d), 8),
}

_FILE = "'rig'||(l_suppkey%21-10)||'@set'||l_suppkey||'.txt'"
_FLAT = """SELECT run, f*35+r AS idx, f, r, score FROM v_score_matrix"""
_ITEMS = {
    "it": f"""SELECT {_FILE} AS file, l_suppkey AS supp, l_linenumber AS primer, CAST(l_orderkey%40 AS INTEGER) AS partner, CAST(l_quantity AS INTEGER) AS comp,
  CAST(l_partkey%13 AS INTEGER) AS lead, CAST(l_orderkey%7 AS INTEGER) AS tail, l_partkey%2=0 AS twice FROM lineitem""",
}
_STABLE_HOMO = """SELECT run, primer, is_forward, comp, "offset", ord FROM (SELECT *, row_number() OVER (PARTITION BY run, primer, is_forward ORDER BY comp DESC, ord, "offset" DESC) AS rn FROM v_homodimers) WHERE rn=1"""
_STABLE_HET = """SELECT run, f, r, comp, "offset", ord FROM (SELECT *, row_number() OVER (PARTITION BY run, f, r ORDER BY comp DESC, ord, "offset" DESC) AS rn FROM v_heterodimers) WHERE rn=1"""
_STATS = {
    "sh": _STABLE_HOMO,
    "se": _STABLE_HET,
    "stats": """SELECT coalesce(a.run,b.run) AS run, round(homo_mean,6) AS homo_mean, homo_max, round(hetero_mean,6) AS hetero_mean, hetero_max FROM
  (SELECT run, avg(comp) AS homo_mean, max(comp) AS homo_max FROM sh GROUP BY 1) a FULL JOIN
  (SELECT run, avg(comp) AS hetero_mean, max(comp) AS hetero_max FROM se WHERE f=r GROUP BY 1) b ON a.run=b.run""",
}


def _until(k: int) -> dict[str, str]:
    return {
        "cum": "SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY rep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM v_replicates",
        "made": f"SELECT * FROM cum WHERE before < {k}",
    }


_SUMMARY = """SELECT run, count(*) AS n_reps, count(*) FILTER (ok) AS n_success, count(*) FILTER (NOT ok) AS n_failure,
  arg_min(message, rep) FILTER (NOT ok) AS first_failure, arg_max(message, rep) FILTER (NOT ok) AS last_failure FROM made GROUP BY 1"""

ORACLE = {
    "scan_dimer_report": duck_with([], """SELECT file, 'self' AS kind, count(*) AS n, CAST(sum(comp) AS BIGINT) AS comp, CAST(sum(tail-lead) AS BIGINT) AS shift FROM (SELECT * FROM it UNION ALL SELECT * FROM it WHERE twice) GROUP BY 1
  UNION ALL SELECT file, 'cross', count(*), CAST(sum(comp) AS BIGINT), CAST(sum(CASE WHEN partner%2=0 THEN tail ELSE tail-lead END) AS BIGINT) FROM it GROUP BY 1""", _ITEMS),
    "scan_fasta": duck_with(["v_alignments"], "SELECT aln_id, seq_idx-aln_id*125 AS nth, name, seq FROM v_alignments"),
    "scan_block_alignment": duck_with(["v_alignments"], "SELECT aln_id, name, seq, seq_idx-aln_id*125 AS nth FROM v_alignments"),
    "scan_dimer_report_self": duck_with([], """SELECT file, primer, partner%2=0 AS is_forward, tail-lead AS "offset", comp, false AS misaligned FROM it
UNION ALL SELECT file, primer, partner%2=0, tail-lead, comp, false FROM it WHERE twice""", _ITEMS),
    "scan_dimer_report_cross": duck_with([], """SELECT file, CASE WHEN partner%2=0 THEN primer ELSE partner END AS f, CASE WHEN partner%2=0 THEN partner ELSE primer END AS r,
  CASE WHEN partner%2=0 THEN tail ELSE tail-lead END AS "offset", comp, false AS misaligned FROM it""", _ITEMS),
    "load_results_dir": duck_with([], """SELECT CAST(supp%21-10 AS INTEGER) AS rig, CAST(supp AS INTEGER) AS set_no, count(*)+count(*) FILTER (twice) AS n_homo,
  CAST(sum(comp)+coalesce(sum(comp) FILTER (twice),0) AS BIGINT) AS homo_comp, count(*) AS n_hetero, CAST(sum(comp) AS BIGINT) AS hetero_comp FROM it GROUP BY supp""", _ITEMS),
    "load_panel_tables": duck_with(["v_params", "v_adapters"], "SELECT panel_id, target, aln_id, site1, site2, ideal_binding_size, max_binding_target_len, target_tm, i AS adapter, forward, reverse FROM v_targets JOIN v_params USING (panel_id), v_adapters"),
    "sink_fasta_pool": duck_with(["v_panel_seqs"], """
SELECT panel_id, CASE WHEN panel_id%2=0 THEN 'locus'||i||'_F' ELSE '_F'||(i+1) END AS name, f_adapt||f_bind AS seq FROM v_panel_seqs UNION ALL
SELECT panel_id, CASE WHEN panel_id%2=0 THEN 'locus'||i||'_R' ELSE '_R'||(i+1) END, r_adapt||r_bind FROM v_panel_seqs"""),
    "sink_fasta_sets_files": duck_with(["v_spacer_sets"], """
SELECT CASE dir WHEN 'F' THEN 'Forward' ELSE 'Reverse' END||' #'||(set_no*4+1+k) AS name, adapter||lower(spacer)||binding AS seq, count(*) AS n FROM v_spacer_sets GROUP BY 1,2"""),
    "sink_fasta_sets": duck_with(["v_spacer_sets"], """
SELECT locus, dir, set_no, k, '>'||CASE dir WHEN 'F' THEN 'Forward' ELSE 'Reverse' END||' #'||(set_no*4+1+k)||chr(10)||adapter||lower(spacer)||binding AS text,
  adapter||spacer||binding AS plain FROM v_spacer_sets"""),
    "sink_scores_csv": duck_with(["v_score_matrix"], "SELECT run, count(*) AS n, round(min(score),6) AS min_score, round(max(score),6) AS max_score FROM v_score_matrix GROUP BY 1"),
    "append_run_log": duck_with(["v_replicates"], f"""
SELECT run, rep, message FROM made WHERE NOT ok UNION ALL SELECT run, -1, 'Num Failures = '||n_failure FROM ({_SUMMARY})""", _until(5)),
    "n_lowest": duck_with(["v_score_matrix"], f"SELECT run, idx, position, round(score,6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY score, idx) AS INTEGER) AS position FROM ({_FLAT})) WHERE position <= 20"),
    "n_lowest_matrix": duck_with(["v_score_matrix"], "SELECT run, f, r, position, round(score,6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY score DESC, f, r) AS INTEGER) AS position FROM v_score_matrix) WHERE position <= 10"),
    "merge_top_n": duck_with(["v_homodimers", "v_heterodimers"], """
SELECT run, kind, comp FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY comp DESC, kind, ord) AS rn FROM
 (SELECT run, 'self' AS kind, comp, ord FROM v_homodimers UNION ALL SELECT run, 'cross', comp, ord FROM v_heterodimers)) WHERE rn <= 3"""),
    "co_sort": duck_with(["v_score_matrix"], f"SELECT run, idx, round(score,6) AS score FROM ({_FLAT}) ORDER BY run, score, idx"),
    "keep_lowest_scores": duck_with(["v_score_matrix"], f"""
SELECT run, idx, CAST(floor(score) AS BIGINT) AS bucket, 'lowest' AS kept FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY floor(score), idx) AS rn FROM ({_FLAT})) WHERE rn <= 200
UNION ALL SELECT run, idx, CAST(floor(score) AS BIGINT), 'highest' FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY floor(score) DESC, idx DESC) AS rn FROM ({_FLAT})) WHERE rn <= 50"""),
    "pick_by_index": duck_with(["v_score_matrix"], """
SELECT c_custkey AS pick, round(score,6) AS score FROM customer JOIN v_score_matrix ON run=(1996+c_custkey%3)||'-'||(1+c_custkey%7) AND f=c_custkey%35 AND r=c_nationkey"""),
    "arrangements": duck_with(["v_panel_seqs"], """
SELECT f.panel_id, perm_id, f.i, r.i AS j, f.f_bind, r.r_bind FROM v_panel_seqs f JOIN (
  SELECT perm_id, i, CASE i WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END AS j FROM (
    SELECT CAST(row_number() OVER (ORDER BY a,b,c,d)-1 AS INTEGER) AS perm_id, * FROM (SELECT unnest([0,1,2,3]) AS a), (SELECT unnest([0,1,2,3]) AS b), (SELECT unnest([0,1,2,3]) AS c), (SELECT unnest([0,1,2,3]) AS d)
    WHERE a<>b AND a<>c AND a<>d AND b<>c AND b<>d AND c<>d), (SELECT unnest([0,1,2,3]) AS i)) p ON p.i=f.i JOIN v_panel_seqs r ON r.panel_id=f.panel_id AND r.i=p.j"""),
    "latin_rounds": duck_with(["v_score_matrix"], "SELECT run, f, r, CAST((r-f+35)%35 AS INTEGER) AS visit FROM v_score_matrix"),
    "dedupe_keep_first": duck_with(["v_homodimers", "v_heterodimers"], """
SELECT run, p, comp, source, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY run, p, comp ORDER BY source, "offset") AS rn FROM
 (SELECT run, primer AS p, comp, "offset", 0 AS source FROM v_homodimers UNION ALL SELECT run, f, comp, "offset", 1 FROM v_heterodimers)) WHERE rn=1"""),
    "prune_mismatched_heteros": duck_with(["v_heterodimers"], "SELECT * FROM v_heterodimers WHERE f=r"),
    "most_stable_homodimers": duck_with(["v_homodimers"], _STABLE_HOMO),
    "most_stable_heterodimers": duck_with(["v_heterodimers"], _STABLE_HET),
    "run_dimer_stats": duck_with(["v_homodimers", "v_heterodimers"], "SELECT * FROM stats", _STATS),
    "stats_by_param": duck_with(["v_homodimers", "v_heterodimers"], """
SELECT value, run, homo_mean, homo_max, hetero_mean, hetero_max FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY run DESC) AS rn FROM
 (SELECT CAST(o_orderkey%21-10 AS INTEGER) AS value, stats.* FROM orders JOIN stats ON run=o_orderkey WHERE o_orderkey%16 NOT IN (3,5))) WHERE rn=1""", _STATS),
    "direction_means": duck_with(["v_homodimers", "v_heterodimers"], """
SELECT run, round(avg(comp) FILTER (side='f'),6) AS forward_mean, round(avg(comp) FILTER (side='r'),6) AS reverse_mean, round(avg(comp) FILTER (side='h'),6) AS hetero_mean FROM
 (SELECT run, CASE WHEN is_forward THEN 'f' ELSE 'r' END AS side, comp FROM v_homodimers UNION ALL SELECT run, 'h', comp FROM v_heterodimers) GROUP BY 1"""),
    "param_grid": """SELECT s_suppkey, 'rig'||rig||'@set'||st||'.txt' AS name FROM (SELECT s_suppkey, rig, unnest(range(1, s_suppkey%4+2)) AS st FROM
 (SELECT s_suppkey, unnest(range(s_suppkey%3-1, s_suppkey%3+2)) AS rig FROM supplier))""",
    "spacer_sweep": duck_with(["v_panel_seqs"], """SELECT panel_id, CAST(h AS INTEGER) AS hetero_len, CAST(m AS INTEGER) AS max_spacer FROM (SELECT DISTINCT panel_id FROM v_panel_seqs),
 (SELECT unnest([8,9,10,11]) AS h), (SELECT unnest([6,7,8,9,10]) AS m) WHERE m < h"""),
    "replicate_summary": duck_with(["v_replicates"], _SUMMARY, _until(8)),
    "replicate_failures": duck_with(["v_replicates"], "SELECT run, rep, message FROM made WHERE NOT ok", _until(8)),
}
