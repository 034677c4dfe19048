"""Registered sequence-function and data-quality queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from oligoweave.functions import constants as C
from oligoweave.functions import dimensions as D
from oligoweave.functions import sequence as S
from oligoweave.operators import profile as P
from oligoweave.operators import quality as Q
from oligoweave.plans import views as V
from oligoweave.plans.catalog_profile import pairs
from oligoweave.plans.views import duck_with
from oligoweave.session import cut_lineage
from oligoweave.sources import text_fields as T

CODES = "".join(C.IUPAC_OPTIONS)


def code_pairs(spark, sf_dir):
    """Pairs of IUPAC codes, one per line item."""
    def code(key):
        return F.substring(F.lit(CODES), (F.pmod(key, F.lit(17)) + 1).cast("int"), F.lit(1))

    return V.table(spark, sf_dir, "lineitem").groupBy(
        code(F.col("l_partkey")).alias("b1"), code(F.col("l_suppkey")).alias("b2")
    ).agg(F.count(F.lit(1)).alias("n"))


def sites_on_oligos(spark, sf_dir):
    p = V.oligo_pairs(spark, sf_dir)
    return p.select(
        "pair_id",
        F.substring("s2", 1, 10).alias("oligo"),
        F.col("s1").alias("seq"),
        F.pmod(F.col("pair_id"), F.length("s1") - 9).cast("int").alias("offset"),
    )


def doc_targets(spark, sf_dir):
    """One target per document, two sites on a 5000-column alignment."""
    d = F.col("doc_id")
    return V.table(spark, sf_dir, "documents").select(
        F.floor(d / 250).cast("bigint").alias("panel_id"),
        F.concat(F.lit("d"), (d - F.pmod(d, F.lit(50)) + F.pmod(d, F.lit(47))).cast("string")).alias("name"),
        F.concat(F.lit("d"), d.cast("string")).alias("target"),
        F.floor(d / V.ALIGNMENT_ROWS).cast("bigint").alias("aln_id"),
        F.array(F.pmod(d * 37, F.lit(5000)).cast("int"), F.pmod(d * 53, F.lit(5000)).cast("int")).alias("sites"),
    )


def doc_lengths(spark, sf_dir):
    return doc_targets(spark, sf_dir).select("aln_id", F.lit(5000).alias("aln_len")).distinct()


def adapter_panels(spark, sf_dir):
    return V.panel_seqs(spark, sf_dir).select(
        "panel_id",
        F.concat(F.repeat("f_adapt", F.lit(3)), F.left("f_bind", F.pmod("panel_id", F.lit(9)).cast("int"))).alias("forward"),
        F.repeat("r_adapt", F.lit(3)).alias("reverse"),
        (8 + F.pmod("panel_id", F.lit(5))).cast("int").alias("hetero_len"),
        F.lit(14).alias("binding_len_max"),
    )


def consensus_pairs(spark, sf_dir):
    """Bindings of every pair, cut from consensus chunks (narrow ones here, so that many bindings lie in two)."""
    size = 16
    chunks = cut_lineage(P.consensus_chunks(P.profile(V.alignments(spark, sf_dir)), size))
    own = pairs(spark, sf_dir).withColumn("r_start", F.col("r_5p") - F.col("r_len") + 1)
    sides = own.select("aln_id", F.col("f_5p").alias("start"), F.col("f_len").alias("len")).unionByName(
        own.select("aln_id", F.col("r_start").alias("start"), F.col("r_len").alias("len"))
    )
    spans = cut_lineage(P.consensus_spans(sides, chunks, size))
    f, r = (spans.select("aln_id", F.col("start").alias(start), F.col("len").alias(n), F.col("bases").alias(bases)) for start, n, bases in (
        ("f_5p", "f_len", "f_bases"), ("r_start", "r_len", "r_bases")))
    return own.join(f, ["aln_id", "f_5p", "f_len"], "left").join(r, ["aln_id", "r_start", "r_len"], "left").select(
        "pair_id", F.col("f_bases").alias("f_seq"), S.reverse_complement("r_bases").alias("r_seq")
    )


def per_part(columns):
    return lambda s, d: V.bindings(s, d).select("seq_id", *columns())


def per_pair(columns):
    return lambda s, d: V.oligo_pairs(s, d).select("pair_id", *columns())


QUERIES = {
    "reverse_complement": per_part(lambda: [S.is_plain_dna("seq").alias("plain"),
        F.when(S.is_plain_dna("seq"), S.reverse_complement(F.lower("seq"))).alias("rc"),
        F.when(S.is_plain_dna("seq"), S.complement("seq")).alias("comp")]),
    "mask_degenerate": per_part(lambda: [S.mask_degenerate("seq").alias("masked"), S.is_degenerate("seq").alias("degenerate")]),
    "iupac_match_probability": lambda s, d: code_pairs(s, d).join(
        F.broadcast(D.iupac_pairs(s)), ["b1", "b2"]
    ).select("b1", "b2", "n", F.round("probability", 6).alias("probability")),
    "iupac_compatible": lambda s, d: code_pairs(s, d).select(
        "b1", "b2", "n", S.iupac_compatible("b1", "b2").alias("compatible"),
        S.same_base_unless_ignored("b1", "b2").alias("same_unless_ignored"),
    ),
    "trim_to_solver_limit": lambda s, d: V.bindings(s, d).select(
        "seq_id", S.trim_to_solver_limit(F.repeat("seq", F.lit(1) + F.pmod("seq_id", F.lit(4)).cast("int"))).alias("trimmed")
    ),
    "binding_subsequence": consensus_pairs,
    "flip_coordinates": lambda s, d: pairs(s, d).select(
        "pair_id", S.flip_coordinate(F.col("r_5p"), F.col("f_5p") + 50).alias("flipped")
    ),
    "site_complementarity": lambda s, d: sites_on_oligos(s, d).select(
        "pair_id", S.site_complementarity("oligo", "seq", "offset").cast("int").alias("matches")
    ),
    "site_complementarity_run": lambda s, d: sites_on_oligos(s, d).select(
        "pair_id", S.site_complementarity_run("oligo", "seq", "offset").cast("int").alias("longest")
    ),
    "max_contained_complementarity": lambda s, d: V.oligo_pairs(s, d).select(
        "pair_id", S.encode_overlap("s1").alias("a"), S.encode_overlap("s2").alias("b")
    ).select("pair_id", S.contained_scores("b", "a").alias("c")).select("pair_id", "c.total", "c.run"),
    "max_overlap_total": per_pair(lambda: [S.max_overlap_total("s1", "s2", "f_skip", "r_skip").alias("total")]),
    "max_overlap_run": per_pair(lambda: [S.max_overlap_run("s1", "s2", "f_skip", "r_skip").alias("run")]),
    "assemble_primer": lambda s, d: V.spacer_sets(s, d).select(
        "locus", "dir", "set_no", "k",
        S.assemble_primer("adapter", "index_seq", F.lower("spacer"), "binding").alias("primer"),
        F.length(F.concat("adapter", "index_seq")).alias("five_p_len"),
        F.length("binding").alias("three_p_len"),
    ),
    "gc_clamp": per_pair(lambda: [S.gc_clamp("s1", "s2").alias("clamp")]),
    "melting_temperature": per_part(lambda: [F.round(S.melting_temperature("seq"), 6).alias("tm")]),
    "dimer_energy": per_pair(lambda: [F.round(S.dimer_energy("s1", "s2"), 2).alias("dg"),
        S.energy_as_int(S.dimer_energy("s1", "s2")).alias("score")]),
    "hairpin_energy": per_pair(lambda: [F.round(S.hairpin_energy(F.concat("s1", "s2")), 2).alias("dg")]),
    # oligos beyond the length of a mask
    "dimer_energy_long": lambda s, d: V.long_pairs(s, d).select(
        "pair_id", F.round(S.dimer_energy("s1", "s2"), 2).alias("dg"), S.max_overlap_run("s1", "s2").alias("run"), S.max_overlap_total("s1", "s2").alias("total")),
    "hairpin_energy_long": lambda s, d: V.long_pairs(s, d).select("pair_id", F.round(S.hairpin_energy("s1"), 2).alias("dg")),
    "gc_band": per_part(lambda: [F.round(S.gc_fraction("seq"), 6).alias("gc"), S.gc_band("seq").alias("band")]),
    # data quality
    "check_sites_in_bounds": lambda s, d: Q.check_sites_in_bounds(
        doc_targets(s, d), doc_lengths(s, d), 200
    ).select("target", "site"),
    "check_site_conflicts": lambda s, d: Q.check_site_conflicts(doc_targets(s, d), 8).select(
        "target", "site", "nearest", "identical"
    ),
    "check_site_span": lambda s, d: Q.check_site_span(doc_targets(s, d), 1500),
    "check_dna_alphabet": lambda s, d: Q.check_dna_alphabet(V.bindings(s, d)),
    "check_ranges": lambda s, d: Q.check_ranges(
        T.parse_ranges(V.site_strings(s, d), "range_text"), (2, 45), (0, 58)
    ).select("id", "start", "stop"),
    "check_unique_targets": lambda s, d: Q.check_unique_targets(
        doc_targets(s, d).select("panel_id", F.col("name").alias("target"))
    ),
    "check_unique_sites": lambda s, d: Q.check_unique_sites(
        V.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array(
            F.pmod("p_partkey", F.lit(13)).cast("int"), F.pmod("p_size", F.lit(13)).cast("int")).alias("sites"))
    ).select("id"),
    "check_primer_length_overflow": lambda s, d: Q.check_primer_length_overflow(adapter_panels(s, d)),
    "check_full_primer_length": lambda s, d: Q.check_full_primer_length(
        V.spacer_sets(s, d).select(
            "locus", "dir", "set_no", "k",
            S.assemble_primer("adapter", "index_seq", "spacer", "binding").alias("primer")), 24
    ),
    # typed-in text
    "parse_site_lists": lambda s, d: T.parse_ranges(
        T.parse_durations(T.parse_site_lists(V.site_strings(s, d), "sites_text"), "time_text"), "range_text"
    ).select(
        "id", F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"),
        "start", "stop", "total_seconds",
    ),
    "scan_run_params": lambda s, d: T.scan_run_params(V.run_names(s, d)).select(
        "run", F.col("params").isNotNull().alias("valid"),
        F.try_element_at("params", F.lit("rig")).alias("rig"), F.try_element_at("params", F.lit("set")).alias("set_no"),
    ),
    "load_template_sets": lambda s, d: V.table(s, d, "supplier").select(
        "s_suppkey", F.get(F.array(*[F.lit(g[0]) for g in D.GENSETS]), F.pmod("s_suppkey", F.lit(10)).cast("int")).alias("name")
    ).join(F.broadcast(D.template_sets(s)), "name").select(
        "s_suppkey", "name", "i", "f_bind", "r_bind", "f_adapt", "r_adapt"
    ),
}

# --- SQL ---------------------------------------------------------------------------

_OPTIONS = "(VALUES " + ",".join(
    f"('{c}','{b}')" for c, o in C.IUPAC_OPTIONS.items() for b in o
) + ") AS opt(code, base)"
_STEPS = "(VALUES " + ",".join(
    f"('{k}',{v[0]},{v[1]},{v[2]})" for k, v in sorted(C.step_table().items())
) + ") AS st(step, dh, ds, dg)"
_RC = "reverse(translate({},'ATCG','TAGC'))"


def overlap_ctes(source: str) -> dict[str, str]:
    """CTEs from ``source(id, a, b, f_skip, r_skip)``: matched cells and islands of them."""
    return {
        "ov_in": source,
        "ov_lr": f"""SELECT id, CASE WHEN length(a)<length(b) THEN b ELSE a END AS l,
  {_RC.format("CASE WHEN length(a)<length(b) THEN a ELSE b END")} AS s,
  CASE WHEN length(a)<length(b) THEN r_skip ELSE f_skip END AS fs, CASE WHEN length(a)<length(b) THEN f_skip ELSE r_skip END AS rs FROM ov_in""",
        "ov_l": "SELECT id, unnest(range(0,length(l))) AS i, unnest(string_split(l,'')) AS base FROM ov_lr",
        "ov_s": "SELECT id, unnest(range(0,length(s))) AS j, unnest(string_split(s,'')) AS base FROM ov_lr",
        "ov_m": """SELECT id, i, i-j AS shift FROM ov_l JOIN ov_s USING (id, base) JOIN ov_lr USING (id)
  WHERE base IN ('A','T','C','G') AND i-j >= 2-length(s)+fs AND i-j <= length(l)-2-rs""",
        "ov_t": "SELECT id, shift, count(*) AS c FROM ov_m GROUP BY 1,2",
        "ov_g": "SELECT id, shift, i, i - row_number() OVER (PARTITION BY id, shift ORDER BY i) AS g FROM ov_m",
        "ov_r": "SELECT id, shift, g, count(*) AS c, min(i) AS i0, max(i) AS i1 FROM ov_g GROUP BY 1,2,3",
        "ov_pre": f"""SELECT id, p AS pos, sum(coalesce(dg,0)) OVER (PARTITION BY id ORDER BY p) AS e
  FROM (SELECT id, l, unnest(range(0,length(l))) AS p FROM ov_lr) LEFT JOIN {_STEPS} ON step = substr(l,CAST(p AS BIGINT),2) AND p > 0""",
        "ov_e": """SELECT r.id, min(b.e-a.e) AS e FROM ov_r r JOIN ov_pre a ON a.id=r.id AND a.pos=r.i0 JOIN ov_pre b ON b.id=r.id AND b.pos=r.i1 GROUP BY 1""",
        "ov_scores": """SELECT ov_in.id, coalesce((SELECT max(c) FROM ov_t t WHERE t.id=ov_in.id),0) AS total,
  coalesce((SELECT max(c) FROM ov_r r WHERE r.id=ov_in.id),0) AS run, coalesce((SELECT e FROM ov_e e WHERE e.id=ov_in.id),0) AS e FROM ov_in""",
    }


def _hairpins(view: str, seq: str) -> tuple[str, dict[str, str]]:
    return f"""
SELECT p.pair_id, round(coalesce(min(e),0)/100.0::DOUBLE,2) AS dg FROM {view} p LEFT JOIN (
  SELECT pair_id, d, g, sum(CASE WHEN rn > 1 THEN dg ELSE 0 END) AS e FROM (
    SELECT h.*, row_number() OVER (PARTITION BY pair_id, d, g ORDER BY i) AS rn FROM h) LEFT JOIN {_STEPS} ON step = substr(s,CAST(i-1 AS BIGINT),2) GROUP BY 1,2,3) USING (pair_id) GROUP BY 1""", {
        "hb": f"SELECT pair_id, {seq} AS s, unnest(range(1,length({seq})+1)) AS i, unnest(string_split({seq},'')) AS base FROM {view}",
        "h": """SELECT pair_id, s, i, d, i - row_number() OVER (PARTITION BY pair_id, d ORDER BY i) AS g FROM (
  SELECT x.pair_id, x.s, x.i, x.i+y.i AS d FROM hb x JOIN hb y ON x.pair_id=y.pair_id AND y.i-x.i > 3 AND y.base = translate(x.base,'ATCG','TAGC'))""",
    }


_PAIR_SRC = "SELECT pair_id AS id, s1 AS a, s2 AS b, f_skip, r_skip FROM v_oligo_pairs"
_PAIR_SRC0 = "SELECT pair_id AS id, s1 AS a, s2 AS b, 0 AS f_skip, 0 AS r_skip FROM v_oligo_pairs"

_TM = f"""SELECT id, 100.0::DOUBLE*(dh + th)/((ds + ts + CASE WHEN s = {_RC.format('s')} THEN -14 ELSE 0 END)/10.0::DOUBLE
    + CAST(0.368 AS DOUBLE)*(length(s)-1)*ln(CAST(0.05 AS DOUBLE)) + CAST(1.987 AS DOUBLE)*ln(CAST(1.25e-8 AS DOUBLE))) - CAST(273.15 AS DOUBLE) AS tm
FROM (SELECT id, s, sum(dh) AS dh, sum(ds) AS ds,
    CASE WHEN s[1] IN ('G','C') THEN 1 ELSE 23 END + CASE WHEN s[-1] IN ('G','C') THEN 1 ELSE 23 END AS th,
    CASE WHEN s[1] IN ('G','C') THEN -28 ELSE 41 END + CASE WHEN s[-1] IN ('G','C') THEN -28 ELSE 41 END AS ts
  FROM (SELECT id, s, unnest(range(1,length(s))) AS p FROM tm_in) JOIN {_STEPS} ON step = substr(s,CAST(p AS BIGINT),2) GROUP BY id, s)"""

_SITE = """SELECT pair_id, i FROM (SELECT pair_id, oligo, seq, off, unnest(range(1,11)) AS i FROM
  (SELECT pair_id, substr(s2,1,10) AS oligo, s1 AS seq, pair_id % (length(s1)-9) AS off FROM v_oligo_pairs))
  WHERE translate(substr(oligo,i,1),'ATCG','TAGC') = substr(seq,i+off,1)"""

_INT = r"^(-|[^0-9-]*)[0-9]+[^0-9-]*$"
_TARGET_DOCS = """SELECT doc_id//250 AS panel_id, 'd'||(doc_id-doc_id%50+doc_id%47) AS name, 'd'||doc_id AS target, doc_id//125 AS aln_id,
  CAST(doc_id*37%5000 AS INTEGER) AS a, CAST(doc_id*53%5000 AS INTEGER) AS b FROM documents"""
_SITES = {"td": _TARGET_DOCS, "si": "SELECT DISTINCT target, aln_id, unnest([a,b]) AS site FROM td"}
_STRINGS = """SELECT p_partkey AS id, CASE p_partkey%16 WHEN 3 THEN p_size||', 1 2' WHEN 5 THEN 'a, '||p_size
  WHEN 7 THEN '-'||p_size||',4bp' WHEN 9 THEN 'site '||p_size ELSE p_size||', '||(p_size+3)||', '||(p_size*2) END AS sites_text,
  p_size AS start, CAST(p_partkey%60 AS INTEGER) AS stop, CASE WHEN p_partkey%11 <> 0 THEN (p_partkey%7)*3600+p_size*60+30 END AS total_seconds FROM part"""


_GENSET_ROWS = "(VALUES " + ",".join(
    f"({n},'{g[0]}',{i},'{fb}','{rb}',{str(g[3]).lower()},'{g[4]}','{g[5]}')"
    for n, g in enumerate(D.GENSETS)
    for i, (fb, rb) in enumerate(zip(g[1], g[2]))
) + ") AS gs(n, name, i, fb, rb, flip, f_adapt, r_adapt)"

ORACLE = {
    "reverse_complement": duck_with(["v_binding"], """
SELECT seq_id, NOT regexp_matches(seq,'[^ATCG]') AS plain, CASE WHEN NOT regexp_matches(seq,'[^ATCG]') THEN reverse(translate(seq,'ATCG','TAGC')) END AS rc,
  CASE WHEN NOT regexp_matches(seq,'[^ATCG]') THEN translate(seq,'ATCG','TAGC') END AS comp FROM v_binding"""),
    "mask_degenerate": duck_with(["v_binding"], """
SELECT seq_id, regexp_replace(seq,'[^ATCG]','I','g') AS masked, regexp_matches(seq,'[^ATCG]') AS degenerate FROM v_binding"""),
    "iupac_match_probability": f"""
WITH cp AS (SELECT substr('{CODES}',l_partkey%17+1,1) AS b1, substr('{CODES}',l_suppkey%17+1,1) AS b2, count(*) AS n FROM lineitem GROUP BY 1,2),
 pr AS (SELECT x.code AS b1, y.code AS b2, round(avg(CASE WHEN x.base=y.base THEN 1.0::DOUBLE ELSE 0 END),6) AS p FROM {_OPTIONS.replace('opt(','x(')}, {_OPTIONS.replace('opt(','y(')} GROUP BY 1,2)
SELECT cp.b1, cp.b2, n, coalesce(CASE WHEN 'U' IN (cp.b1,cp.b2) THEN 0 ELSE p END, 0) AS probability FROM cp LEFT JOIN pr ON pr.b1=cp.b1 AND pr.b2=cp.b2""",
    "iupac_compatible": f"""
WITH cp AS (SELECT substr('{CODES}',l_partkey%17+1,1) AS b1, substr('{CODES}',l_suppkey%17+1,1) AS b2, count(*) AS n FROM lineitem GROUP BY 1,2),
 ov AS (SELECT DISTINCT x.code AS b1, y.code AS b2 FROM {_OPTIONS.replace('opt(','x(')} JOIN {_OPTIONS.replace('opt(','y(')} ON x.base=y.base)
SELECT cp.b1, cp.b2, n, cp.b1=cp.b2 OR ov.b1 IS NOT NULL AS compatible, cp.b1=cp.b2 AND cp.b1<>'I' AS same_unless_ignored
FROM cp LEFT JOIN ov ON ov.b1=cp.b1 AND ov.b2=cp.b2""",
    "trim_to_solver_limit": duck_with(["v_binding"], "SELECT seq_id, right(repeat(seq, CAST(1+seq_id%4 AS INTEGER)),60) AS trimmed FROM v_binding"),
    "binding_subsequence": duck_with(["v_profile", "v_pairs"], """
SELECT pair_id, string_agg(cons_base,'' ORDER BY pos) FILTER (pos BETWEEN f_5p AND f_5p+f_len-1) AS f_seq,
  translate(string_agg(cons_base,'' ORDER BY pos DESC) FILTER (pos BETWEEN r_5p-r_len+1 AND r_5p),'ATCG','TAGC') AS r_seq
FROM v_pairs v JOIN v_profile p USING (aln_id) GROUP BY pair_id"""),
    "flip_coordinates": duck_with(["v_pairs"], "SELECT pair_id, CASE WHEN r_5p <= f_5p+50 THEN f_5p+50-r_5p-1 END AS flipped FROM v_pairs"),
    "site_complementarity": duck_with(["v_oligo_pairs"], """
SELECT p.pair_id, CAST(count(i) AS INTEGER) AS matches FROM v_oligo_pairs p LEFT JOIN si USING (pair_id) GROUP BY 1""", {"si": _SITE}),
    "site_complementarity_run": duck_with(["v_oligo_pairs"], """
SELECT p.pair_id, CAST(coalesce(max(c),0) AS INTEGER) AS longest FROM v_oligo_pairs p LEFT JOIN
 (SELECT pair_id, count(*) AS c FROM (SELECT pair_id, i - row_number() OVER (PARTITION BY pair_id ORDER BY i) AS g FROM si) GROUP BY pair_id, g) USING (pair_id) GROUP BY 1""", {"si": _SITE}),
    "max_contained_complementarity": duck_with(["v_oligo_pairs"], """
SELECT p.pair_id, CAST(coalesce(max(t.c),0) AS INTEGER) AS total, CAST(coalesce(max(rl.c),0) AS INTEGER) AS run FROM v_oligo_pairs p LEFT JOIN t USING (pair_id) LEFT JOIN rl USING (pair_id) GROUP BY 1""", {
        "ls": "SELECT pair_id, CASE WHEN length(s1)>=length(s2) THEN s1 ELSE s2 END AS l, translate(CASE WHEN length(s1)>=length(s2) THEN s2 ELSE s1 END,'ATCG','TAGC') AS s FROM v_oligo_pairs",
        "c": "SELECT pair_id, o, i FROM (SELECT pair_id, l, s, o, unnest(range(1,length(s)+1)) AS i FROM (SELECT *, unnest(range(0,length(l)-length(s))) AS o FROM ls)) WHERE substr(l,CAST(i+o AS BIGINT),1)=substr(s,CAST(i AS BIGINT),1)",
        "t": "SELECT pair_id, o, count(*) AS c FROM c GROUP BY 1,2",
        "rl": "SELECT pair_id, o, g, count(*) AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY pair_id, o ORDER BY i) AS g FROM c) GROUP BY 1,2,3",
    }),
    "max_overlap_total": duck_with(["v_oligo_pairs"], "SELECT id AS pair_id, CAST(total AS INTEGER) AS total FROM ov_scores", overlap_ctes(_PAIR_SRC)),
    "max_overlap_run": duck_with(["v_oligo_pairs"], "SELECT id AS pair_id, CAST(run AS INTEGER) AS run FROM ov_scores", overlap_ctes(_PAIR_SRC)),
    "assemble_primer": duck_with(["v_spacer_sets"], "SELECT locus, dir, set_no, k, adapter||spacer||binding AS primer, 9 AS five_p_len, 12 AS three_p_len FROM v_spacer_sets"),
    "gc_clamp": duck_with(["v_oligo_pairs"], "SELECT pair_id, (s1[-1] IN ('G','C') OR s1[-2] IN ('G','C')) AND (s2[-1] IN ('G','C') OR s2[-2] IN ('G','C')) AS clamp FROM v_oligo_pairs"),
    "melting_temperature": duck_with(["v_binding"], "SELECT seq_id, round(tm,6) AS tm FROM v_binding LEFT JOIN tmv ON id = seq_id",
        {"tm_in": "SELECT seq_id AS id, seq AS s FROM v_binding WHERE seq NOT LIKE '%N%'", "tmv": _TM}),
    "dimer_energy": duck_with(["v_oligo_pairs"], "SELECT id AS pair_id, round(e/100.0::DOUBLE,2) AS dg, CAST(-trunc(e/100.0::DOUBLE) AS BIGINT) AS score FROM ov_scores", overlap_ctes(_PAIR_SRC0)),
    "hairpin_energy": duck_with(["v_oligo_pairs"], *_hairpins("v_oligo_pairs", "s1||s2")),
    "dimer_energy_long": duck_with(["v_long_pairs"], "SELECT id AS pair_id, round(e/100.0::DOUBLE,2) AS dg, run, total FROM ov_scores", overlap_ctes(
        "SELECT pair_id AS id, s1 AS a, s2 AS b, 0 AS f_skip, 0 AS r_skip FROM v_long_pairs")),
    "hairpin_energy_long": duck_with(["v_long_pairs"], *_hairpins("v_long_pairs", "s1")),
    "gc_band": duck_with(["v_binding"], """
SELECT seq_id, round(gc,6) AS gc, CAST(least(floor(gc*10),9) AS INTEGER) AS band FROM (SELECT seq_id, length(regexp_replace(seq,'[^GC]','','g'))/length(seq)::DOUBLE AS gc FROM v_binding)"""),
    "check_sites_in_bounds": duck_with([], "SELECT target, site FROM (SELECT target, unnest([a,b]) AS site FROM td) WHERE site <= 200 OR site >= 4800", {"td": _TARGET_DOCS}),
    "check_site_conflicts": duck_with([], """
SELECT x.target, x.site, CAST(min(abs(x.site-y.site)) AS INTEGER) AS nearest, min(abs(x.site-y.site))=0 AS identical
FROM si x JOIN si y ON x.aln_id=y.aln_id AND x.target<>y.target AND abs(x.site-y.site) < 8 GROUP BY 1,2""", _SITES),
    "check_site_span": duck_with([], "SELECT target, abs(a-b) AS span FROM td WHERE abs(a-b) > 1500", {"td": _TARGET_DOCS}),
    "check_dna_alphabet": duck_with(["v_binding"], "SELECT seq_id, seq FROM v_binding WHERE contains(seq,'N')"),
    "check_ranges": duck_with([], "SELECT id, start, stop FROM ss WHERE NOT (start <= stop AND start > 2 AND start < 45 AND stop > 0 AND stop < 58)", {"ss": _STRINGS}),
    "check_unique_targets": duck_with([], "SELECT panel_id, name AS target, count(*) AS n FROM td GROUP BY 1,2 HAVING count(*) > 1", {"td": _TARGET_DOCS}),
    "check_unique_sites": "SELECT p_partkey AS id FROM part WHERE p_partkey%13 = p_size%13",
    "check_primer_length_overflow": duck_with(["v_panel_seqs"], """
SELECT DISTINCT panel_id, CAST(30+panel_id%9+8+panel_id%5+14 AS INTEGER) AS max_len FROM v_panel_seqs WHERE 30+panel_id%9+8+panel_id%5+14 > 60"""),
    "check_full_primer_length": duck_with(["v_spacer_sets"], "SELECT locus, dir, set_no, k, adapter||spacer||binding AS primer, CAST(length(adapter||spacer||binding) AS INTEGER) AS len FROM v_spacer_sets WHERE length(adapter||spacer||binding) > 24"),
    "parse_site_lists": duck_with([], f"""
SELECT id, CASE WHEN list_aggregate(list_transform(string_split(sites_text,','), lambda x: CASE WHEN regexp_matches(x,'{_INT}') THEN 0 ELSE 1 END),'sum') = 0
  THEN array_to_string(list_transform(string_split(sites_text,','), lambda x: regexp_extract(x,'-?[0-9]+')),',') END AS sites, start, stop, CAST(total_seconds AS INTEGER) AS total_seconds FROM ss""", {"ss": _STRINGS}),
    "scan_run_params": """
SELECT o_orderkey AS run, o_orderkey%16 NOT IN (3,5) AS valid, CASE WHEN o_orderkey%16 NOT IN (3,5) THEN CAST(o_orderkey%21-10 AS INTEGER) END AS rig,
  CASE WHEN o_orderkey%16 NOT IN (3,5) THEN CAST(o_orderkey%5 AS INTEGER) END AS set_no FROM orders""",
    "load_template_sets": f"""
SELECT s_suppkey, name, i, fb AS f_bind, CASE WHEN flip THEN reverse(translate(rb,'ATCG','TAGC')) ELSE rb END AS r_bind, f_adapt, r_adapt
FROM supplier JOIN {_GENSET_ROWS} ON s_suppkey%10 = n""",
}
