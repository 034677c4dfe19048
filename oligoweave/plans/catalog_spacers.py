"""Registered spacer and primer-pool queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oligoweave.functions import dimensions as D
from oligoweave.functions import sequence as S
from oligoweave.operators import balance as B
from oligoweave.operators import multiplex as M
from oligoweave.operators import spacers as H
from oligoweave.plans import four_copy as FC
from oligoweave.plans import views as V
from oligoweave.plans.catalog_sequences import _STEPS, overlap_ctes
from oligoweave.plans.views import duck_with
from oligoweave.session import by_shuffle, cut_lineage

N_HETERO = 8
LIMIT = 8
M_HETERO = 5
M_LIMIT = 4
WIDE_HETERO = 12
N_COPIES_HETERO = 12
WIDE_LIMIT = 12
COMBO = H.COMBO
LOCUS = ["locus"]


def combos(s, d, keep=None):
    return H.spacer_length_combos(V.bindings(s, d), N_HETERO, LIMIT, keep)


def best(s, d):
    return H.best_combo(combos(s, d, 1))


def primers(s, d):
    return H.complete_primers(V.spacer_sets(s, d))


PRIMER = ["locus", "dir", "set_no", "k"]


def set_scores(s, d):
    return H.score_spacer_sets(H.self_dimer_scores(primers(s, d), PRIMER), ["locus", "dir", "set_no"])


def pair_scores(s, d):
    return H.pair_dimer_scores(primers(s, d), LOCUS)


def pairings(s, d):
    return H.pairing_scores(pair_scores(s, d), LOCUS)


def best_pairings(s, d):
    return H.best_pairing(pairings(s, d), LOCUS)


def matrix(s, d):
    """Whole-number scores of the matrix cells, so that means are exact."""
    return V.score_matrix(s, d).select("run", "f", "r", F.floor("score").cast("bigint").alias("score"))


def fixed_parts(s, d):
    return V.panel_seqs(s, d).select(
        "panel_id", "i", F.col("f_adapt").alias("f_five"), F.col("f_bind").alias("f_three"),
        F.col("r_adapt").alias("r_five"), F.col("r_bind").alias("r_three"),
    )


def complementarity(s, d):
    return H.set_complementarity(primers(s, d), ["locus", "dir", "set_no"])


def panels(s, d):
    return M.panel_rows(V.panel_seqs(s, d), "f_bind")


def mixed_panels(s, d):
    return M.panel_rows(V.mixed_panels(s, d), "f_bind")


def panels_of(s, d, size):
    """Panels of so many binding sequences; what is left over makes none."""
    key = F.col("panel_id") * 4 + F.col("i")
    rows = V.panel_seqs(s, d).select(F.floor(key / size).cast("bigint").alias("panel_id"), (key % size).cast("int").alias("i"), "f_bind")
    return M.panel_rows(rows, "f_bind").where(F.size("seqs") == size)


def drawn(s, d):
    """Six random compositions of four spacers per panel."""
    rows = V.panel_seqs(s, d).select("panel_id").distinct()
    return B.drawn_compositions(rows.withColumn("total", F.pmod("panel_id", F.lit(9)).cast("int") + 2), 4, M_HETERO, 6, "seed")


def requests(s, d):
    p = V.panel_seqs(s, d).select("panel_id").distinct()
    return p.select("panel_id", F.lit(4).alias("limit"), F.pmod("panel_id", F.lit(13)).cast("int").alias("total"))


def compositions(s, d):
    return B.fixed_total_compositions(requests(s, d), 4, "limit", "total")


def shifted_rows(s, d):
    """Spacer lengths per locus and direction, derived from the panel number."""
    p = V.panel_seqs(s, d)
    return p.select(
        "panel_id", "i", F.col("f_bind").alias("seq"),
        F.pmod(F.col("panel_id") * 7 + F.col("i") * 3, F.lit(5)).cast("int").alias("spacer"),
    )


def shifted_panels(s, d):
    rows = shifted_rows(s, d)
    ordered = F.array_sort(F.collect_list(F.struct("i", "seq", "spacer")))
    return rows.groupBy("panel_id").agg(ordered.alias("x")).select(
        "panel_id", F.transform("x", lambda x: x["seq"]).alias("seqs"),
        F.transform("x", lambda x: x["spacer"]).alias("spacers"),
    )


def pool(s, d):
    """Pools with hash-made spacers of the derived lengths."""
    def spacer(tag):
        digest = F.translate(
            F.md5(F.concat_ws(":", F.lit(tag), F.col("panel_id").cast("string"), F.col("i").cast("string"))),
            "0123456789abcdef", "ACGTACGTACGTACGT",
        )
        return F.substring(digest, F.lit(1), F.col("spacer"))

    spacers = shifted_rows(s, d).select("panel_id", "i", spacer("f").alias("f_spacer"), spacer("r").alias("r_spacer"))
    return M.assemble_pool(V.panel_seqs(s, d), spacers, ["panel_id"])


def energies(s, d):
    return M.all_pairs_energy(M.pool_oligos(pool(s, d), ["panel_id"]), ["panel_id"])


def best_pool(s, d):
    """Best of four random pools per panel: spacers, primers, energies, scores."""
    parts = V.panel_seqs(s, d)
    lengths = shifted_panels(s, d)
    reverse = M.panel_rows(parts, "r_bind").join(lengths.select("panel_id", "spacers"), "panel_id")
    f = M.random_balanced_spacers(lengths, 4, "f").withColumnRenamed("spacer", "f_spacer")
    r = M.random_balanced_spacers(reverse, 4, "r").withColumnRenamed("spacer", "r_spacer")
    keys = ["panel_id", "pool"]
    pools = cut_lineage(M.assemble_pool(parts, f.join(r, [*keys, "i"]), keys))
    loci = pools.groupBy(*keys).agg((F.max("i") + 1).alias("n_loci"))
    scores = M.pool_score(M.all_pairs_energy(M.pool_oligos(pools, keys), keys), keys, loci)
    return pools.join(M.best_pool(scores), keys)


def filled_columns(s, d):
    """Diversity of every spacer column after filling at random."""
    filled = M.random_balanced_spacers(shifted_panels(s, d), 3, "seed")
    whole = filled.join(shifted_rows(s, d), ["panel_id", "i"]).withColumn("whole", F.concat(filled["spacer"], "seq"))
    width = shifted_rows(s, d).groupBy("panel_id").agg(F.max("spacer").alias("width"))
    cells = whole.join(width, "panel_id").where("width > 0").select(
        "panel_id", "pool", F.col("whole"), F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col")
    )
    base = F.substring("whole", F.col("col") + 1, F.lit(1))
    counts = cells.groupBy("panel_id", "pool", "col").agg(
        *[F.count_if(base == b).alias(b) for b in "ATCG"]
    )
    return counts.select(
        "panel_id", "pool", "col",
        M.column_diversity(F.lit(0).cast("bigint"), F.array("A", "T", "C", "G")).alias("diversity"),
    )


def base_counts(s, d):
    line = F.col("l_linenumber")
    return V.table(s, d, "lineitem").groupBy("l_partkey").agg(
        F.count_if(line == 1).alias("u"), F.count_if(line == 2).alias("a"), F.count_if(line == 3).alias("t"),
        F.count_if(line == 4).alias("g"), F.count_if(line > 4).alias("c"),
    )


def designs(s, d):
    """Every template locus in turn, one a supplier, at one of two rigours."""
    loci = D.template_sets(s).withColumn("n", F.row_number().over(Window.orderBy("name", "i")) - 1)
    key = F.col("s_suppkey")
    return V.table(s, d, "supplier").select(
        key.cast("string").alias("design"), F.pmod(key, F.lit(20)).cast("int").alias("n"), F.when(F.pmod(key, F.lit(3)) == 0, -199).otherwise(-399).alias("rigour")
    ).join(F.broadcast(loci), "n").select("design", "rigour", "name", "i", "f_adapt", "r_adapt", "f_bind", "r_bind")  # twenty template loci


def genset_batch(s, d):
    """The best pair of four-copy sets of every design, as numbered primers."""
    own = designs(s, d)
    found = FC.four_copy_design(own, N_COPIES_HETERO, N_COPIES_HETERO, "seed")
    primers = F.posexplode_outer(F.arrays_zip("f_primers", "r_primers")).alias("k", "p")
    return own.select("design", "name", "i", "rigour").join(by_shuffle(found), "design").select(
        "design", "name", "i", "rigour", "reason", "score", "n_drawn", "n_compared", "n_scored", primers
    ).select("design", "name", "i", "rigour", "reason", "score", "n_drawn", "n_compared", "n_scored", "k", "p.f_primers", "p.r_primers").withColumnsRenamed(
        {"f_primers": "f_primer", "r_primers": "r_primer"}
    )


def genset_rules(s, d):
    own = cut_lineage(designs(s, d))
    return FC.design_rules(cut_lineage(FC.four_copy_design(own, N_COPIES_HETERO, N_COPIES_HETERO, "seed")), own)


def elimination(s, d):
    return H.successive_elimination(matrix(s, d), ["run"], 35, 3, 2, 35).select("run", "f", "r")


def text(column):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


QUERIES = {
    "compatible_shift_edges": lambda s, d: H.compatible_shift_edges(V.bindings(s, d), N_HETERO, LIMIT).select("seq_id", "a", "b"),
    "spacer_length_combos": lambda s, d: combos(s, d).select("seq_id", *COMBO),
    "rank_spacer_combos": lambda s, d: H.rank_spacer_combos(combos(s, d)).select("seq_id", *COMBO, "rank", "combo_score"),
    "vacant_columns": lambda s, d: H.vacant_columns(best(s, d), ["seq_id"]),
    "allowed_column_bases": lambda s, d: H.allowed_column_bases(best(s, d), ["seq_id"]),
    "random_spacer_sets": lambda s, d: H.random_spacer_sets(best(s, d), 3, "seed").select("seq_id", "set_id", "k", "spacer"),
    "random_spacer_invariants": lambda s, d: H.random_spacer_invariants(
        H.random_spacer_sets(best(s, d), 3, "seed"), ["seq_id"], N_HETERO),
    "spacer_space_size": lambda s, d: best(s, d).select("seq_id", H.spacer_space_size().alias("space")),
    "spacer_space_by_gc": lambda s, d: H.spacer_space_by_gc(V.bindings(s, d), N_HETERO, LIMIT).select(
        "band", "n", *six("mean_space"), F.round("sd_space", 3).alias("sd_space")),
    "self_dimer_scores": lambda s, d: H.self_dimer_scores(primers(s, d), PRIMER),
    "self_dimer_energy_scores": lambda s, d: H.self_dimer_scores(primers(s, d), PRIMER, by_energy=True),
    "pair_dimer_scores": pair_scores,
    "pair_dimer_energy_scores": lambda s, d: H.pair_dimer_scores(primers(s, d), LOCUS, by_energy=True),
    "inherent_dimer_scores": lambda s, d: H.inherent_dimer_scores(fixed_parts(s, d), ["panel_id", "i"]),
    "variance_penalised_score": lambda s, d: H.self_dimer_scores(primers(s, d), PRIMER).groupBy(
        "locus", "dir", "set_no", "criterion").agg(H.variance_penalised("score").alias("score")),
    "score_spacer_sets": set_scores,
    "trim_spacer_sets": lambda s, d: H.trim_spacer_sets(set_scores(s, d), LOCUS, 2),
    "pairing_scores": pairings,
    "best_pairing": best_pairings,
    "halfset_averages": lambda s, d: H.halfset_averages(matrix(s, d), ["run"]).select("run", "dir", "idx", *six("mean_score")),
    "successive_elimination": elimination,
    "score_matrix_pivot": lambda s, d: H.score_matrix_pivot(matrix(s, d), ["run"], list(range(35))).select(
        "run", "r", *six("mean_score"), *[f"f{i}" for i in range(35)]),
    "filter_summary": lambda s, d: H.filter_summary(set_scores(s, d), best_pairings(s, d), LOCUS).select(
        "locus", "n_sets", "n_compared", *six("avg_f", "avg_r", "avg_pair"), "min_f", "min_r", "min_pair", "best_f", "best_r", "best_pair"),
    "set_complementarity": complementarity,
    "simultaneous_filter": lambda s, d: H.simultaneous_filter(complementarity(s, d), ["locus", "dir"], 40.0),
    "cross_set_complementarity": lambda s, d: H.cross_set_complementarity(primers(s, d), LOCUS),
    "sampling_budget": lambda s, d: H.sampling_budget(
        V.table(s, d, "part").select("p_partkey", (F.col("p_size") - 25).alias("rigour"))),
    "random_baseline_sets": lambda s, d: H.random_baseline_sets(best(s, d), 2, "base").select("seq_id", "set_id", "k", "spacer", "perm_id"),
    "score_distribution": lambda s, d: H.score_distribution(matrix(s, d), ["run"], "score")[0],
    "score_distribution_stats": lambda s, d: H.score_distribution(matrix(s, d), ["run"], "score")[1].select(
        "run", *six("mean_score", "sd_score")),
    "criterion_registry": lambda s, d: V.oligo_pairs(s, d).select(
        "pair_id", S.encode_overlap("s1").alias("a"), S.encode_overlap("s2").alias("b")
    ).select("pair_id", H.weighted_criteria("a", "b").cast("bigint").alias("score")),
    "genset_batch": genset_batch,
    "genset_rules": genset_rules,
    # N sequences
    "column_diversity": lambda s, d: base_counts(s, d).select(
        "l_partkey", M.column_diversity(F.col("u"), F.array("a", "t", "g", "c")).alias("diversity")),
    "min_diversity": lambda s, d: shifted_panels(s, d).select(
        "panel_id", M.min_diversity(F.col("seqs"), F.col("spacers"), F.lit(8)).alias("score")),
    "fixed_total_compositions": lambda s, d: compositions(s, d).select("panel_id", "ord", text("combo")),
    "all_spacer_vectors": lambda s, d: M.all_spacer_vectors(requests(s, d).select("panel_id"), 3, 3).select("panel_id", "ord", text("combo")),
    "count_compositions": lambda s, d: requests(s, d).select(
        "panel_id", M.count_compositions(F.lit(4), F.col("limit"), F.col("total")).alias("n")),
    "nth_compositions": lambda s, d: B.compositions_at(requests(s, d), 4, "limit", "total", 5).select("panel_id", "part", "range_size", text("combo")),
    "balanced_spacer_search": lambda s, d: B.balanced_spacer_search(mixed_panels(s, d), M_HETERO, M_LIMIT).select(
        "panel_id", text("combo"), "total", "n_balanced"),
    "smallest_max_spacer": lambda s, d: B.smallest_longest(mixed_panels(s, d), M_HETERO, M_LIMIT).select(
        "panel_id", text("combo"), "longest", "total"),
    "smallest_total_wide": lambda s, d: B.smallest_total(panels_of(s, d, 9), WIDE_HETERO, WIDE_LIMIT).select("panel_id", text("combo"), "total"),
    "smallest_longest_wide": lambda s, d: B.smallest_longest(panels_of(s, d, 9), WIDE_HETERO, WIDE_LIMIT).select(
        "panel_id", text("combo"), "longest", "total"),
    "sampled_spacer_search": lambda s, d: B.sampled_search(mixed_panels(s, d), M_HETERO, M_LIMIT, 6, "seed").select(
        "panel_id", text("combo"), "total", "score"),
    "drawn_compositions": lambda s, d: drawn(s, d).select("panel_id", "draw", text("combo")),
    "sampled_spacer_invariants": lambda s, d: drawn(s, d).select(
        "panel_id", "draw", F.aggregate("combo", F.lit(0), lambda a, x: a + x).alias("total"), (F.array_max("combo") <= M_HETERO).alias("within")),
    "spacer_landscape": lambda s, d: B.spacer_landscape(mixed_panels(s, d), M_HETERO, M_LIMIT).select(
        "panel_id", text("combo"), *six("mean_length", "sd_length"), "score"),
    "spacer_landscape_by_total": lambda s, d: B.landscape_by_total(B.spacer_landscape(panels_of(s, d, 7), M_HETERO, M_LIMIT)).select(
        "panel_id", "total", "n_vectors", "best_score", *six("mean_score")),
    "hetero_alignment": lambda s, d: M.hetero_alignment(shifted_rows(s, d)),
    "column_base_quota": lambda s, d: M.column_base_quota(M.hetero_alignment(shifted_rows(s, d))),
    "random_balanced_spacers": lambda s, d: M.random_balanced_spacers(shifted_panels(s, d), 3, "seed"),
    "random_balanced_invariants": filled_columns,
    "assemble_pool": pool,
    "all_pairs_energy": lambda s, d: energies(s, d).select("panel_id", "i", "j", *six("energy")),
    "pool_score": lambda s, d: M.pool_score(
        energies(s, d), ["panel_id"], pool(s, d).groupBy("panel_id").agg((F.max("i") + 1).alias("n_loci"))
    ).select("panel_id", *six("score")),
    "best_pool": lambda s, d: best_pool(s, d).select("panel_id", "pool", "i", "f_primer", "r_primer", *six("score")),
}

# --- SQL ---------------------------------------------------------------------------

_EDGE = {
    "mk": "SELECT seq_id, seq, regexp_replace(seq,'[^ATCG]','I','g') AS m FROM v_binding",
    "ab": f"SELECT a, b FROM (SELECT unnest(range(0,{LIMIT}+1)) AS a), (SELECT unnest(range(0,{LIMIT}+1)) AS b) WHERE a <= b",
    "clash": f"""SELECT DISTINCT seq_id, a, b FROM (SELECT seq_id, m, a, b, unnest(range(0,{N_HETERO}-b)) AS p FROM mk, ab)
      WHERE p+b-a >= length(m) OR (substr(m,p+1,1)=substr(m,p+b-a+1,1) AND substr(m,p+1,1)<>'I')""",
    "ed": "SELECT seq_id, seq, m, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM mk, ab WHERE NOT EXISTS (SELECT 1 FROM clash c WHERE c.seq_id=mk.seq_id AND c.a=ab.a AND c.b=ab.b)",
}
_COMBO = {
    **_EDGE,
    "co": """SELECT e12.seq_id, e12.seq, e12.m, e12.a AS s1, e12.b AS s2, e23.b AS s3, e34.b AS s4 FROM ed e12 JOIN ed e23 ON e23.seq_id=e12.seq_id AND e23.a=e12.b JOIN ed e34 ON e34.seq_id=e12.seq_id AND e34.a=e23.b
      JOIN ed e13 ON e13.seq_id=e12.seq_id AND e13.a=e12.a AND e13.b=e23.b JOIN ed e14 ON e14.seq_id=e12.seq_id AND e14.a=e12.a AND e14.b=e34.b JOIN ed e24 ON e24.seq_id=e12.seq_id AND e24.a=e12.b AND e24.b=e34.b""",
    "rk": """SELECT *, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY combo_score, s1, s2, s3, s4) AS INTEGER) AS rank FROM (
      SELECT *, CAST(4*s4*(s1+s2+s3+s4)*4*(4-len(list_distinct([s1,s2,s3,s4]))) AS INTEGER) AS combo_score FROM co)""",
    "be": "SELECT * FROM rk WHERE rank=1",
    "cp": "SELECT seq_id, m, s4, CAST(unnest([0,1,2,3]) AS INTEGER) AS k, unnest([s1,s2,s3,s4]) AS sp FROM be",
    "cc": "SELECT seq_id, m, s4, k, sp, col FROM (SELECT *, CAST(unnest(range(0,s4)) AS INTEGER) AS col FROM cp)",
}
_VB = ["v_binding"]
_PRIMERS = "SELECT locus, dir, set_no, k, adapter||spacer||binding AS p, length(adapter) AS l5, length(binding) AS l3 FROM v_spacer_sets"
_SELF = {
    "pm": _PRIMERS,
    **overlap_ctes("SELECT locus||':'||dir||':'||set_no||':'||k AS id, p AS a, p AS b, least(l5,l3) AS f_skip, least(l5,l3) AS r_skip FROM pm"),
    "sc0": """SELECT locus, dir, set_no, k, 'run' AS criterion, 3 AS weight, run AS score FROM pm JOIN ov_scores ON id=locus||':'||dir||':'||set_no||':'||k
      UNION ALL SELECT locus, dir, set_no, k, 'total', 1, total FROM pm JOIN ov_scores ON id=locus||':'||dir||':'||set_no||':'||k""",
    "sc": "SELECT locus, dir, set_no, k, criterion, weight, CAST(score AS BIGINT) AS score FROM sc0",
}


def _penalised(column: str) -> str:
    return f"""CAST(trunc(sum({column})/count(*)::DOUBLE + sqrt((count(*)*sum({column}*{column})-sum({column})*sum({column}))/(count(*)*(count(*)-1))::DOUBLE)/3) AS BIGINT)"""


_SETS = {
    **_SELF,
    "vp": f"SELECT locus, dir, set_no, criterion, weight, {_penalised('score')} AS s FROM sc GROUP BY 1,2,3,4,5",
    "ss": "SELECT locus, dir, set_no, CAST(1+sum(weight*s) AS BIGINT) AS set_score FROM vp GROUP BY 1,2,3",
}
_PAIR_IN = """SELECT f.locus||':'||f.set_no||':'||f.k||':'||r.set_no||':'||r.k AS id, f.p AS a, r.p AS b, least(f.l5,r.l5) AS f_skip, least(f.l3,r.l3) AS r_skip
  FROM pm2 f JOIN pm2 r ON f.locus=r.locus AND f.dir='F' AND r.dir='R'"""


def _second(ctes: dict[str, str]) -> dict[str, str]:
    import re

    out = {}
    for name, body in ctes.items():
        for old in ctes:
            body = re.sub(rf"\b{old}\b", f"{old}2", body)
        out[f"{name}2"] = body
    return out


_PAIRS = {
    "pm2": _PRIMERS,
    **_second(overlap_ctes(_PAIR_IN)),
    "ps": """SELECT f.locus, f.set_no AS f_set, f.k AS f_k, r.set_no AS r_set, r.k AS r_k, criterion, weight, CAST(CASE criterion WHEN 'run' THEN run ELSE total END AS BIGINT) AS score
      FROM pm2 f JOIN pm2 r ON f.locus=r.locus AND f.dir='F' AND r.dir='R' JOIN ov_scores2 ON id=f.locus||':'||f.set_no||':'||f.k||':'||r.set_no||':'||r.k,
      (SELECT 'run' AS criterion, 3 AS weight UNION ALL SELECT 'total', 1)""",
    "perm": """SELECT CAST(row_number() OVER (ORDER BY a,b,c,d)-1 AS INTEGER) AS perm_id, [a,b,c,d] AS p FROM (SELECT unnest([0,1,2,3]) AS a), (SELECT unnest([0,1,2,3]) AS b), (SELECT unnest([0,1,2,3]) AS c), (SELECT unnest([0,1,2,3]) AS d)
      WHERE a<>b AND a<>c AND a<>d AND b<>c AND b<>d AND c<>d""",
    "pp": f"""SELECT locus, f_set, r_set, perm_id, CAST(sum(weight*s) AS BIGINT) AS score FROM (SELECT locus, f_set, r_set, perm_id, criterion, weight, {_penalised('score')} AS s
      FROM ps JOIN perm ON p[f_k+1]=r_k GROUP BY 1,2,3,4,5,6) GROUP BY 1,2,3,4""",
    "bpair": "SELECT locus, f_set, r_set, perm_id, score FROM (SELECT *, row_number() OVER (PARTITION BY locus, f_set, r_set ORDER BY score, perm_id DESC) AS rn FROM pp) WHERE rn=1",
}
_VS = ["v_spacer_sets"]
_MAT = {"mx": "SELECT run, f, r, CAST(floor(score) AS BIGINT) AS score FROM v_score_matrix"}


def _contained(source: str) -> dict[str, str]:
    """source(id, o, q): shorter complemented in place inside the longer, last offset left out."""
    return {
        "cn_in": source,
        "cn_ls": "SELECT id, CASE WHEN length(q)>=length(o) THEN q ELSE o END AS l, translate(CASE WHEN length(q)>=length(o) THEN o ELSE q END,'ATCG','TAGC') AS s FROM cn_in",
        "cn_c": "SELECT id, o, i FROM (SELECT id, l, s, o, unnest(range(1,length(s)+1)) AS i FROM (SELECT *, unnest(range(0,length(l)-length(s))) AS o FROM cn_ls)) WHERE substr(l,CAST(i+o AS BIGINT),1)=substr(s,CAST(i AS BIGINT),1)",
        "cn_t": "SELECT id, max(c) AS total FROM (SELECT id, o, count(*) AS c FROM cn_c GROUP BY 1,2) GROUP BY 1",
        "cn_r": "SELECT id, max(c) AS run FROM (SELECT id, count(*) AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY id, o ORDER BY i) AS g FROM cn_c) GROUP BY id, o, g) GROUP BY 1",
    }


_SETCOMP = {
    "pm": "SELECT locus, dir, set_no, k, spacer, adapter||spacer||binding AS p FROM v_spacer_sets",
    **_contained("SELECT a.locus||':'||a.dir||':'||a.set_no||':'||a.k||':'||b.k AS id, reverse(a.spacer) AS o, b.p AS q FROM pm a JOIN pm b ON a.locus=b.locus AND a.dir=b.dir AND a.set_no=b.set_no"),
    "cs": """SELECT a.locus, a.dir, a.set_no, CAST(max(coalesce(total,0)) AS INTEGER) AS total, CAST(max(coalesce(run,0)) AS INTEGER) AS run FROM pm a JOIN pm b ON a.locus=b.locus AND a.dir=b.dir AND a.set_no=b.set_no
      LEFT JOIN cn_t t ON t.id=a.locus||':'||a.dir||':'||a.set_no||':'||a.k||':'||b.k LEFT JOIN cn_r r ON r.id=a.locus||':'||a.dir||':'||a.set_no||':'||a.k||':'||b.k GROUP BY 1,2,3""",
}
_XCOMP = {
    "pm": _SETCOMP["pm"],
    "xp": """SELECT f.locus, f.set_no AS f_set, r.set_no AS r_set, f.k AS fk, r.k AS rk, f.spacer AS fs, r.spacer AS rs, f.p AS fp, r.p AS rp FROM pm f JOIN pm r ON f.locus=r.locus AND f.dir='F' AND r.dir='R'""",
    **_contained("SELECT locus||':'||f_set||':'||r_set||':'||fk||':'||rk||'a' AS id, fs AS o, rp AS q FROM xp UNION ALL SELECT locus||':'||f_set||':'||r_set||':'||fk||':'||rk||'b', rs, fp FROM xp"),
}

# Water-filling in closed form: the highest level the unassigned copies can reach, and the rest.
def _diversity(source: str, keys: str) -> str:
    return f"""SELECT {keys}, CAST(floor(round(list_reduce(list_transform(list_sort(list_transform([a,t,g,c], lambda x: greatest(x, lvl))), lambda x, i: greatest((x + CASE WHEN i <= rem THEN 1 ELSE 0 END)*100.0::DOUBLE/n, 1.0::DOUBLE)), lambda p, q: p*q),6)) AS BIGINT) AS diversity
 FROM (SELECT *, u - (greatest(lvl-a,0)+greatest(lvl-t,0)+greatest(lvl-g,0)+greatest(lvl-c,0)) AS rem FROM (
  SELECT *, (SELECT max(l) FROM (SELECT unnest(range(0, u+a+t+g+c+1)) AS l) WHERE greatest(l-a,0)+greatest(l-t,0)+greatest(l-g,0)+greatest(l-c,0) <= u) AS lvl, u+a+t+g+c AS n FROM {source}))"""


_BC = {"bc": "SELECT l_partkey, count(*) FILTER (l_linenumber=1) AS u, count(*) FILTER (l_linenumber=2) AS a, count(*) FILTER (l_linenumber=3) AS t, count(*) FILTER (l_linenumber=4) AS g, count(*) FILTER (l_linenumber>4) AS c FROM lineitem GROUP BY 1"}
_SHIFT = {
    "sr": "SELECT panel_id, i, f_bind AS seq, CAST((panel_id*7+i*3)%5 AS INTEGER) AS spacer FROM v_panel_seqs",
    "wd": "SELECT panel_id, max(spacer) AS width FROM sr GROUP BY 1",
}


def _cells(width: str) -> str:
    return f"SELECT panel_id, i, CAST(col AS INTEGER) AS col, CASE WHEN col < spacer THEN '-' ELSE substr(seq, col-spacer+1, 1) END AS base FROM (SELECT sr.*, unnest(range(0,{width})) AS col FROM sr JOIN wd USING (panel_id))"


_COUNTED = "count(*) FILTER (base='-') AS u, count(*) FILTER (base='A') AS a, count(*) FILTER (base='T') AS t, count(*) FILTER (base='G') AS g, count(*) FILTER (base='C') AS c"
# Panels of three, four and five: all vectors of each size, and the best a column of so many copies can score.
_AXES = [f"(SELECT unnest(range(0,{M_LIMIT + 1})) AS {x})" for x in "abcde"]
_VECTORS = {
    "pn": "SELECT panel_id, list(f_bind ORDER BY i) AS qs, count(*) AS n FROM v_mixed_panels GROUP BY 1",
    "vc": " UNION ALL ".join(f"SELECT {n} AS n, [{','.join('abcde'[:n])}] AS s FROM {', '.join(_AXES[:n])}" for n in range(1, 6)),
    "cl": f"""SELECT panel_id, n, s, col, unnest(list_transform(range(1,n+1), lambda x: CASE WHEN col<s[x] THEN '-' ELSE substr(qs[x],col-s[x]+1,1) END)) AS base
      FROM pn JOIN vc USING (n), (SELECT unnest(range(0,{M_HETERO})) AS col)""",
    "cnt": f"SELECT panel_id, n, s, col, {_COUNTED} FROM cl GROUP BY 1,2,3,4",
    "kinds": "SELECT DISTINCT u, a, t, g, c FROM cnt",
    "dv": _diversity("kinds", "u, a, t, g, c"),
    "ld": "SELECT panel_id, n, s, min(diversity) AS score FROM cnt JOIN dv USING (u, a, t, g, c) GROUP BY 1,2,3",
    "bal": """SELECT *, CAST(list_sum(s) AS INTEGER) AS total, CAST(list_max(s) AS INTEGER) AS longest, list_reverse(s) AS rev
      FROM ld WHERE score >= [100, 2500, 37037, 390625, 320000][n]""",
}
_TUPLES = "(SELECT unnest([0,1,2,3,4]) AS a), (SELECT unnest([0,1,2,3,4]) AS b), (SELECT unnest([0,1,2,3,4]) AS c), (SELECT unnest([0,1,2,3,4]) AS d)"
_COMPS = {
    "rq": "SELECT DISTINCT panel_id, panel_id%13 AS total FROM v_panel_seqs",
    "cm": f"SELECT panel_id, total, a||','||b||','||c||','||d AS combo, CAST(row_number() OVER (PARTITION BY panel_id ORDER BY d,c,b,a)-1 AS INTEGER) AS ord FROM rq, {_TUPLES} WHERE a+b+c+d=total",
}
_DNA = "'0123456789abcdef','ACGTACGTACGTACGT'"
_POOL = {
    "pl": f"""SELECT panel_id, i, f_adapt||substr(translate(md5('f:'||panel_id||':'||i),{_DNA}),1,sp)||f_bind AS f_primer, r_adapt||substr(translate(md5('r:'||panel_id||':'||i),{_DNA}),1,sp)||r_bind AS r_primer
      FROM (SELECT *, (panel_id*7+i*3)%5 AS sp FROM v_panel_seqs)""",
    "ol": "SELECT panel_id, i AS idx, f_primer AS p FROM pl UNION ALL SELECT panel_id, i + (SELECT max(i)+1 FROM pl x WHERE x.panel_id=pl.panel_id), r_primer FROM pl",
    "op": "SELECT a.panel_id, a.idx AS i, b.idx AS j, a.p AS pa, b.p AS pb FROM ol a JOIN ol b ON a.panel_id=b.panel_id AND a.idx <= b.idx",
    **overlap_ctes("SELECT panel_id||':'||i||':'||j AS id, pa AS a, pb AS b, 0 AS f_skip, 0 AS r_skip FROM op"),
    "oe": "SELECT panel_id, i, j, e/100.0::DOUBLE AS energy FROM op JOIN ov_scores ON id=panel_id||':'||i||':'||j",
}
_VP = ["v_panel_seqs"]
def _elimination_sql(n: int, first: int, every: int, rounds: int) -> dict[str, str]:
    """One CTE per elimination: means of what has been played, then the survivors."""
    ctes = {"al0": f"SELECT *, (r-f+{n})%{n} AS visit FROM mx"}
    version, played = 0, []
    for i in range(rounds):
        if i >= first and (i - first) % every == 0:
            a, v = f"al{version}", version + 1
            ctes[f"seen{v}"] = " UNION ALL ".join(f"SELECT * FROM al{w} WHERE visit={j}" for j, w in played)
            for column in "fr":
                ctes[f"out{column}{v}"] = f"""SELECT run, {column} FROM (SELECT run, {column}, row_number() OVER (PARTITION BY run ORDER BY round(avg(score),9) DESC, {column}) AS rn
                  FROM seen{v} WHERE (run, {column}) IN (SELECT run, {column} FROM {a}) GROUP BY 1,2) WHERE rn=1"""
            ctes[f"al{v}"] = f"SELECT * FROM {a} WHERE (run, f) NOT IN (SELECT run, f FROM outf{v}) AND (run, r) NOT IN (SELECT run, r FROM outr{v})"
            version = v
        played.append((i, version))
    ctes["survivors"] = f"SELECT run, f, r FROM al{version}"
    return ctes


_HAIR = f"""SELECT id, coalesce(min(e),0) AS e FROM (SELECT id, d, g, sum(CASE WHEN rn > 1 THEN dg ELSE 0 END) AS e FROM (
    SELECT h.*, row_number() OVER (PARTITION BY id, d, g ORDER BY i) AS rn FROM (SELECT id, s, i, d, i - row_number() OVER (PARTITION BY id, d ORDER BY i) AS g FROM (
      SELECT x.id, x.s, x.i, x.i+y.i AS d FROM hb x JOIN hb y ON x.id=y.id AND y.i-x.i > 3 AND y.base = translate(x.base,'ATCG','TAGC'))) h) LEFT JOIN {_STEPS} ON step = substr(s,CAST(i-1 AS BIGINT),2) GROUP BY 1,2,3) GROUP BY 1"""

ORACLE = {
    "compatible_shift_edges": duck_with(_VB, "SELECT seq_id, a, b FROM ed", _EDGE),
    "spacer_length_combos": duck_with(_VB, "SELECT seq_id, s1, s2, s3, s4 FROM co", _COMBO),
    "rank_spacer_combos": duck_with(_VB, "SELECT seq_id, s1, s2, s3, s4, rank, combo_score FROM rk", _COMBO),
    "vacant_columns": duck_with(_VB, "SELECT seq_id, col, k FROM cc WHERE col < sp", _COMBO),
    "allowed_column_bases": duck_with(_VB, """SELECT DISTINCT seq_id, col, base FROM cc, (SELECT unnest(['A','T','C','G']) AS base)
  WHERE NOT EXISTS (SELECT 1 FROM cc x WHERE x.seq_id=cc.seq_id AND x.col=cc.col AND x.col>=x.sp AND substr(x.m,x.col-x.sp+1,1)=base)""", _COMBO),
    "random_spacer_invariants": duck_with(_VB, "SELECT DISTINCT seq_id, set_id, col, true AS fits, CAST(0 AS BIGINT) AS repeats FROM cc, (SELECT CAST(unnest([0,1,2]) AS INTEGER) AS set_id)", _COMBO),
    "spacer_space_size": duck_with(_VB, "SELECT seq_id, pow(24.0::DOUBLE,s1)*pow(6.0::DOUBLE,s2-s1)*pow(2.0::DOUBLE,s3-s2) AS space FROM be", _COMBO),
    "spacer_space_by_gc": duck_with(_VB, """SELECT band, count(*) AS n, round(avg(space),6) AS mean_space, round(stddev_samp(space),3) AS sd_space FROM (
  SELECT CAST(least(floor(length(regexp_replace(seq,'[^GC]','','g'))/length(seq)::DOUBLE*10),9) AS INTEGER) AS band, pow(24.0::DOUBLE,s1)*pow(6.0::DOUBLE,s2-s1)*pow(2.0::DOUBLE,s3-s2) AS space FROM be) GROUP BY 1""", _COMBO),
    "self_dimer_scores": duck_with(_VS, "SELECT * FROM sc", _SELF),
    "self_dimer_energy_scores": duck_with(_VS, """SELECT locus, dir, set_no, k, 'homodimer' AS criterion, 4 AS weight, CAST(-trunc(e/100.0::DOUBLE) AS BIGINT) AS score FROM pm JOIN ov_scores ON id=locus||':'||dir||':'||set_no||':'||k
  UNION ALL SELECT locus, dir, set_no, k, 'hairpin', 1, CAST(-trunc(coalesce(hp.e,0)/100.0::DOUBLE) AS BIGINT) FROM pm LEFT JOIN hp ON id=locus||':'||dir||':'||set_no||':'||k""", {
        "pm": _PRIMERS,
        **overlap_ctes("SELECT locus||':'||dir||':'||set_no||':'||k AS id, p AS a, p AS b, 0 AS f_skip, 0 AS r_skip FROM pm"),
        "hb": "SELECT locus||':'||dir||':'||set_no||':'||k AS id, p AS s, unnest(range(1,length(p)+1)) AS i, unnest(string_split(p,'')) AS base FROM pm",
        "hp": _HAIR,
    }),
    "pair_dimer_scores": duck_with(_VS, "SELECT * FROM ps", _PAIRS),
    "pair_dimer_energy_scores": duck_with(_VS, """SELECT locus, f_set, f_k, r_set, r_k, 'heterodimer' AS criterion, 1 AS weight, CAST(-trunc(e/100.0::DOUBLE) AS BIGINT) AS score FROM pq JOIN ov_scores USING (id)""", {
        "pm2": _PRIMERS,
        "pq": """SELECT f.locus||':'||f.set_no||':'||f.k||':'||r.set_no||':'||r.k AS id, f.locus, f.set_no AS f_set, f.k AS f_k, r.set_no AS r_set, r.k AS r_k, f.p AS a, r.p AS b
          FROM pm2 f JOIN pm2 r ON f.locus=r.locus AND f.dir='F' AND r.dir='R'""",
        **overlap_ctes("SELECT id, a, b, 0 AS f_skip, 0 AS r_skip FROM pq")}),
    "inherent_dimer_scores": duck_with(_VP, "SELECT panel_id, i, CAST(max(run) AS INTEGER) AS run, CAST(max(total) AS INTEGER) AS total FROM ii JOIN ov_scores USING (id) GROUP BY 1,2", {
        "ii": """SELECT panel_id||':'||i||':'||k AS id, panel_id, i, a, b FROM (SELECT panel_id, i, 1 AS k, f_adapt AS a, r_adapt AS b FROM v_panel_seqs UNION ALL SELECT panel_id, i, 2, f_adapt, r_bind FROM v_panel_seqs
          UNION ALL SELECT panel_id, i, 3, f_bind, r_adapt FROM v_panel_seqs UNION ALL SELECT panel_id, i, 4, f_bind, r_bind FROM v_panel_seqs)""",
        **overlap_ctes("SELECT id, a, b, 0 AS f_skip, 0 AS r_skip FROM ii")}),
    "variance_penalised_score": duck_with(_VS, "SELECT locus, dir, set_no, criterion, s AS score FROM vp", _SETS),
    "score_spacer_sets": duck_with(_VS, "SELECT * FROM ss", _SETS),
    "trim_spacer_sets": duck_with(_VS, "SELECT locus, dir, set_no, set_score FROM (SELECT *, row_number() OVER (PARTITION BY locus, dir ORDER BY set_score, set_no) AS rn FROM ss) WHERE rn <= 2", _SETS),
    "pairing_scores": duck_with(_VS, "SELECT * FROM pp", _PAIRS),
    "best_pairing": duck_with(_VS, "SELECT * FROM bpair", _PAIRS),
    "halfset_averages": duck_with(["v_score_matrix"], "SELECT run, 'F' AS dir, f AS idx, round(avg(score),6) AS mean_score FROM mx GROUP BY 1,3 UNION ALL SELECT run, 'R', r, round(avg(score),6) FROM mx GROUP BY 1,3", _MAT),
    "successive_elimination": duck_with(["v_score_matrix"], "SELECT * FROM survivors", {**_MAT, **_elimination_sql(35, 3, 2, 35)}),
    "score_matrix_pivot": duck_with(["v_score_matrix"], "SELECT run, r, round(avg(score),6) AS mean_score, " + ", ".join(f"max(score) FILTER (f={i}) AS f{i}" for i in range(35)) + " FROM mx GROUP BY 1,2", _MAT),
    "filter_summary": duck_with(_VS, """SELECT x.locus, n_sets, n_compared, round(avg_f,6) AS avg_f, round(avg_r,6) AS avg_r, round(avg_pair,6) AS avg_pair, min_f, min_r, min_pair, sf.set_score AS best_f, sr.set_score AS best_r, w.score AS best_pair FROM
  (SELECT locus, count(*) FILTER (dir='F') AS n_sets, avg(set_score) FILTER (dir='F') AS avg_f, avg(set_score) FILTER (dir='R') AS avg_r, min(set_score) FILTER (dir='F') AS min_f, min(set_score) FILTER (dir='R') AS min_r FROM ss GROUP BY 1) x
  JOIN (SELECT locus, count(DISTINCT f_set) AS n_compared, avg(score) AS avg_pair, min(score) AS min_pair FROM bpair GROUP BY 1) y ON x.locus=y.locus
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY score, f_set, r_set) AS rn FROM bpair) WHERE rn=1) w ON w.locus=x.locus
  JOIN ss sf ON sf.locus=x.locus AND sf.dir='F' AND sf.set_no=w.f_set JOIN ss sr ON sr.locus=x.locus AND sr.dir='R' AND sr.set_no=w.r_set""", {**_SETS, **_PAIRS}),
    "set_complementarity": duck_with(_VS, "SELECT * FROM cs", _SETCOMP),
    "simultaneous_filter": duck_with(_VS, """SELECT locus, dir, set_no, total, run FROM (SELECT *, row_number() OVER (PARTITION BY locus, dir ORDER BY run, set_no) AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY locus, dir ORDER BY total, set_no) AS a FROM cs) WHERE a <= floor(3-3*30.0/100)) WHERE b <= floor(3-2*3*30.0/100)""", _SETCOMP),
    "cross_set_complementarity": duck_with(_VS, """SELECT locus, f_set, r_set, CAST(max(coalesce(total,0)) AS INTEGER) AS score FROM xp LEFT JOIN cn_t t ON t.id IN (locus||':'||f_set||':'||r_set||':'||fk||':'||rk||'a', locus||':'||f_set||':'||r_set||':'||fk||':'||rk||'b') GROUP BY 1,2,3"""
        .replace("xp LEFT JOIN cn_t t ON t.id IN (locus||':'||f_set||':'||r_set||':'||fk||':'||rk||'a', locus||':'||f_set||':'||r_set||':'||fk||':'||rk||'b')", "(SELECT *, locus||':'||f_set||':'||r_set||':'||fk||':'||rk||sfx AS id FROM xp, (SELECT unnest(['a','b']) AS sfx)) LEFT JOIN cn_t USING (id)"), _XCOMP),
    "sampling_budget": """SELECT p_partkey, p_size-25 AS rigour, CAST(CASE WHEN p_size>=25 THEN 1000*(abs(p_size-25)+1) ELSE floor(1000.0::DOUBLE/(abs(p_size-25)+1)) END AS BIGINT) AS n_random,
  CAST(trunc(CASE WHEN p_size>=25 THEN 35*pow(abs(p_size-25)+1,1/3.0::DOUBLE) ELSE 35/pow(abs(p_size-25)+1,1/3.0::DOUBLE) END) AS BIGINT) AS n_compare FROM part""",
    "score_distribution": duck_with(["v_score_matrix"], "SELECT run, score AS bin, count(*) AS n FROM mx GROUP BY 1,2", _MAT),
    "score_distribution_stats": duck_with(["v_score_matrix"], "SELECT run, round(avg(score),6) AS mean_score, round(stddev_pop(score),6) AS sd_score FROM mx GROUP BY 1", _MAT),
    "criterion_registry": duck_with(["v_oligo_pairs"], "SELECT id AS pair_id, CAST(3*run+total AS BIGINT) AS score FROM ov_scores", overlap_ctes("SELECT pair_id AS id, s1 AS a, s2 AS b, 0 AS f_skip, 0 AS r_skip FROM v_oligo_pairs")),
    "genset_rules": """SELECT CAST(s_suppkey AS VARCHAR) AS design, 'designed' AS reason, CAST(CASE s_suppkey%3 WHEN 0 THEN floor(1000/200.0) ELSE floor(1000/400.0) END AS BIGINT) AS n_drawn,
  CAST(CASE s_suppkey%3 WHEN 0 THEN least(5, trunc(35/pow(200.0,1/3.0::DOUBLE))) ELSE least(2, trunc(35/pow(400.0,1/3.0::DOUBLE))) END AS BIGINT) AS n_compared, true AS whole, true AS scored FROM supplier""",
    "column_diversity": duck_with([], "SELECT l_partkey, diversity FROM dv", {**_BC, "dv": _diversity("bc", "l_partkey")}),
    "min_diversity": duck_with(_VP, "SELECT panel_id, min(diversity) AS score FROM dv GROUP BY 1", {
        **_SHIFT, "ce": _cells("8"), "ct": f"SELECT panel_id, col, {_COUNTED} FROM ce GROUP BY 1,2", "dv": _diversity("ct", "panel_id, col")}),
    "fixed_total_compositions": duck_with(_VP, "SELECT panel_id, ord, combo FROM cm", _COMPS),
    "all_spacer_vectors": duck_with(_VP, "SELECT panel_id, CAST(a+4*b+16*c AS BIGINT) AS ord, a||','||b||','||c AS combo FROM (SELECT DISTINCT panel_id FROM v_panel_seqs), (SELECT unnest([0,1,2,3]) AS a), (SELECT unnest([0,1,2,3]) AS b), (SELECT unnest([0,1,2,3]) AS c)"),
    "count_compositions": duck_with(_VP, "SELECT panel_id, count(*) AS n FROM cm GROUP BY 1", _COMPS),
    "nth_compositions": duck_with(_VP, """SELECT panel_id, part, CAST(nx-st AS INTEGER) AS range_size, combo FROM (SELECT panel_id, CAST(p AS INTEGER) AS part, floor(p*n/5.0) AS st, floor((p+1)*n/5.0) AS nx FROM (SELECT panel_id, count(*) AS n FROM cm GROUP BY 1), (SELECT unnest([0,1,2,3,4]) AS p))
  JOIN cm USING (panel_id) WHERE ord=st AND nx > st""", _COMPS),
    "balanced_spacer_search": duck_with(["v_mixed_panels"], """SELECT panel_id, array_to_string(s, ',') AS combo, total, n_balanced FROM (SELECT *, count(*) OVER (PARTITION BY panel_id) AS n_balanced, row_number() OVER (PARTITION BY panel_id ORDER BY total, rev) AS rn FROM bal) WHERE rn=1""", _VECTORS),
    "smallest_max_spacer": duck_with(["v_mixed_panels"], """SELECT panel_id, array_to_string(s, ',') AS combo, longest, total FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY longest, total, rev) AS rn FROM bal) WHERE rn=1""", _VECTORS),
    "drawn_compositions": duck_with(_VP, """SELECT panel_id, draw, combo FROM (
  SELECT panel_id, draw, total, CAST('0x'||substr(md5('seed:'||panel_id||':'||total||':'||draw),1,15) AS BIGINT) % (SELECT count(*) FROM dc WHERE dc.total=dr.total) AS ord FROM dr) JOIN dc USING (total, ord)""", {
        "dr": "SELECT panel_id, CAST(panel_id%9+2 AS INTEGER) AS total, draw FROM (SELECT DISTINCT panel_id FROM v_panel_seqs), (SELECT CAST(unnest([1,2,3,4,5,6]) AS INTEGER) AS draw)",
        "dc": f"""SELECT a+b+c+d AS total, a||','||b||','||c||','||d AS combo, row_number() OVER (PARTITION BY a+b+c+d ORDER BY d,c,b,a)-1 AS ord
          FROM {", ".join(f"(SELECT CAST(unnest(range(0,{M_HETERO + 1})) AS INTEGER) AS {x})" for x in "abcd")}"""}),
    "sampled_spacer_search": duck_with(["v_mixed_panels"], """SELECT panel_id, array_to_string(s, ',') AS combo, CAST(total AS INTEGER) AS total, score FROM (
  SELECT panel_id, s, list_sum(s) AS total, score, row_number() OVER (PARTITION BY panel_id ORDER BY score DESC, list_sum(s), list_reverse(s)) AS rn FROM ld JOIN (
    SELECT panel_id, n, s FROM (SELECT panel_id, n, total, CAST('0x'||substr(md5('seed:'||panel_id||':'||total||':'||draw),1,15) AS BIGINT) % (SELECT count(*) FROM tn WHERE tn.n=dr.n AND tn.total=dr.total) AS ord FROM dr) JOIN tn USING (n, total, ord)) USING (panel_id, n, s)) WHERE rn=1""", {
        **_VECTORS,
        "tn": "SELECT n, s, CAST(list_sum(s) AS INTEGER) AS total, row_number() OVER (PARTITION BY n, list_sum(s) ORDER BY list_reverse(s))-1 AS ord FROM vc",
        "dr": f"SELECT panel_id, n, total, draw FROM (SELECT panel_id, n, CAST(unnest(range(0, n*{M_LIMIT}+1)) AS INTEGER) AS total FROM pn), (SELECT CAST(unnest([1,2,3,4,5,6]) AS INTEGER) AS draw)"}),
    "sampled_spacer_invariants": duck_with(_VP, "SELECT panel_id, draw, CAST(panel_id%9+2 AS INTEGER) AS total, true AS within FROM (SELECT DISTINCT panel_id FROM v_panel_seqs), (SELECT CAST(unnest([1,2,3,4,5,6]) AS INTEGER) AS draw)"),
    "spacer_landscape": duck_with(["v_mixed_panels"], """SELECT panel_id, array_to_string(s, ',') AS combo, round(total/n::DOUBLE,6) AS mean_length,
  round(sqrt((n*squares-total*total)/nullif(n*(n-1),0)::DOUBLE),6) AS sd_length, score FROM (SELECT *, list_sum(s) AS total, list_sum(list_transform(s, lambda x: x*x)) AS squares FROM ld)""", _VECTORS),
    "spacer_landscape_by_total": duck_with(["v_panel_seqs"], """SELECT panel_id, CAST(total AS INTEGER) AS total, count(*) AS n_vectors, max(score) AS best_score, round(avg(score),6) AS mean_score FROM (
  SELECT panel_id, list_sum(s) AS total, score FROM ld) GROUP BY 1,2""", {
        "p7": "SELECT (panel_id*4+i)//7 AS panel_id, (panel_id*4+i)%7 AS i, f_bind FROM v_panel_seqs",
        "pn": "SELECT panel_id, list(f_bind ORDER BY i) AS qs, count(*) AS n FROM p7 GROUP BY 1 HAVING count(*)=7",
        "vc": f"SELECT 7 AS n, [a,b,c,d,e,f,g] AS s FROM {', '.join(f'(SELECT unnest(range(0,{M_LIMIT + 1})) AS {x})' for x in 'abcdefg')}",
        **{k: _VECTORS[k] for k in ("cl", "cnt", "kinds", "dv", "ld")}}),
    "hetero_alignment": duck_with(_VP, "SELECT * FROM ce", {**_SHIFT, "ce": _cells("width")}),
    "column_base_quota": duck_with(_VP, """SELECT panel_id, col, vacant, base, q AS quota, q < 0 AS overfull FROM (SELECT panel_id, col, vacant, b.base, CAST(ceil(n/4.0) AS BIGINT) - (SELECT count(*) FROM ce x WHERE x.panel_id=y.panel_id AND x.col=y.col AND x.base=b.base) AS q
  FROM (SELECT panel_id, col, count(*) AS n, count(*) FILTER (base='-') AS vacant FROM ce GROUP BY 1,2) y, (SELECT unnest(['A','T','C','G']) AS base) b)""", {**_SHIFT, "ce": _cells("width")}),
    "random_balanced_invariants": duck_with(_VP, "SELECT panel_id, pool, col, diversity FROM dv, (SELECT CAST(unnest([0,1,2]) AS INTEGER) AS pool)", {
        **_SHIFT, "ce": _cells("width"), "ct": f"SELECT panel_id, col, {_COUNTED} FROM ce GROUP BY 1,2", "dv": _diversity("ct", "panel_id, col")}),
    "assemble_pool": duck_with(_VP, "SELECT * FROM pl", _POOL),
    "all_pairs_energy": duck_with(_VP, "SELECT panel_id, i, j, round(energy,6) AS energy FROM oe", _POOL),
    "pool_score": duck_with(_VP, "SELECT panel_id, round(avg(energy),6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY energy, i, j) AS rn FROM oe) JOIN (SELECT panel_id, max(i)+1 AS nl FROM pl GROUP BY 1) USING (panel_id) WHERE rn <= floor(nl*nl/2) GROUP BY 1", _POOL),
}
