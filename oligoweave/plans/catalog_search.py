"""Registered candidate, scoring and panel-search queries and their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from oligoweave.functions import dimensions as D
from oligoweave.operators import candidates as C
from oligoweave.operators import length_walk as L
from oligoweave.operators import profile as P
from oligoweave.operators import quality as Q
from oligoweave.operators import scoring as G
from oligoweave.operators import threshold_join as T
from oligoweave.plans import panel_search as PS
from oligoweave.plans import views as V
from oligoweave.plans.catalog_sequences import _TM, overlap_ctes
from oligoweave.plans.views import duck_with
from oligoweave.session import cut_lineage, scratch_path
from oligoweave.sources import sinks as K

TARGET = C.TARGET
PAIR = G.PAIR


def dense_targets(spark, sf_dir):
    """One target per document on 5000-column alignments: many meet their neighbours."""
    d = F.col("doc_id")
    p = F.pmod(d * 29, F.lit(5000)).cast("int")
    return V.table(spark, sf_dir, "documents").select(
        F.floor(d / 250).cast("bigint").alias("panel_id"),
        F.concat(F.lit("d"), d.cast("string")).alias("target"),
        F.floor(d / V.ALIGNMENT_ROWS).cast("bigint").alias("aln_id"),
        F.array(p, p + 3).alias("sites"),
        (F.pmod(d, F.lit(10)) == 0).alias("overlap_ignore"),
    )


def dense_regions(spark, sf_dir):
    t = dense_targets(spark, sf_dir)
    values = {**V.PARAMS, "primer_primer_distance": 3}
    params = t.select("panel_id").distinct().select("panel_id", *[F.lit(v).alias(k) for k, v in values.items()])
    lengths = t.select("aln_id", F.lit(5000).alias("aln_len")).distinct()
    return C.designate_regions(t, params, lengths)


def raw_inputs(spark, sf_dir) -> PS.PanelInputs:
    profiles = P.profile(V.alignments(spark, sf_dir))
    return PS.PanelInputs(
        V.targets(spark, sf_dir), V.params(spark, sf_dir), V.panel_adapters(spark, sf_dir),
        profiles, P.alignment_lengths(profiles),
    )


class Search:
    """The stages of the first search step over all targets, each built once per query."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def inputs(self):
        return raw_inputs(self.spark, self.sf_dir).written()

    @cached_property
    def windows(self):
        return cut_lineage(PS.planned_windows(self.inputs))

    @cached_property
    def singles(self):
        return C.enumerate_single_regions(self.windows, self.inputs.profiles)

    @cached_property
    def written_singles(self):
        return cut_lineage(self.singles)

    @cached_property
    def open_windows(self):
        return C.open_length_windows(self.windows)

    @cached_property
    def pairs(self):
        return C.enumerate_pairs(self.open_windows, self.written_singles)

    @cached_property
    def temperatures(self):
        return G.panel_temperatures(self.inputs.params, None)

    @cached_property
    def judged(self):
        return G.judged(C.enumerate_pairs(self.open_windows.join(self.temperatures, "panel_id"), self.written_singles, G.LIMITS))

    @cached_property
    def kept(self):
        return G.top_n_conserved(self.judged)

    @cached_property
    def close(self):
        return G.near_best(cut_lineage(G.valid_pairs(self.judged)))

    @cached_property
    def partners(self):
        return G.panel_partners(self.inputs.adapters, None, self.inputs.targets)

    @cached_property
    def steps(self):
        """Length adjustment of every length combination of every target."""
        tried = C.enumerate_pairs(C.length_grid_windows(self.windows), self.written_singles, ["f_try", "r_try"])
        judged = G.judged_pairs(tried, self.inputs.params, self.temperatures)
        limits = self.windows.select(*TARGET, "binding_len_min", "binding_len_max", "ideal_binding_size")
        return G.next_lengths(G.rejection_counters(judged, [*TARGET, "f_try", "r_try"]).join(limits, TARGET))

    @cached_property
    def penalties(self):
        return cut_lineage(G.scored_single_regions(self.written_singles, self.inputs.adapters))

    @cached_property
    def best_pairs(self):
        """Best pairs over all combinations of binding lengths."""
        return T.best_pairs(self.open_windows, self.written_singles, self.inputs.adapters, 25)


def search(build):
    return lambda spark, sf_dir: build(Search(spark, sf_dir))


def chosen_fixture(spark, sf_dir):
    """A pair already chosen for the first target of every alignment."""
    t = V.targets(spark, sf_dir).where(F.col("target").endswith("_0"))
    return t.select("panel_id", "aln_id", F.lit(8).alias("f_5p"), F.lit(50).alias("r_5p"))


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


def region_report(x):
    """The report of the pairs selected first, written and read back."""
    picked = G.select_pair(G.dimer_scored(x.close, x.partners)).withColumn("score", F.round("score", 6))
    path = scratch_path(x.spark, "report")
    K.sink_binding_report(picked, path)
    return x.spark.read.schema(K.binding_report(picked).schema).json(path)


def panel_rules(spark, sf_dir):
    """Whether each chosen pair keeps the rules it was chosen under."""
    raw = raw_inputs(spark, sf_dir).written()
    picked = cut_lineage(PS.greedy_panel_selection(raw))
    longest = F.col("binding_len_max") - F.col("binding_len_min")
    rows = picked.join(C.restricted_windows(PS.planned_windows(raw)), [*TARGET, "aln_id"])
    inside = (
        F.col("f_5p").between(F.col("f_lo"), F.col("f_hi") + longest)
        & F.col("r_5p").between(F.col("r_lo") - longest, F.col("r_hi"))
        & (F.col("f_5p") + F.col("f_len") <= F.col("target_min"))
        & (F.col("r_5p") - F.col("r_len") >= F.col("target_max"))
        & (F.col("r_5p") - F.col("f_5p") + 1 <= F.col("max_binding_target_len"))
    )
    tm = (F.abs(F.col("f_tm") - F.col("r_tm")) <= F.col("max_tm_deviation")) & (
        F.abs(F.col("f_tm") - F.col("target_tm")) <= F.col("max_tm_deviation")
    )
    earlier = picked.select("panel_id", "aln_id", F.col("rank").alias("o_rank"), F.col("f_5p").alias("o_f"), F.col("r_5p").alias("o_r"))
    clash = picked.join(earlier, ["panel_id", "aln_id"]).where(
        (F.col("o_rank") < F.col("rank"))
        & (F.col("f_5p").between(F.col("o_f"), F.col("o_r")) | F.col("r_5p").between(F.col("o_f"), F.col("o_r")))
    ).select(*TARGET).distinct().withColumn("clash", F.lit(True))
    return rows.join(clash, TARGET, "left").select(
        *TARGET, inside.alias("inside"), tm.alias("tm_ok"),
        (G.S.gc_clamp("f_seq", "r_seq")).alias("clamp"), F.col("clash").isNull().alias("apart"),
    )


QUERIES = {
    "candidate_generators": lambda s, d: C.generate_regions(V.bindings(s, d), [8, 10, 12], ["seq_id"]),
    "greedy_panel_rules": panel_rules,
    "designate_regions": lambda s, d: C.designate_regions(
        V.targets(s, d), V.params(s, d), P.alignment_lengths(P.profile(V.alignments(s, d)))
    ).select(*TARGET, "target_min", "target_max", "min_forward", "max_forward", "min_reverse", "max_reverse",
             "minimal_start", "minimal_end", "designated_start", "designated_end"),
    "check_target_fits": lambda s, d: Q.check_target_fits(dense_regions(s, d)).select("target", "fits", "has_room"),
    "interval_overlap_join": lambda s, d: C.interval_overlap_join(dense_regions(s, d), 2),
    "classify_overlap": lambda s, d: C.classify_overlap(dense_regions(s, d)).select("target", "other", "overlap"),
    "nearest_neighbours": lambda s, d: C.nearest_neighbours(dense_regions(s, d)).select("target", "lower_end", "higher_start"),
    "allowable_windows": search(lambda x: x.windows.select(*TARGET, "f_lo", "f_hi", "r_lo", "r_hi")),
    "amplicon_band": search(lambda x: C.amplicon_band(x.windows, "ideal_binding_size", "ideal_binding_size").select(*TARGET, "amp_lo", "amp_hi")),
    "enumerate_single_regions": search(lambda x: x.singles.select(*TARGET, "side", "five_p", "len", "seq")),
    "enumerate_pairs": search(lambda x: x.pairs.select(*TARGET, *PAIR, "f_seq", "r_seq")),
    "count_pairs": search(lambda x: C.count_pairs(C.open_length_windows(x.windows)).select(*TARGET, "n_pairs")),
    "order_targets": lambda s, d: PS.ranked_windows(raw_inputs(s, d).written()).select(*TARGET, "n_pairs", "rank"),
    "prune_used_regions": search(lambda x: C.prune_used_regions(
        x.singles, chosen_fixture(x.spark, x.sf_dir).withColumn("reach", F.lit(3)), "reach", "five_p"
    ).select(*TARGET, "side", "five_p", "len")),
    "resize_windows": search(lambda x: C.length_grid_windows(x.windows).select(
        *TARGET, "f_try", "r_try", "f_hi", "r_lo", "amp_lo", "amp_hi")),
    "open_length_windows": search(lambda x: C.open_length_windows(x.windows).select(
        *TARGET, "f_lo", "f_hi", "r_lo", "r_hi", "amp_lo", "amp_hi", F.size("f_lens").alias("n_lens"))),
    "join_targets_alignments": lambda s, d: C.join_targets_alignments(V.targets(s, d), P.alignment_lengths(P.profile(V.alignments(s, d)))).select(
        *TARGET, "aln_id", "aln_len"),
    # scoring
    "conservation_weights": lambda s, d: V.table(s, d, "part").select(
        "p_partkey", (F.pmod("p_size", F.lit(46)) + 5).cast("int").alias("len")
    ).join(F.broadcast(D.conservation_weights(s)), "len").select(
        "p_partkey", "len", F.posexplode("weights").alias("i", "w")).select("p_partkey", "len", "i", *six("w")),
    "weighted_conservation": search(lambda x: x.singles.select(*TARGET, "side", "five_p", "len", *six("weighted"))),
    "mean_pair_conservation": search(lambda x: x.judged.select(*TARGET, *PAIR, *six("mean_conservation"))),
    "tm_deviation": search(lambda x: x.judged.select(*TARGET, *PAIR, *six("f_dev", "r_dev", "pair_dev"))),
    "tm_compatibility": search(lambda x: x.judged.select(*TARGET, *PAIR, "in_range", "f_high", "f_low", "r_high", "r_low")),
    "rejection_counters": search(lambda x: G.rejection_counters(x.judged).select(
        *TARGET, "total", "good", "n_f_high", "n_f_low", "n_r_high", "n_r_low", "n_no_gc", *six("mean_score", "max_score"))),
    "length_adjustment": search(lambda x: x.steps.select(*TARGET, "f_try", "r_try", "f_next", "r_next")),
    "adjusted_lengths": search(lambda x: L.walked_lengths(x.windows, x.written_singles, x.temperatures).drop("steps")),
    "visited_lengths": search(lambda x: L.walked_lengths(x.windows, x.written_singles, x.temperatures).select(
        *TARGET, F.posexplode("steps").alias("step", "s")).select(*TARGET, "step", "s.*")),
    "top_n_conserved": search(lambda x: x.kept.select(*TARGET, *PAIR, *six("score"))),
    "panel_dimer_structures": search(lambda x: G.panel_dimer_structures(x.close, x.partners).select(
        *TARGET, *PAIR, *six("energy"))),
    "worst_quartile_energy": search(lambda x: G.dimer_scored(x.close, x.partners).select(
        *TARGET, *PAIR, *six("dimer_score"))),
    "select_pair": search(lambda x: G.select_pair(G.dimer_scored(x.close, x.partners)).select(
        *TARGET, *PAIR, *six("score", "dimer_score"))),
    "select_pair_random_k": search(lambda x: G.select_pair_random_k(x.kept, 10, "seed").select(*TARGET, *PAIR, *six("score"))),
    "greedy_panel_selection": lambda s, d: PS.greedy_panel_selection(raw_inputs(s, d)).select(
        *TARGET, "aln_id", "rank", *PAIR, "f_seq", "r_seq", *six("f_tm", "r_tm", "score", "dimer_score")),
    "sink_binding_report": search(region_report),
    "overlap_dimer_score": lambda s, d: V.oligo_pairs(s, d).select(
        "pair_id", F.round(G.S.overlap_dimer_score("s1", "s2"), 6).alias("score")),
    "quad_dimer_score": lambda s, d: V.panel_seqs(s, d).select(
        "panel_id", "i", F.round(G.S.quad_dimer_score("f_adapt", "f_bind", "r_adapt", "r_bind"), 6).alias("score")),
    "region_penalty": search(lambda x: x.penalties.select(
        *TARGET, "side", "five_p", "len", "adapter", *six("penalty"))),
    "best_single_regions": search(lambda x: G.best_single_regions(
        x.penalties, 20
    ).select(*TARGET, "side", "five_p", "len", "adapter", *six("penalty"))),
    "best_region_pairs": search(lambda x: x.best_pairs.select(*TARGET, *PAIR, "adapter", *six("penalty"))),
    "tiered_pair_ranking": search(lambda x: G.tiered_pair_ranking(x.best_pairs, G.best_single_regions(x.penalties, 40), 10).select(*TARGET, *PAIR, "adapter", "tier", "position", *six("final_score"))),
}

# --- SQL ---------------------------------------------------------------------------

def _region_sql(source: str, length: int) -> str:
    return f"""SELECT *, designated_start-0 AS ds FROM (SELECT *, minimal_start - primer_primer_distance AS designated_start, minimal_end + primer_primer_distance AS designated_end FROM (
 SELECT *, least(max_forward+target_len_max+2*binding_len_max, {length}) AS max_reverse, greatest(min_reverse-target_len_max-2*binding_len_max,0) AS min_forward,
   max_forward-binding_len_max+1 AS minimal_start, min_reverse+binding_len_max-1 AS minimal_end FROM (
 SELECT *, target_max+1 AS min_reverse, target_min-1 AS max_forward FROM (
 SELECT *, least(site1,site2)-primer_target_distance AS target_min, greatest(site1,site2)+primer_target_distance AS target_max FROM {source}))))"""


_P = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" if isinstance(v, float) else f"{v} AS {k}" for k, v in V.PARAMS.items())
_W = V.ALIGNMENT_WIDTH
_DENSE = {
    "dt": f"""SELECT doc_id//250 AS panel_id, 'd'||doc_id AS target, doc_id//125 AS aln_id, CAST(doc_id*29%5000 AS INTEGER) AS site1, CAST(doc_id*29%5000+3 AS INTEGER) AS site2,
  doc_id%10=0 AS overlap_ignore, {_P.replace('0 AS primer_primer_distance', '3 AS primer_primer_distance')} FROM documents""",
    "dr": _region_sql("dt", 5000),
    "dp": """SELECT a.target, b.target AS other, CASE WHEN a.min_forward<=b.min_forward AND a.max_reverse<=b.max_reverse THEN 'h'
   WHEN a.min_forward>=b.min_forward AND a.max_reverse>=b.max_reverse THEN 'l' ELSE 'i' END AS overlap, b.designated_start AS bs, b.designated_end AS be
   FROM dr a JOIN dr b ON a.panel_id=b.panel_id AND a.aln_id=b.aln_id AND a.target<>b.target AND a.max_reverse>=b.min_forward AND b.max_reverse>=a.min_forward
   WHERE NOT (a.overlap_ignore AND b.overlap_ignore)""",
}
_CURVE_SQL = "CASE k " + " ".join(f"WHEN {i} THEN pow(({i}+3)/6.0::DOUBLE,{i}+3)+1" for i in range(5)) + " END"
_CURVE_SUM = "(" + "+".join(f"pow(({i}+3)/6.0::DOUBLE,{i}+3)+1" for i in range(5)) + ")"
_BASE = {
    "tp": "SELECT * FROM v_targets JOIN v_params USING (panel_id)",
    "reg": _region_sql("tp", _W),
    "nb": """SELECT a.*, (SELECT max(b.designated_end) FROM reg b WHERE b.panel_id=a.panel_id AND b.aln_id=a.aln_id AND b.target<>a.target AND a.max_reverse>=b.min_forward AND b.max_reverse>=a.min_forward
      AND NOT (a.min_forward<=b.min_forward AND a.max_reverse<=b.max_reverse) AND a.min_forward>=b.min_forward AND a.max_reverse>=b.max_reverse) AS lower_end,
    (SELECT min(b.designated_start) FROM reg b WHERE b.panel_id=a.panel_id AND b.aln_id=a.aln_id AND b.target<>a.target AND a.max_reverse>=b.min_forward AND b.max_reverse>=a.min_forward
      AND NOT (NOT (a.min_forward<=b.min_forward AND a.max_reverse<=b.max_reverse) AND a.min_forward>=b.min_forward AND a.max_reverse>=b.max_reverse)) AS higher_start FROM reg a""",
    "win": f"""SELECT *, greatest(min_forward-1, coalesce(lower_end,-1))+1 AS f_lo, max_forward-ideal_binding_size+1 AS f_hi, min_reverse+ideal_binding_size-1 AS r_lo,
    least(max_reverse, {_W}-1, coalesce(higher_start-1, max_reverse)) AS r_hi FROM nb""",
    "grid": """SELECT w.* REPLACE (f_hi-(f_try-ideal_binding_size) AS f_hi, r_lo+(r_try-ideal_binding_size) AS r_lo), f_try, r_try,
    greatest(target_len_min, min_reverse-max_forward-1)+f_try+r_try AS amp_lo, least(target_len_max+f_try+r_try+1, max_binding_target_len) AS amp_hi
    FROM win w, (SELECT CAST(unnest([8,9,10,11,12]) AS INTEGER) AS f_try), (SELECT CAST(unnest([8,9,10,11,12]) AS INTEGER) AS r_try)""",
    "opn": "SELECT * FROM grid WHERE f_try=12 AND r_try=12",
    "rst": "SELECT * FROM grid WHERE f_try=10 AND r_try=10",
}
_LENS = "(SELECT CAST(unnest([8,9,10,11,12]) AS INTEGER) AS len)"


def _singles_sql(source: str, lens: str) -> dict[str, str]:
    return {
        "wt": f"""SELECT len, i, CASE WHEN i >= len-5 THEN (SELECT {_CURVE_SQL} FROM (SELECT i-(len-5) AS k))/{_CURVE_SUM}*0.5::DOUBLE*(2-CASE WHEN len<=15 THEN (len-5)/10.0::DOUBLE ELSE 1 END)
     ELSE 0.5::DOUBLE*(CASE WHEN len<=15 THEN (len-5)/10.0::DOUBLE ELSE 1 END)/(len-5) END AS w FROM (SELECT len, unnest(range(0,len)) AS i FROM {_LENS})""",
        "s0": f"""SELECT panel_id, target, aln_id, 'F' AS side, five_p, len, five_p AS a FROM (SELECT *, unnest(range(f_lo, f_hi+1)) AS five_p FROM {source}), {lens} WHERE five_p+len <= {_W}
     UNION ALL SELECT panel_id, target, aln_id, 'R', five_p, len, five_p-len+1 FROM (SELECT *, unnest(range(r_lo, r_hi+1)) AS five_p FROM {source}), {lens} WHERE five_p-len+1 >= 0""",
        "s1": """SELECT panel_id, target, aln_id, side, five_p, s0.len, CASE side WHEN 'F' THEN string_agg(cons_base,'' ORDER BY pos) ELSE translate(string_agg(cons_base,'' ORDER BY pos DESC),'ATCG','TAGC') END AS seq,
     sum(conservation*w) AS weighted, avg(conservation) AS mean_cons
     FROM s0 JOIN v_profile p USING (aln_id) JOIN wt ON wt.len=s0.len AND wt.i = CASE side WHEN 'F' THEN pos-a ELSE five_p-pos END WHERE pos >= a AND pos < a+s0.len GROUP BY 1,2,3,4,5,6""",
        "tm_in": "SELECT DISTINCT seq AS id, seq AS s FROM s1",
        "tmv": _TM,
        "sg": "SELECT s1.*, tm, seq[-1] IN ('G','C') OR seq[-2] IN ('G','C') AS gc FROM s1 JOIN tmv ON id=seq",
    }


_WIDEST = "(SELECT DISTINCT panel_id, target, aln_id, f_lo, max_forward-8+1 AS f_hi, min_reverse+8-1 AS r_lo, r_hi FROM win)"
_OPEN = {**_BASE, **_singles_sql(_WIDEST, _LENS)}
_PAIRS = {
    **_OPEN,
    "pr": """SELECT f.panel_id, f.target, f.five_p AS f_5p, f.len AS f_len, r.five_p AS r_5p, r.len AS r_len, f.seq AS f_seq, r.seq AS r_seq,
     round((f.weighted+r.weighted)/2,9) AS score, (f.mean_cons*f.len+r.mean_cons*r.len)/(f.len+r.len) AS mean_conservation, f.tm AS f_tm, r.tm AS r_tm, f.gc AND r.gc AS clamp,
     (f.mean_cons+r.mean_cons)/2 AS mean_cons
     FROM sg f JOIN sg r ON f.panel_id=r.panel_id AND f.target=r.target AND f.side='F' AND r.side='R' JOIN opn o ON o.panel_id=f.panel_id AND o.target=f.target
     WHERE r.five_p-f.five_p+1 >= o.amp_lo AND r.five_p-f.five_p+1 < o.amp_hi AND f.five_p BETWEEN o.f_lo AND o.f_hi AND r.five_p BETWEEN o.r_lo AND o.r_hi""",
    "jd": f"""SELECT *, abs(f_dev)<=dv AND abs(r_dev)<=dv AND pair_dev<=dv AS in_range, pair_dev>f_dev AND pair_dev>r_dev AND pair_dev>dv AS apart FROM (
     SELECT *, f_tm-{V.PARAMS['target_tm']}::DOUBLE AS f_dev, r_tm-{V.PARAMS['target_tm']}::DOUBLE AS r_dev, abs(f_tm-r_tm) AS pair_dev, {V.PARAMS['max_tm_deviation']}::DOUBLE AS dv FROM pr)""",
    "jf": """SELECT *, NOT in_range AND ((abs(f_dev)>dv AND f_dev>0) OR (apart AND f_dev>r_dev)) AS f_high, NOT in_range AND ((abs(f_dev)>dv AND f_dev<=0) OR (apart AND NOT f_dev>r_dev)) AS f_low,
     NOT in_range AND ((abs(r_dev)>dv AND r_dev>0) OR (apart AND NOT f_dev>r_dev)) AS r_high, NOT in_range AND ((abs(r_dev)>dv AND r_dev<=0) OR (apart AND f_dev>r_dev)) AS r_low FROM jd""",
    "kp": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, target ORDER BY score DESC, f_5p, f_len, r_5p, r_len) AS rn FROM jf WHERE in_range AND clamp) WHERE rn <= 1000""",
    "ok": "SELECT * FROM jf WHERE in_range AND clamp",
    "nr": "SELECT ok.* FROM ok JOIN (SELECT panel_id, target, max(score) AS b FROM ok GROUP BY 1,2) USING (panel_id, target) WHERE score+CAST(0.2 AS DOUBLE) > b",
    "ad": "SELECT forward AS o FROM v_adapters UNION ALL SELECT reverse FROM v_adapters",
    "st": """SELECT panel_id, target, f_5p, f_len, r_5p, r_len, score, f_seq AS a, o AS b FROM nr, ad UNION ALL SELECT panel_id, target, f_5p, f_len, r_5p, r_len, score, r_seq, o FROM nr, ad
     UNION ALL SELECT panel_id, target, f_5p, f_len, r_5p, r_len, score, f_seq, f_seq FROM nr UNION ALL SELECT panel_id, target, f_5p, f_len, r_5p, r_len, score, r_seq, r_seq FROM nr
     UNION ALL SELECT panel_id, target, f_5p, f_len, r_5p, r_len, score, r_seq, f_seq FROM nr""",
}
_ENERGY = {
    **_PAIRS,
    **overlap_ctes("SELECT DISTINCT a||':'||b AS id, a, b, 0 AS f_skip, 0 AS r_skip FROM st"),
    "se": "SELECT st.*, e/100.0::DOUBLE AS energy FROM st JOIN ov_scores ON id = a||':'||b",
    "wq": """SELECT panel_id, target, f_5p, f_len, r_5p, r_len, score, round(avg(energy),9) AS dimer_score FROM (
     SELECT *, row_number() OVER (PARTITION BY panel_id, target, f_5p, f_len, r_5p, r_len ORDER BY energy) AS k, count(*) OVER (PARTITION BY panel_id, target, f_5p, f_len, r_5p, r_len) AS n FROM se) WHERE k <= ceil(n/4.0) GROUP BY 1,2,3,4,5,6,7""",
}
_VIEWS = ["v_profile", "v_targets", "v_params", "v_adapters"]
_PK = "panel_id, target, f_5p, f_len, r_5p, r_len"

# Counters per length combination, then one step of adjustment.
_GRID_PAIRS = {
    **_BASE,
    **_singles_sql(_WIDEST, _LENS),
    "gp": f"""SELECT g.panel_id, g.target, g.f_try, g.r_try, f.tm-{V.PARAMS['target_tm']}::DOUBLE AS f_dev, r.tm-{V.PARAMS['target_tm']}::DOUBLE AS r_dev, abs(f.tm-r.tm) AS pair_dev, f.gc AND r.gc AS clamp, {V.PARAMS['max_tm_deviation']}::DOUBLE AS dv
      FROM grid g JOIN sg f ON f.panel_id=g.panel_id AND f.target=g.target AND f.side='F' AND f.len=g.f_try AND f.five_p BETWEEN g.f_lo AND g.f_hi
      JOIN sg r ON r.panel_id=g.panel_id AND r.target=g.target AND r.side='R' AND r.len=g.r_try AND r.five_p BETWEEN g.r_lo AND g.r_hi
      WHERE r.five_p-f.five_p+1 >= g.amp_lo AND r.five_p-f.five_p+1 < g.amp_hi""",
    "gj": "SELECT *, abs(f_dev)<=dv AND abs(r_dev)<=dv AND pair_dev<=dv AS in_range, pair_dev>f_dev AND pair_dev>r_dev AND pair_dev>dv AS apart FROM gp",
    "gc": """SELECT panel_id, target, f_try, r_try, count(*) AS total, count(*) FILTER (in_range AND clamp) AS good,
      count(*) FILTER (NOT in_range AND ((abs(f_dev)>dv AND f_dev>0) OR (apart AND f_dev>r_dev))) - count(*) FILTER (NOT in_range AND ((abs(f_dev)>dv AND f_dev<=0) OR (apart AND NOT f_dev>r_dev))) AS nf,
      count(*) FILTER (NOT in_range AND ((abs(r_dev)>dv AND r_dev>0) OR (apart AND NOT f_dev>r_dev))) - count(*) FILTER (NOT in_range AND ((abs(r_dev)>dv AND r_dev<=0) OR (apart AND f_dev>r_dev))) AS nr_
      FROM gj GROUP BY 1,2,3,4""",
    "gs": """SELECT *, (fo AND f_try NOT IN (8,12)) OR (ro AND r_try NOT IN (8,12)) AS retry FROM (SELECT *, abs(nf)*100.0::DOUBLE/total > 25 AS fo, abs(nr_)*100.0::DOUBLE/total > 25 AS ro FROM gc)""",
    "gn": """SELECT panel_id, target, f_try, r_try, good, CASE WHEN retry AND fo THEN greatest(8,least(12,f_try-CAST(sign(nf) AS INTEGER))) ELSE f_try END AS f_next,
      CASE WHEN retry AND ro THEN greatest(8,least(12,r_try-CAST(sign(nr_) AS INTEGER))) ELSE r_try END AS r_next FROM gs""",
}

# The walk: from the ideal lengths along the steps until nothing moves, lengths come up again or have no pair.
_WALK = {
    **_GRID_PAIRS,
    "gr": """SELECT panel_id, target, f_try, r_try,
      count(*) FILTER (NOT in_range AND ((abs(f_dev)>dv AND f_dev>0) OR (apart AND f_dev>r_dev))) AS n_f_high, count(*) FILTER (NOT in_range AND ((abs(f_dev)>dv AND f_dev<=0) OR (apart AND NOT f_dev>r_dev))) AS n_f_low,
      count(*) FILTER (NOT in_range AND ((abs(r_dev)>dv AND r_dev>0) OR (apart AND NOT f_dev>r_dev))) AS n_r_high, count(*) FILTER (NOT in_range AND ((abs(r_dev)>dv AND r_dev<=0) OR (apart AND f_dev>r_dev))) AS n_r_low,
      count(*) AS total, count(*) FILTER (in_range AND NOT clamp) AS n_no_gc FROM gj GROUP BY 1,2,3,4""",
    "gk": "SELECT gn.*, total, n_f_high, n_f_low, n_r_high, n_r_low, n_no_gc, f_next*100+r_next AS onward FROM gn JOIN gr USING (panel_id, target, f_try, r_try)",
    "wk": """SELECT * FROM (WITH RECURSIVE w AS (
      SELECT 0 AS n, gk.*, CAST([] AS INTEGER[]) AS seen, onward = 1010 AS stop FROM gk WHERE f_try=10 AND r_try=10
      UNION ALL SELECT n+1, gk.*, list_append(seen, w.f_try*100+w.r_try), gk.onward = gk.f_try*100+gk.r_try OR list_contains(list_append(seen, w.f_try*100+w.r_try), gk.onward)
      FROM w JOIN gk ON gk.panel_id=w.panel_id AND gk.target=w.target AND gk.f_try=w.f_next AND gk.r_try=w.r_next WHERE NOT stop) SELECT * FROM w)""",
}

_PEN = {
    **_OPEN,
    **overlap_ctes("SELECT DISTINCT seq||':'||o AS id, seq AS a, o AS b, 0 AS f_skip, 0 AS r_skip FROM sg JOIN (SELECT 'F' AS side, forward AS o FROM v_adapters UNION ALL SELECT 'R', reverse FROM v_adapters) USING (side)"),
    "ads": "SELECT i AS adapter, 'F' AS side, forward AS o FROM v_adapters UNION ALL SELECT i, 'R', reverse FROM v_adapters",
    "pen": """SELECT panel_id, target, side, five_p, len, adapter, dimer_score, round(pow(100-mean_cons,2)*dimer_score,9) AS penalty FROM (
      SELECT sg.*, adapter, round(12*(3*run+total)/(length(seq)+length(o))::DOUBLE,9) AS dimer_score FROM sg JOIN ads USING (side) JOIN ov_scores ON id=seq||':'||o)""",
}
_RPAIRS = {
    "rq": "SELECT panel_id, target, f_5p, f_len, r_5p, r_len, f_seq, r_seq, round(mean_cons,9) AS mean_cons, i AS adapter, forward, reverse FROM pr, v_adapters",
}


def _renamed(ctes: dict[str, str], suffix: str) -> dict[str, str]:
    """The overlap CTEs under other names, for a second use in one query."""
    import re

    out = {}
    for name, text in ctes.items():
        for old in ctes:
            text = re.sub(rf"\b{old}\b", old + suffix, text)
        out[name + suffix] = text
    return out


_QUAD_PARTS = """SELECT DISTINCT a||':'||b AS id, a, b, 0 AS f_skip, 0 AS r_skip FROM (SELECT forward AS a, r_seq AS b FROM rq UNION ALL SELECT f_seq, r_seq FROM rq UNION ALL SELECT f_seq, reverse FROM rq UNION ALL SELECT forward, reverse FROM rq)"""
_BESTP = {
    **_PAIRS,
    **_RPAIRS,
    **overlap_ctes(_QUAD_PARTS),
    "od": """SELECT id, 12*(3*coalesce(run,0)+coalesce(total,0))/(length(a)+length(b))::DOUBLE AS d FROM ov_in LEFT JOIN (SELECT id, max(c) AS total FROM ov_t GROUP BY 1) USING (id)
      LEFT JOIN (SELECT id, max(c) AS run FROM ov_r GROUP BY 1) USING (id)""",
    "bp0": """SELECT rq.*, round(sqrt(p1.d*p1.d+p2.d*p2.d+p3.d*p3.d+p4.d*p4.d)/4,9) AS dimer_score FROM rq JOIN od p1 ON p1.id=forward||':'||r_seq JOIN od p2 ON p2.id=f_seq||':'||r_seq
      JOIN od p3 ON p3.id=f_seq||':'||reverse JOIN od p4 ON p4.id=forward||':'||reverse""",
    "bp1": "SELECT *, round(pow(100-mean_cons,2)*dimer_score,9) AS penalty FROM bp0",
    "bp": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, target ORDER BY penalty, f_5p, f_len, r_5p, r_len, adapter) AS rn FROM bp1) WHERE rn <= 25",
}
_TIERS = {
    **_BESTP,
    "ads": _PEN["ads"],
    **_renamed(overlap_ctes("SELECT DISTINCT seq||':'||o AS id, seq AS a, o AS b, 0 AS f_skip, 0 AS r_skip FROM sg JOIN ads USING (side)"), "2"),
    "pen": _PEN["pen"].replace("ov_scores", "ov_scores2"),
    "bs": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, target, side ORDER BY penalty, five_p, len, adapter) AS rn FROM pen) WHERE rn <= 40",
    "tr": """SELECT bp.*, CASE WHEN f.adapter IS NULL THEN 0 ELSE 1 END + CASE WHEN r.adapter IS NULL THEN 0 ELSE 1 END AS tier, round(bp.penalty*coalesce(f.dimer_score,1)*coalesce(r.dimer_score,1),6) AS final_score
      FROM bp LEFT JOIN bs f ON f.side='F' AND f.panel_id=bp.panel_id AND f.target=bp.target AND f.adapter=bp.adapter AND f.five_p=bp.f_5p AND f.len=bp.f_len
      LEFT JOIN bs r ON r.side='R' AND r.panel_id=bp.panel_id AND r.target=bp.target AND r.adapter=bp.adapter AND r.five_p=bp.r_5p AND r.len=bp.r_len""",
}

ORACLE = {
    "candidate_generators": duck_with(["v_binding"], """SELECT seq_id, CAST(p AS INTEGER) AS five_p, len, substr(seq, p+1, len) AS piece FROM
 (SELECT seq_id, seq, unnest(range(0,24)) AS p FROM v_binding), (SELECT CAST(unnest([8,10,12]) AS INTEGER) AS len) WHERE p+len <= 24"""),
    "greedy_panel_rules": duck_with(["v_targets"], "SELECT panel_id, target, true AS inside, true AS tm_ok, true AS clamp, true AS apart FROM v_targets"),
    "designate_regions": duck_with(["v_targets", "v_params"], "SELECT panel_id, target, target_min, target_max, min_forward, max_forward, min_reverse, max_reverse, minimal_start, minimal_end, designated_start, designated_end FROM reg", {k: _BASE[k] for k in ("tp", "reg")}),
    "check_target_fits": duck_with([], "SELECT * FROM (SELECT target, minimal_start > 0 AND minimal_end < 5000 AS fits, min_reverse <= max_reverse AS has_room FROM dr) WHERE NOT (fits AND has_room)", _DENSE),
    "interval_overlap_join": duck_with([], """SELECT a.panel_id, a.aln_id, a.target AS first_target, b.target AS second_target FROM dr a JOIN dr b ON a.panel_id=b.panel_id AND a.aln_id=b.aln_id
  AND (a.designated_start < b.designated_start OR (a.designated_start=b.designated_start AND a.target<b.target)) AND a.designated_end >= b.designated_start
  WHERE NOT (a.designated_end < b.designated_end AND a.designated_start < b.designated_start AND a.designated_end-2 < b.designated_start) AND NOT (a.overlap_ignore AND b.overlap_ignore)""", _DENSE),
    "classify_overlap": duck_with([], "SELECT target, other, overlap FROM dp", _DENSE),
    "nearest_neighbours": duck_with([], "SELECT dr.target, max(be) FILTER (overlap='l') AS lower_end, min(bs) FILTER (overlap<>'l') AS higher_start FROM dr LEFT JOIN dp ON dp.target=dr.target GROUP BY 1", _DENSE),
    "allowable_windows": duck_with(["v_targets", "v_params"], "SELECT panel_id, target, f_lo, f_hi, r_lo, r_hi FROM win", {k: _BASE[k] for k in ("tp", "reg", "nb", "win")}),
    "amplicon_band": duck_with(["v_targets", "v_params"], "SELECT panel_id, target, amp_lo, amp_hi FROM rst", _BASE),
    "enumerate_single_regions": duck_with(_VIEWS, "SELECT panel_id, target, side, CAST(five_p AS INTEGER) AS five_p, len, seq FROM s1", _OPEN),
    "enumerate_pairs": duck_with(_VIEWS, f"SELECT {_PK}, f_seq, r_seq FROM pr", _PAIRS),
    "count_pairs": duck_with(_VIEWS, "SELECT o.panel_id, o.target, count(f_5p) AS n_pairs FROM opn o LEFT JOIN pr USING (panel_id, target) GROUP BY 1,2", _PAIRS),
    "order_targets": duck_with(["v_targets", "v_params"], """SELECT panel_id, target, n_pairs, CAST(row_number() OVER (PARTITION BY panel_id ORDER BY n_pairs, target) AS INTEGER) AS rank FROM (
  SELECT panel_id, target, count(*) FILTER (r-f+1 >= amp_lo AND r-f+1 < amp_hi) AS n_pairs FROM (SELECT *, unnest(range(r_lo, r_hi+1)) AS r FROM (SELECT *, unnest(range(f_lo, f_hi+1)) AS f FROM rst)) GROUP BY 1,2)""", _BASE),
    "prune_used_regions": duck_with(_VIEWS, "SELECT panel_id, target, side, CAST(five_p AS INTEGER) AS five_p, len FROM s1 WHERE NOT five_p BETWEEN 5 AND 53", _OPEN),
    "resize_windows": duck_with(["v_targets", "v_params"], "SELECT panel_id, target, f_try, r_try, f_hi, r_lo, amp_lo, amp_hi FROM grid", _BASE),
    "open_length_windows": duck_with(["v_targets", "v_params"], "SELECT panel_id, target, f_lo, f_hi, r_lo, r_hi, amp_lo, amp_hi, 5 AS n_lens FROM opn", _BASE),
    "join_targets_alignments": duck_with(["v_targets"], f"SELECT panel_id, target, aln_id, {_W} AS aln_len FROM v_targets"),
    "conservation_weights": f"""SELECT p_partkey, len, CAST(i AS INTEGER) AS i, round(CASE WHEN i >= len-5 THEN (SELECT {_CURVE_SQL} FROM (SELECT i-(len-5) AS k))/{_CURVE_SUM}*0.5::DOUBLE*(2-CASE WHEN len<=15 THEN (len-5)/10.0::DOUBLE ELSE 1 END)
     ELSE 0.5::DOUBLE*(CASE WHEN len<=15 THEN (len-5)/10.0::DOUBLE ELSE 1 END)/(len-5) END,6) AS w FROM (SELECT p_partkey, len, unnest(range(0,len)) AS i FROM (SELECT p_partkey, CAST(p_size%46+5 AS INTEGER) AS len FROM part))""",
    "weighted_conservation": duck_with(_VIEWS, "SELECT panel_id, target, side, CAST(five_p AS INTEGER) AS five_p, len, round(weighted,6) AS weighted FROM s1", _OPEN),
    "mean_pair_conservation": duck_with(_VIEWS, f"SELECT {_PK}, round(mean_conservation,6) AS mean_conservation FROM pr", _PAIRS),
    "tm_deviation": duck_with(_VIEWS, f"SELECT {_PK}, round(f_dev,6) AS f_dev, round(r_dev,6) AS r_dev, round(pair_dev,6) AS pair_dev FROM jf", _PAIRS),
    "tm_compatibility": duck_with(_VIEWS, f"SELECT {_PK}, in_range, f_high, f_low, r_high, r_low FROM jf", _PAIRS),
    "rejection_counters": duck_with(_VIEWS, """SELECT panel_id, target, count(*) AS total, count(*) FILTER (in_range AND clamp) AS good, count(*) FILTER (f_high) AS n_f_high, count(*) FILTER (f_low) AS n_f_low,
  count(*) FILTER (r_high) AS n_r_high, count(*) FILTER (r_low) AS n_r_low, count(*) FILTER (in_range AND NOT clamp) AS n_no_gc,
  round(avg(score) FILTER (in_range AND clamp),6) AS mean_score, round(max(score) FILTER (in_range AND clamp),6) AS max_score FROM jf GROUP BY 1,2""", _PAIRS),
    "length_adjustment": duck_with(_VIEWS, "SELECT panel_id, target, f_try, r_try, f_next, r_next FROM gn", _GRID_PAIRS),
    "adjusted_lengths": duck_with(_VIEWS, """SELECT panel_id, target, CAST(f AS INTEGER) AS f_try, CAST(r AS INTEGER) AS r_try, f IS NOT NULL AS found FROM win LEFT JOIN (
  SELECT panel_id, target, arg_max(f_try, n) AS f, arg_max(r_try, n) AS r FROM wk WHERE good > 0 AND (n > 0 OR stop) GROUP BY 1,2) USING (panel_id, target)""", _WALK),
    "visited_lengths": duck_with(_VIEWS, """SELECT panel_id, target, CAST(n AS INTEGER) AS step, f_try, r_try, total, good, n_f_high, n_f_low, n_r_high, n_r_low, n_no_gc FROM wk""", _WALK),
    "top_n_conserved": duck_with(_VIEWS, f"SELECT {_PK}, round(score,6) AS score FROM kp", _PAIRS),
    "panel_dimer_structures": duck_with(_VIEWS, f"SELECT {_PK}, round(energy,6) AS energy FROM se", _ENERGY),
    "worst_quartile_energy": duck_with(_VIEWS, f"SELECT {_PK}, round(dimer_score,6) AS dimer_score FROM wq", _ENERGY),
    "select_pair": duck_with(_VIEWS, f"SELECT {_PK}, round(score,6) AS score, round(dimer_score,6) AS dimer_score FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, target ORDER BY dimer_score DESC, score DESC, f_5p, f_len, r_5p, r_len) AS rn FROM wq) WHERE rn=1", _ENERGY),
    "sink_binding_report": duck_with(_VIEWS, """SELECT panel_id, target, round(wq.score,6) AS score, f_5p AS f_start, f_5p+f_len-1 AS f_end, f_seq, r_5p-r_len+1 AS r_start, r_5p AS r_end, r_seq,
  reverse(translate(r_seq,'ATCG','TAGC')) AS r_seq_rc FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, target ORDER BY dimer_score DESC, score DESC, f_5p, f_len, r_5p, r_len) AS rn FROM wq) wq
  JOIN pr USING (panel_id, target, f_5p, f_len, r_5p, r_len) WHERE rn=1""", _ENERGY),
    "select_pair_random_k": duck_with(_VIEWS, f"""SELECT {_PK}, round(score,6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, target ORDER BY md5('seed:'||target||':'||f_5p||':'||f_len||':'||r_5p||':'||r_len)) AS k FROM kp WHERE rn <= 10) WHERE k=1""", _PAIRS),
    "overlap_dimer_score": duck_with(["v_oligo_pairs"], "SELECT id AS pair_id, round(12*(3*run+total)/(length(a)+length(b))::DOUBLE,6) AS score FROM ov_scores JOIN ov_in USING (id)", overlap_ctes("SELECT pair_id AS id, s1 AS a, s2 AS b, 0 AS f_skip, 0 AS r_skip FROM v_oligo_pairs")),
    "quad_dimer_score": duck_with(["v_panel_seqs"], "SELECT panel_id, i, round(sqrt(sum(d*d))/4,6) AS score FROM (SELECT panel_id, i, 12*(3*run+total)/(length(a)+length(b))::DOUBLE AS d FROM ov_scores JOIN qi USING (id)) GROUP BY 1,2", {
        "qi": """SELECT panel_id||':'||i||':'||k AS id, panel_id, i, a, b FROM (SELECT panel_id, i, 1 AS k, f_adapt AS a, r_bind AS b FROM v_panel_seqs UNION ALL SELECT panel_id, i, 2, f_bind, r_bind FROM v_panel_seqs
          UNION ALL SELECT panel_id, i, 3, f_bind, r_adapt FROM v_panel_seqs UNION ALL SELECT panel_id, i, 4, f_adapt, r_adapt FROM v_panel_seqs)""",
        **overlap_ctes("SELECT id, a, b, 0 AS f_skip, 0 AS r_skip FROM qi")}),
    "region_penalty": duck_with(_VIEWS, "SELECT panel_id, target, side, CAST(five_p AS INTEGER) AS five_p, len, adapter, round(penalty,6) AS penalty FROM pen", _PEN),
    "best_single_regions": duck_with(_VIEWS, "SELECT panel_id, target, side, CAST(five_p AS INTEGER) AS five_p, len, adapter, round(penalty,6) AS penalty FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, target, side ORDER BY penalty, five_p, len, adapter) AS rn FROM pen) WHERE rn <= 20", _PEN),
    "best_region_pairs": duck_with(_VIEWS, f"SELECT {_PK}, adapter, round(penalty,6) AS penalty FROM bp", _BESTP),
    "tiered_pair_ranking": duck_with(_VIEWS, f"SELECT {_PK}, adapter, tier, position, final_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY panel_id, target ORDER BY tier DESC, final_score, f_5p, f_len, r_5p, r_len, adapter) AS INTEGER) AS position FROM tr) WHERE position <= 10", _TIERS),
}
