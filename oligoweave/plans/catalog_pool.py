"""Registered panel-to-pool queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from oligoweave.operators import profile as P
from oligoweave.plans import panel_pool as PP
from oligoweave.plans import panel_search as PS
from oligoweave.plans import views as V
from oligoweave.plans.views import duck_with

TARGET = PP.TARGET
REQUEST = PP.PoolRequest(n_hetero=6, max_spacer=5, n_pools=4, max_primer=60)


def targets(spark, sf_dir):
    """The targets of all panels, and per panel one on an alignment that is not there or one at the very edge."""
    known = V.targets(spark, sf_dir)
    panels = known.groupBy("panel_id").agg(F.min("aln_id").alias("aln_id"))
    odd = F.pmod("panel_id", F.lit(2)) == 1
    sites = lambda a, b: F.array(F.lit(a).cast("int"), F.lit(b).cast("int"))
    return known.unionByName(
        panels.select(
            "panel_id", F.concat(F.when(odd, "edge").otherwise("lost"), F.col("panel_id").cast("string")).alias("target"),
            F.when(odd, F.col("aln_id")).otherwise(-1 - F.col("panel_id")).alias("aln_id"), sites(1, 3).alias("sites"),
        )
    )


def adapters(spark, sf_dir):
    """Four adapter pairs a panel, three in every third panel."""
    base = V.panel_adapters(spark, sf_dir)
    more = base.where("i = 0").withColumn("n", F.explode(F.array(F.lit(2), F.lit(3)))).where((F.pmod("panel_id", F.lit(3)) > 0) | (F.col("n") == 2))
    cut = lambda side: F.substring(side, F.col("n") * 3, F.lit(12))
    return base.withColumns({x: F.substring(x, 1, 20) for x in ("forward", "reverse")}).unionByName(
        more.select("panel_id", F.col("n").alias("i"), cut("forward").alias("forward"), cut("reverse").alias("reverse"))
    )


def inputs(spark, sf_dir) -> PS.PanelInputs:
    profiles = P.profile(V.alignments(spark, sf_dir))
    return PS.PanelInputs(targets(spark, sf_dir), V.params(spark, sf_dir), adapters(spark, sf_dir), profiles, P.alignment_lengths(profiles))


def panel_pool(spark, sf_dir):
    pool = PP.panel_to_pool(inputs(spark, sf_dir), REQUEST)
    return pool.withColumn("pool_score", F.round("pool_score", 6))


def panel_pool_rules(spark, sf_dir):
    own = inputs(spark, sf_dir)
    result = PP.cut_lineage(PP.panel_to_pool(own, REQUEST))
    known = result.groupBy(*TARGET).agg((F.max("reason") != PP.NO_ALIGNMENT).alias("known"))
    return PP.pool_rules(result, own, REQUEST).join(known, TARGET, "left")


QUERIES = {"panel_pool": panel_pool, "panel_pool_rules": panel_pool_rules}
_TARGETS = """SELECT panel_id, target, true AS known FROM v_targets UNION ALL
  SELECT panel_id, CASE panel_id%2 WHEN 1 THEN 'edge' ELSE 'lost' END||panel_id, panel_id%2=1 FROM (SELECT DISTINCT panel_id FROM v_targets)"""
ORACLE = {
    "panel_pool_rules": duck_with(["v_targets"], f"SELECT panel_id, target, CAST(1 AS BIGINT) AS n_rows, true AS whole, true AS even, true AS within, known FROM ({_TARGETS})"),
}
