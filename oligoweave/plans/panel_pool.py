"""From the targets of a panel to its primer pool: binding pairs, spacers, pools, the best pool.

Every target of the input is in the result once. A target that falls out on the way keeps
the reason, and the rest of its panel goes on without it; only what a whole panel fails at
(no spacers that make its columns even) falls on all loci that were left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.operators import balance as B
from oligoweave.operators import candidates as C
from oligoweave.operators import multiplex as M
from oligoweave.plans import panel_search as PS
from oligoweave.session import cut_lineage

TARGET = C.TARGET
POOL = ["panel_id", "pool"]
SERVED = "served"
NO_ALIGNMENT, NO_ROOM, NO_PAIR = "unknown alignment", "no room for a pair", "no valid pair"
NO_ADAPTER, TOO_SHORT, NO_SPACERS, TOO_LONG = "no adapter", "binding shorter than the spacer region", "no even spacers", "primer too long"


@dataclass(frozen=True)
class PoolRequest:
    """Columns made even, longest spacer, pools drawn per panel, longest primer allowed, seed of the draws."""

    n_hetero: int
    max_spacer: int
    n_pools: int
    max_primer: int
    seed: str = "seed"


def unserved_targets(inputs: PS.PanelInputs, chosen: DataFrame) -> DataFrame:
    """Targets without a chosen pair, each with its reason."""
    left = inputs.targets.join(chosen.select(*TARGET), TARGET, "left_anti")
    unknown = C.unmatched_targets(left, inputs.lengths).select(*TARGET, F.lit(NO_ALIGNMENT).alias("reason"))
    counts = C.count_pairs(C.open_length_windows(PS.planned_windows(inputs))).select(*TARGET, "n_pairs")
    known = left.join(inputs.lengths, "aln_id", "left_semi").join(counts, TARGET, "left")
    room = F.coalesce("n_pairs", F.lit(0)) > 0
    return unknown.unionByName(known.select(*TARGET, F.when(room, NO_PAIR).otherwise(NO_ROOM).alias("reason")))


def numbered_loci(chosen: DataFrame, adapters: DataFrame) -> DataFrame:
    """Chosen pairs numbered in the order they were served, with the adapter pair of their number, if there is one.

    A panel has as many rows as one tube has targets.
    """
    order = Window.partitionBy("panel_id").orderBy("rank", "target")
    rows = chosen.withColumn("i", F.row_number().over(order) - 1)
    own = adapters.select("panel_id", "i", F.col("forward").alias("f_adapt"), F.col("reverse").alias("r_adapt"))
    return rows.join(own, ["panel_id", "i"], "left")


def side_spacers(loci: DataFrame, binding: str, request: PoolRequest) -> DataFrame:
    """panel_id, seqs, spacers of one side: the shortest longest spacer, or the smallest total where any length will do.

    Panels that no spacers make even are left out.
    """
    panels = cut_lineage(M.panel_rows(loci, binding))
    search = B.smallest_total if request.max_spacer == request.n_hetero else B.smallest_longest
    found = search(panels, request.n_hetero, request.max_spacer).select("panel_id", F.col("combo").alias("spacers"))
    return panels.join(found, "panel_id")


def pools_of(loci: DataFrame, forward: DataFrame, reverse: DataFrame, request: PoolRequest) -> DataFrame:
    """Primers (panel_id, pool, i, f_primer, r_primer) of every pool that is drawn."""
    f = M.random_balanced_spacers(forward, request.n_pools, f"{request.seed}:f").withColumnRenamed("spacer", "f_spacer")
    r = M.random_balanced_spacers(reverse, request.n_pools, f"{request.seed}:r").withColumnRenamed("spacer", "r_spacer")
    parts = loci.select("panel_id", "i", "f_adapt", "r_adapt", F.col("f_seq").alias("f_bind"), F.col("r_seq").alias("r_bind"))
    return M.assemble_pool(parts, f.join(r, [*POOL, "i"]), POOL)


def scored_pools(pools: DataFrame) -> DataFrame:
    """panel_id, pool, score: mean energy of the least stable half of all structures, of primers with their partners."""
    loci = pools.groupBy(*POOL).agg((F.max("i") + 1).alias("n_loci"))
    return M.pool_score(M.all_pairs_energy(M.pool_oligos(pools, POOL), POOL), POOL, loci)


def _renumbered(loci: DataFrame) -> DataFrame:
    """Numbers without gaps, after loci have fallen out."""
    order = Window.partitionBy("panel_id").orderBy("i")
    return loci.withColumn("i", F.row_number().over(order) - 1)


def panel_to_pool(inputs: PS.PanelInputs, request: PoolRequest) -> DataFrame:
    """One row per input target: reason, and for served ones the locus, pair, primers, pool and its score.

    Stages end in written tables, so a lost executor costs one stage at most.
    """
    inputs = inputs.written()
    chosen = cut_lineage(PS.greedy_panel_selection(inputs))
    loci = cut_lineage(numbered_loci(chosen, inputs.adapters))
    short = F.least(F.length("f_seq"), F.length("r_seq")) < request.n_hetero
    full = F.greatest(F.length("f_seq") + F.length("f_adapt"), F.length("r_seq") + F.length("r_adapt")) + request.max_spacer
    judged = loci.withColumn(
        "reason",
        F.when(F.col("f_adapt").isNull(), NO_ADAPTER).when(short, TOO_SHORT).when(full > request.max_primer, TOO_LONG),
    )
    fit = cut_lineage(_renumbered(judged.where("reason is null").drop("reason")))
    forward, reverse = (cut_lineage(side_spacers(fit, binding, request)) for binding in ("f_seq", "r_seq"))
    both = forward.select("panel_id").join(reverse.select("panel_id"), "panel_id")
    ready = fit.join(both, "panel_id", "left_semi")
    uneven = fit.join(both, "panel_id", "left_anti").select(*TARGET, F.lit(NO_SPACERS).alias("reason"))

    pools = cut_lineage(pools_of(ready, forward.join(both, "panel_id", "left_semi"), reverse.join(both, "panel_id", "left_semi"), request))
    best = M.best_pool(cut_lineage(scored_pools(pools))).withColumnRenamed("score", "pool_score")
    primers = pools.join(best, POOL)
    pair = ["f_5p", "f_len", "r_5p", "r_len", "f_seq", "r_seq"]
    served = ready.join(primers, ["panel_id", "i"]).select(
        *TARGET, F.lit(SERVED).alias("reason"), "i", "rank", *pair, "f_adapt", "r_adapt", "pool", "f_primer", "r_primer", "pool_score"
    )
    fallen = unserved_targets(inputs, chosen).unionByName(judged.where("reason is not null").select(*TARGET, "reason")).unionByName(uneven)
    return served.unionByName(fallen, allowMissingColumns=True)


def pool_rules(result: DataFrame, inputs: PS.PanelInputs, request: PoolRequest) -> DataFrame:
    """Per target of the input: in the result once, primers put together from their parts, and columns as even as can be."""
    served = result.where(F.col("reason") == SERVED)
    sides = []
    for p in "fr":
        spacer = F.expr(f"substring({p}_primer, length({p}_adapt) + 1, length({p}_primer) - length({p}_adapt) - length({p}_seq))")
        sides.append(served.select("panel_id", F.lit(p).alias("side"), F.length(spacer).alias("s"), F.concat(spacer, f"{p}_seq").alias("q")))
        served = served.withColumn(f"{p}_whole", F.concat(f"{p}_adapt", spacer, f"{p}_seq") == F.col(f"{p}_primer")).withColumn(f"{p}_spacer", F.length(spacer))
    cells = sides[0].unionByName(sides[1]).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(request.n_hetero - 1))))
    base = F.substring("q", F.col("col") + 1, F.lit(1))
    columns = cells.groupBy("panel_id", "side", "col").agg(F.count("*").alias("n"), *(F.count_if(base == b).alias(b) for b in "ATCG"))
    counts = F.array_sort(F.array("A", "T", "C", "G"))
    is_even = F.get(counts, 3) - F.get(counts, 0) <= F.when(F.col("n") % 4 == 0, 0).otherwise(1)
    even = columns.groupBy("panel_id").agg(F.bool_and(is_even).alias("even"))
    own = served.join(even, "panel_id").select(
        *TARGET, (F.col("f_whole") & F.col("r_whole")).alias("whole"), "even", (F.greatest("f_spacer", "r_spacer") <= request.max_spacer).alias("within")
    )
    counted = result.groupBy(*TARGET).agg(F.count("*").alias("n_rows"), F.max("reason").alias("reason"))
    return inputs.targets.select(*TARGET).join(counted, TARGET, "left").join(own, TARGET, "left").select(
        *TARGET, F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        *(F.coalesce(x, F.col("reason") != SERVED).alias(x) for x in ("whole", "even", "within")),
    )
