"""Panel search: one primer pair per target, chosen target by target in every panel at once.

Within a panel the choice is greedy: each chosen pair narrows the temperatures, the dimer
partners and the free space of the targets after it. Across panels nothing depends on
anything, so each step is one job over the targets of equal rank in all panels; the
number of steps is the largest number of targets in a panel.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoweave.operators import candidates as C
from oligoweave.operators import length_walk as L
from oligoweave.operators import scoring as G
from oligoweave.operators.profile import alignment_lengths
from oligoweave.session import cut_lineage, scratch_path

TARGET = C.TARGET
CHOSEN = [
    *TARGET, "aln_id", "rank", *G.PAIR, "f_seq", "r_seq", "f_tm", "r_tm", "score", "dimer_score",
]


@dataclass(frozen=True)
class PanelInputs:
    targets: DataFrame
    params: DataFrame
    adapters: DataFrame
    profiles: DataFrame
    lengths: DataFrame

    def written(self) -> PanelInputs:
        """The same inputs as tables: the alignments are read and profiled once, the others beside it."""
        names = ("profiles", "targets", "params", "adapters")
        with ThreadPoolExecutor(len(names)) as pool:
            tables = dict(zip(names, pool.map(lambda name: cut_lineage(getattr(self, name)), names), strict=True))
        return PanelInputs(**tables, lengths=cut_lineage(alignment_lengths(tables["profiles"])))


def planned_windows(inputs: PanelInputs) -> DataFrame:
    """Windows of every target, after neighbours have been given their room."""
    regions = C.designate_regions(inputs.targets, inputs.params, inputs.lengths)
    return C.allowable_windows(C.nearest_neighbours(regions))


def ranked_windows(inputs: PanelInputs) -> DataFrame:
    """Windows with the order in which the targets of a panel are served."""
    windows = planned_windows(inputs)
    ranks = C.order_targets(C.count_pairs(C.restricted_windows(windows))).select(*TARGET, "rank", "n_pairs")
    return windows.join(ranks, TARGET)


def _free_regions(singles: DataFrame, inputs: PanelInputs, chosen: DataFrame | None) -> DataFrame:
    """Regions whose start keeps clear of the pairs already chosen."""
    if chosen is None:
        return singles
    reach = chosen.join(inputs.params.select("panel_id", "primer_primer_distance"), "panel_id").select(
        "panel_id", "aln_id", "f_5p", "r_5p", F.col("primer_primer_distance").alias("reach")
    )
    return C.prune_used_regions(singles, reach, "reach", "five_p")


def search_step(
    windows: DataFrame, singles: DataFrame, inputs: PanelInputs, chosen: DataFrame | None, energies: Column | None = None
) -> DataFrame:
    """Best pair of each given target, given what its panel has chosen so far.

    ``energies``: the expression of ``pair_energies``, if the caller has it.
    """
    temperatures = G.panel_temperatures(inputs.params, chosen)
    partners = G.panel_partners(inputs.adapters, chosen, windows)
    free = _free_regions(singles, inputs, chosen)

    # Lengths: follow the rejections from the ideal ones, counted without making pairs.
    lengths = cut_lineage(L.walked_lengths(windows, free, temperatures).drop("steps"))

    # Targets with a valid pair on their way use its lengths, the others all lengths. The
    # limits of a panel stand on its windows, so no join follows the pairs.
    limited = windows.join(temperatures, "panel_id")
    found = lengths.where("found").select(*TARGET, "f_try", "r_try")
    fixed = C.resize_windows(limited.join(found, TARGET), "f_try", "r_try").withColumns(
        {"f_lens": F.array("f_try"), "r_lens": F.array("r_try")}
    )
    opened = C.open_length_windows(limited.join(found.select(*TARGET), TARGET, "left_anti"))
    sized = fixed.select(*opened.columns).unionByName(opened)
    judged = G.judged(C.enumerate_pairs(sized, free, G.LIMITS))
    valid = cut_lineage(G.valid_pairs(judged))
    return G.select_pair(G.dimer_scored(G.near_best(valid), partners, energies))


def greedy_panel_selection(inputs: PanelInputs, max_rank: int | None = None) -> DataFrame:
    """One pair per target; targets left without space or valid pairs are absent.

    Every step is added to one written table, so a lost executor costs one step at most and
    plans do not grow with the number of targets.
    """
    inputs = inputs.written()
    ranked = cut_lineage(ranked_windows(inputs))
    singles = cut_lineage(
        C.enumerate_single_regions(ranked, inputs.profiles).join(ranked.select(*TARGET, "rank"), TARGET)
    )
    deepest = ranked.agg(F.max("rank")).first()[0] or 0
    if max_rank is not None:
        deepest = min(deepest, max_rank)
    chosen: DataFrame | None = None
    path = scratch_path(inputs.targets.sparkSession, "chosen")
    energies = G.pair_energies()
    for rank in range(1, deepest + 1):
        at = F.col("rank") == rank
        step = search_step(ranked.where(at), singles.where(at).drop("rank"), inputs, chosen, energies)
        step = step.withColumn("rank", F.lit(rank)).select(*CHOSEN)
        step.write.mode("append").parquet(path)
        chosen = step.sparkSession.read.schema(step.schema).parquet(path)
    return chosen
