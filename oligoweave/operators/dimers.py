"""Dimer-report analysis: the most stable dimer per primer or pair, statistics per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoweave.sources.text_fields import run_params


def prune_mismatched_heteros(heterodimers: DataFrame) -> DataFrame:
    return heterodimers.where(F.col("f") == F.col("r"))


def _most_stable(dimers: DataFrame, keys: list[str]) -> DataFrame:
    """Highest complementarity per key, the earlier record on a tie.

    A grouped maximum, so repeated dimers collapse before the shuffle.
    """
    best = F.max(F.struct("comp", (-F.col("ord")).alias("rank"), "offset")).alias("best")
    return dimers.groupBy(*keys).agg(best).select(
        *keys, F.col("best.comp").alias("comp"), F.col("best.offset").alias("offset"),
        (-F.col("best.rank")).alias("ord"),
    )


def most_stable_homodimers(homodimers: DataFrame) -> DataFrame:
    return _most_stable(homodimers, ["run", "primer", "is_forward"])


def most_stable_heterodimers(heterodimers: DataFrame) -> DataFrame:
    return _most_stable(heterodimers, ["run", "f", "r"])


def run_dimer_stats(homodimers: DataFrame, heterodimers: DataFrame) -> DataFrame:
    """Mean and maximum complementarity per run of the pruned dimers."""
    homo = most_stable_homodimers(homodimers).groupBy("run").agg(
        F.avg("comp").alias("homo_mean"), F.max("comp").alias("homo_max")
    )
    hetero = (
        most_stable_heterodimers(prune_mismatched_heteros(heterodimers))
        .groupBy("run")
        .agg(F.avg("comp").alias("hetero_mean"), F.max("comp").alias("hetero_max"))
    )
    return homo.join(hetero, "run", "full")


def stats_by_param(stats: DataFrame, run_names: DataFrame, param: str) -> DataFrame:
    """Statistics per value of a run parameter; the last run with a value wins."""
    valued = run_names.select(
        "run", F.try_element_at(run_params(F.col("file_name")), F.lit(param)).alias("value")
    ).where(F.col("value").isNotNull())
    joined = valued.join(stats, "run")
    others = [c for c in stats.columns if c != "run"]
    last = F.max(F.struct("run", *others)).alias("last")
    return joined.groupBy("value").agg(last).select("value", "last.*").orderBy("value")


def direction_means(homodimers: DataFrame, heterodimers: DataFrame) -> DataFrame:
    """Mean complementarity of forward, reverse and cross dimers per run."""
    rows = homodimers.select(
        "run", F.when(F.col("is_forward"), "forward").otherwise("reverse").alias("side"), "comp"
    ).unionByName(heterodimers.select("run", F.lit("hetero").alias("side"), "comp"))
    return rows.groupBy("run").agg(
        *[
            F.avg(F.when(F.col("side") == side, F.col("comp"))).alias(f"{side}_mean")
            for side in ("forward", "reverse", "hetero")
        ]
    )
