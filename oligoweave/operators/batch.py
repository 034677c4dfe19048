"""Parameter grids and replicate bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoweave.operators.ranking import top_n


def param_grid(
    ranges: DataFrame, params: dict[str, tuple[str, str]], delimiter: str = "@", suffix: str = ".txt"
) -> DataFrame:
    """Every combination of inclusive parameter ranges with its encoded name.

    params maps a three-letter key to the columns holding first and last value.
    """
    grid = ranges
    for key, (first, last) in params.items():
        grid = grid.withColumn(key, F.explode(F.sequence(F.col(first), F.col(last))))
    parts = [F.concat(F.lit(key), F.col(key).cast("string")) for key in params]
    return grid.withColumn("name", F.concat(F.concat_ws(delimiter, *parts), F.lit(suffix)))


def spacer_sweep(
    panels: DataFrame, hetero: tuple[int, int] = (8, 11), smallest_limit: int = 6
) -> DataFrame:
    """Heterogeneity lengths with every spacer limit below each."""
    return panels.withColumn(
        "hetero_len", F.explode(F.sequence(F.lit(hetero[0]), F.lit(hetero[1])))
    ).withColumn("max_spacer", F.explode(F.sequence(F.lit(smallest_limit), F.col("hetero_len") - 1)))


def replicates_until(replicates: DataFrame, successes: int) -> DataFrame:
    """Replicates up to and including the one that reaches the wanted successes.

    The stopping point is the wanted-th success, found as a small top-n, so runs of any
    length are cut without ordering all of their replicates in one task.
    """
    firsts = top_n(replicates.where("ok").select("run", "rep"), ["run"], [F.col("rep").asc()], successes)
    stops = firsts.groupBy("run").agg(
        F.when(F.count(F.lit(1)) == successes, F.max("rep")).alias("stop")
    )
    return (
        replicates.join(stops, "run", "left")
        .where(F.col("stop").isNull() | (F.col("rep") <= F.col("stop")))
        .drop("stop")
    )


def replicate_summary(replicates: DataFrame, successes: int) -> DataFrame:
    """Per run: replicates made, successes, failures, first and last failure message."""
    failed = ~F.col("ok")
    at = F.when(failed, F.col("rep"))
    return (
        replicates_until(replicates, successes)
        .groupBy("run")
        .agg(
            F.count(F.lit(1)).alias("n_reps"),
            F.count_if("ok").alias("n_success"),
            F.count_if(failed).alias("n_failure"),
            F.min_by("message", at).alias("first_failure"),
            F.max_by("message", at).alias("last_failure"),
        )
    )


def replicate_failures(replicates: DataFrame, successes: int) -> DataFrame:
    """All failure messages as rows, ready to append to the run log."""
    return replicates_until(replicates, successes).where(~F.col("ok")).select("run", "rep", "message")
