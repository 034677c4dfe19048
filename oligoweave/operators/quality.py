"""Data-quality queries over the input tables: each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoweave.functions import constants as C


def check_sites_in_bounds(targets: DataFrame, lengths: DataFrame, margin: int) -> DataFrame:
    """Sites that are not strictly inside (margin, length - margin).

    targets(target, aln_id, sites); lengths(aln_id, aln_len)
    """
    site = F.col("site")
    return (
        targets.select("target", "aln_id", F.explode("sites").alias("site"))
        .join(lengths, "aln_id")
        .where(~((site > margin) & (site < F.col("aln_len") - margin)))
    )


def check_site_conflicts(targets: DataFrame, distance: int) -> DataFrame:
    """Sites identical to, or closer than ``distance`` to, a site of another target.

    Positions are summarised first (lowest and highest target name), then each site looks
    up the positions around it. The lookup side has one row per position, so a crowded
    position never multiplies rows, and the answer is the nearest foreign site.
    """
    sites = targets.select("target", "aln_id", F.explode("sites").alias("site")).distinct()
    owners = sites.groupBy("aln_id", F.col("site").alias("near")).agg(
        F.min("target").alias("first_owner"), F.max("target").alias("last_owner")
    )
    reach = max(distance - 1, 0)
    foreign = (F.col("first_owner") != F.col("target")) | (F.col("last_owner") != F.col("target"))
    return (
        sites.withColumn("near", F.explode(F.sequence(F.col("site") - reach, F.col("site") + reach)))
        .join(owners, ["aln_id", "near"])
        .where(foreign)
        .groupBy("aln_id", "target", "site")
        .agg(F.min(F.abs(F.col("near") - F.col("site"))).alias("nearest"))
        .withColumn("identical", F.col("nearest") == 0)
    )


def check_site_span(targets: DataFrame, max_span: int) -> DataFrame:
    span = F.array_max("sites") - F.array_min("sites")
    return targets.select("target", span.alias("span")).where(F.col("span") > max_span)


def check_dna_alphabet(seqs: DataFrame, allow_degenerate: bool = False) -> DataFrame:
    """Sequences with characters outside ATCG (any case), or outside IUPAC if allowed."""
    letters = "".join(c for c in C.IUPAC_OPTIONS if c not in "IU") if allow_degenerate else C.BASES
    return seqs.where(F.upper("seq").rlike(f"[^{letters}]"))


def check_ranges(
    ranges: DataFrame,
    start_bounds: tuple[int, int] | None = None,
    stop_bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """Ranges that are missing, run backwards, or whose ends leave their open bounds."""
    good = F.col("start").isNotNull() & F.col("stop").isNotNull() & (F.col("start") <= F.col("stop"))
    for name, bounds in (("start", start_bounds), ("stop", stop_bounds)):
        if bounds:
            good = good & (F.col(name) > bounds[0]) & (F.col(name) < bounds[1])
    return ranges.where(~F.coalesce(good, F.lit(False)))


def check_unique_targets(targets: DataFrame) -> DataFrame:
    """Target names used more than once in a panel."""
    return (
        targets.groupBy("panel_id", "target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def check_unique_sites(targets: DataFrame) -> DataFrame:
    """Targets that list a site twice."""
    return targets.where(F.size(F.array_distinct("sites")) < F.size("sites"))


def check_primer_length_overflow(panels: DataFrame, limit: int = C.SOLVER_LIMIT) -> DataFrame:
    """Panels whose longest adapter, spacer and longest binding can exceed the limit.

    panels(panel_id, forward, reverse, hetero_len, binding_len_max), one row per adapter pair
    """
    longest = F.greatest(F.length("forward"), F.length("reverse"))
    return (
        panels.groupBy("panel_id")
        .agg(
            (F.max(longest) + F.max("hetero_len") + F.max("binding_len_max")).alias("max_len")
        )
        .where(F.col("max_len") > limit)
    )


def check_full_primer_length(primers: DataFrame, limit: int = C.SOLVER_LIMIT) -> DataFrame:
    return primers.withColumn("len", F.length("primer")).where(F.col("len") > limit)


def check_target_fits(target_regions: DataFrame) -> DataFrame:
    """Targets whose minimal region leaves the alignment or whose reverse window is empty."""
    fits = (F.col("minimal_start") > 0) & (F.col("minimal_end") < F.col("aln_len"))
    room = F.col("min_reverse") <= F.col("max_reverse")
    return target_regions.withColumns({"fits": fits, "has_room": room}).where(~(fits & room))
