"""The best region pairs of a target without making all of its pairs.

The penalty of a pair grows with the bases that its regions miss and with four overlaps:
of each region with the other side's adapter, of the two adapters, and of the two regions.
Only the last needs the pair. So regions are scored once per adapter, sorted by the least
penalty that any pair with them can have, and cut into blocks; a pair of blocks has a least
penalty too. The first blocks give a threshold, the n-th best penalty among their pairs,
and beyond it only pairs of blocks, and then pairs, are looked at that can be below it. Of a
pair, the short words that one region shares with the other's reverse complement bound the
overlap from below; the words of a region are bits of a few numbers, made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.functions import constants as C
from oligoweave.functions import sequence as S
from oligoweave.operators.ranking import top_n
from oligoweave.operators.scoring import PAIR, TARGET, best_region_pairs
from oligoweave.session import cut_lineage

#: Regions in a block. Larger blocks make fewer rows and looser bounds.
BLOCK = 8
GROUP = [*TARGET, "adapter"]


def adapter_scored(singles: DataFrame, windows: DataFrame, adapters: DataFrame) -> DataFrame:
    """Regions inside their target's windows with every adapter pair.

    ``miss``: what is short of full conservation; ``cross``: overlap score with the adapter
    of the other side; ``adapters``: that of the two adapters. Every oligo is encoded once.
    """
    inside = F.when(F.col("side") == "F", F.col("five_p").between(F.col("f_lo"), F.col("f_hi"))).otherwise(
        F.col("five_p").between(F.col("r_lo"), F.col("r_hi"))
    )
    words = word_masks(F.when(F.col("side") == "F", F.col("seq")).otherwise(S.reverse_complement(F.col("seq"))))
    regions = (
        singles.join(windows.select(*TARGET, "f_lo", "f_hi", "r_lo", "r_hi"), TARGET)
        .where(inside)
        .select(*TARGET, "side", "five_p", "len", "seq", "mean_cons", S.encode_overlap("seq").alias("region"), words.alias("words"))
    )
    both = adapters.select(
        "panel_id", F.col("i").alias("adapter"), S.encode_overlap("forward").alias("fa"), S.encode_overlap("reverse").alias("ra")
    ).withColumn("adapters", S.overlap_dimer_encoded("fa", "ra"))
    cross = F.when(F.col("side") == "F", S.overlap_dimer_encoded("region", "ra")).otherwise(S.overlap_dimer_encoded("fa", "region"))
    return regions.join(both, "panel_id").select(
        *GROUP, "side", "five_p", "len", "seq", "words", "mean_cons", cross.alias("cross"), "adapters"
    )


def word_masks(seq: Column) -> Column:
    """Which words of two, three and four bases occur: one number, one, and one per first base."""

    def mask(size: int, first: str = "") -> Column:
        at = F.when(F.length(seq) >= size, F.sequence(F.lit(1), F.length(seq) - size + 1)).otherwise(F.array().cast("array<int>"))
        words = F.transform(at, lambda i: F.substring(seq, i, F.lit(size)))
        plain = F.filter(words, lambda w: w.rlike(f"^{first}[{C.BASES}]{{{size - len(first)}}}$"))
        number = lambda w: F.conv(F.translate(F.substring(w, len(first) + 1, size), C.BASES, "0123"), 4, 10).cast("int")
        return F.aggregate(plain, F.lit(0).cast("bigint"), lambda bits, w: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), number(w))))

    return F.array(mask(2), mask(3), *(mask(4, base) for base in C.BASES))


def least_overlap(f_seq: Column, r_seq: Column, f_words: Column, r_words: Column) -> Column:
    """A lower bound of the overlap score of two regions: a word in common is a run of its length.

    ``r_words`` are those of the reverse complement of ``r_seq``.
    """
    common = [F.get(f_words, i).bitwiseAND(F.get(r_words, i)) != 0 for i in range(2 + len(C.BASES))]
    four = common[2] | common[3] | common[4] | common[5]
    run = F.when(four, 4).when(common[1], 3).when(common[0], 2).otherwise(0)
    return C.OVERLAP_SCALE * run * (C.RUN_WEIGHT + C.TOTAL_WEIGHT) / (F.length(f_seq) + F.length(r_seq))


def _least_penalty(f_cons: Column, r_cons: Column, f_cross: Column, r_cross: Column, adapters: Column, own: Column | float = 0.0) -> Column:
    """The penalty if the two regions overlapped by ``own`` only, or not at all."""
    dimer = F.sqrt(f_cross * f_cross + r_cross * r_cross + adapters * adapters + own * own) / 4
    return S.region_penalty((f_cons + r_cons) / 2, dimer)


def blocks(scored: DataFrame, size: int = BLOCK) -> DataFrame:
    """Regions of one target, adapter and side, by their least possible penalty, ``size`` to a block.

    ``block`` counts from 0; a block has its best conservation, least cross overlap and
    range of places. A group is as large as a target's window, whatever the input.
    """
    ends = scored.groupBy(*GROUP).agg(
        *(
            x
            for side in ("F", "R")
            for x in (
                F.max(F.when(F.col("side") == side, F.col("mean_cons"))).alias(f"{side}_cons"),
                F.min(F.when(F.col("side") == side, F.col("cross"))).alias(f"{side}_cross"),
            )
        )
    )
    forward = F.col("side") == "F"
    other_cons = F.when(forward, F.col("R_cons")).otherwise(F.col("F_cons"))
    other_cross = F.when(forward, F.col("R_cross")).otherwise(F.col("F_cross"))
    bound = _least_penalty(F.col("mean_cons"), other_cons, F.col("cross"), other_cross, F.col("adapters"))
    order = Window.partitionBy(*GROUP, "side").orderBy("bound", "five_p", "len")
    placed = scored.join(ends, GROUP).withColumn("bound", bound).withColumn("block", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    region = F.struct("five_p", "len", "seq", "words", "mean_cons", "cross")
    return placed.groupBy(*GROUP, "side", "block").agg(
        F.max("mean_cons").alias("cons"), F.min("cross").alias("cross"), F.min("five_p").alias("first"), F.max("five_p").alias("last"),
        F.first("adapters").alias("adapters"), F.collect_list(region).alias("regions"),
    )


def _side(of: DataFrame, side: str) -> DataFrame:
    p = side.lower()
    kept = ["block", "cons", "cross", "first", "last", "regions"]
    return of.where(F.col("side") == side).select(*GROUP, *(F.col(x).alias(f"{p}_{x}") for x in kept), *(["adapters"] if p == "f" else []))


def block_pairs(of: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of blocks that hold a pair with an allowed amplicon, perhaps, with their least penalty."""
    longest = F.col("r_last") - F.col("f_first") + 1
    shortest = F.col("r_first") - F.col("f_last") + 1
    bound = _least_penalty(*(F.col(x) for x in ("f_cons", "r_cons", "f_cross", "r_cross", "adapters")))
    return (
        _side(of, "F").join(_side(of, "R"), GROUP)
        .join(windows.select(*TARGET, "amp_lo", "amp_hi"), TARGET)
        .where((longest >= F.col("amp_lo")) & (shortest < F.col("amp_hi")))
        .withColumn("bound", bound)
    )


def region_pairs(pairs: DataFrame, threshold: Column | None = None) -> DataFrame:
    """The pairs of regions of pairs of blocks, those below a threshold if there is one."""
    amplicon = F.col("r.five_p") - F.col("f.five_p") + 1
    rows = (
        pairs.withColumn("f", F.explode("f_regions")).withColumn("r", F.explode("r_regions"))
        .where((amplicon >= F.col("amp_lo")) & (amplicon < F.col("amp_hi")))
    )
    if threshold is not None:
        own = least_overlap(*(F.col(x) for x in ("f.seq", "r.seq", "f.words", "r.words")))
        bound = _least_penalty(*(F.col(x) for x in ("f.mean_cons", "r.mean_cons", "f.cross", "r.cross", "adapters")), own)
        rows = rows.where(within(bound, threshold))
    sides = [F.col(f"{p}.{x}").alias(f"{p}_{y}") for p in "fr" for x, y in (("five_p", "5p"), ("len", "len"), ("seq", "seq"), ("mean_cons", "mean_cons"), ("cross", "cross"))]
    return rows.select(*GROUP, *sides, "adapters")


def within(bound: Column, threshold: Column) -> Column:
    """Whether a bound may lie at or below a threshold, room for rounding included; all are within none."""
    return threshold.isNull() | (bound <= threshold * (1 + 1e-9) + 1e-6)


def scored_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of regions with dimer score and penalty: what is left to score is how the regions overlap."""
    own = S.overlap_dimer_score("f_seq", "r_seq")
    squares = [x * x for x in (F.col("r_cross"), F.col("own"), F.col("f_cross"), F.col("adapters"))]
    mean = F.round((F.col("f_mean_cons") + F.col("r_mean_cons")) / 2, 9)
    return (
        rows.withColumn("own", own)
        .withColumns({"mean_cons": mean, "dimer_score": F.round(F.sqrt(sum(squares[1:], squares[0])) / 4, 9)})
        .withColumn("penalty", F.round(S.region_penalty("mean_cons", "dimer_score"), 9))
        .select(*GROUP, *PAIR, "f_seq", "r_seq", "mean_cons", "dimer_score", "penalty")
    )


def thresholds(pairs: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """Per target a penalty that its n-th best pair does not exceed (null where it has fewer than n pairs).

    The first blocks of both sides are looked at; targets that do not have n pairs there look
    at four times as many, until all have n or nothing is left to look at.
    """
    sizes = cut_lineage(of.groupBy(*TARGET).agg((F.max("block") + 1).alias("n_blocks")))
    spark, depth, found = of.sparkSession, 1, None
    while True:
        first = pairs.join(sizes, TARGET).where((F.col("f_block") < depth) & (F.col("r_block") < depth))
        best = top_n(scored_pairs(region_pairs(first)), TARGET, [F.col("penalty")], n)
        counted = best.groupBy(*TARGET).agg(F.max("penalty").alias("nth"), F.count("*").alias("n_found"))
        seen = cut_lineage(
            sizes.join(counted, TARGET, "left").select(
                *TARGET, "n_blocks", F.when(F.col("n_found") >= n, F.col("nth")).alias("threshold"),
                ((F.coalesce("n_found", F.lit(0)) >= n) | (F.col("n_blocks") <= depth)).alias("done"),
            )
        )
        done = seen.where("done").select(*TARGET, "threshold")
        found = done if found is None else found.union(done)
        sizes = seen.where("not done").select(*TARGET, "n_blocks")
        if sizes.isEmpty():
            return found
        depth *= 4


def candidate_pairs(windows: DataFrame, singles: DataFrame, adapters: DataFrame, n: int) -> DataFrame:
    """The pairs that can be among the n best of their target; all others are ruled out by bounds.

    ``windows`` sized as by open_length_windows, singles of any lengths.
    """
    of = cut_lineage(blocks(adapter_scored(singles, windows, adapters)))
    pairs = block_pairs(of, windows)
    limits = thresholds(pairs, of, n)
    threshold = F.col("threshold")
    return region_pairs(pairs.join(limits, TARGET).where(within(F.col("bound"), threshold)), threshold)


def best_pairs(windows: DataFrame, singles: DataFrame, adapters: DataFrame, n: int) -> DataFrame:
    """The n pairs (with an adapter pair) of least penalty of each target, over all lengths of ``singles``."""
    return best_region_pairs(scored_pairs(candidate_pairs(windows, singles, adapters, n)), n)
