"""Scores, filters and choices over candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoweave.functions import constants as C
from oligoweave.functions import sequence as S
from oligoweave.operators.ranking import top_n

TARGET = ["panel_id", "target"]
PAIR = ["f_5p", "f_len", "r_5p", "r_len"]
LIMITS = ["max_tm_deviation", "tm_low", "tm_high"]


def pair_conservation(pairs: DataFrame) -> DataFrame:
    """Weighted conservation of a pair (mean of its sides) and the plain mean.

    Scores are rounded to nine places so that equal scores stay equal in any order of
    summation.
    """
    plain = (F.col("f_mean_cons") * F.col("f_len") + F.col("r_mean_cons") * F.col("r_len")) / (
        F.col("f_len") + F.col("r_len")
    )
    return pairs.withColumns(
        {
            "score": F.round((F.col("f_weighted") + F.col("r_weighted")) / 2, 9),
            "mean_conservation": F.round(plain, 9),
        }
    )


def panel_temperatures(params: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Lowest and highest temperature of each panel: the target's and all chosen ones."""
    temps = params.select("panel_id", F.col("target_tm").alias("t"))
    if chosen is not None:
        temps = temps.unionByName(chosen.select("panel_id", F.col("f_tm").alias("t"))).unionByName(
            chosen.select("panel_id", F.col("r_tm").alias("t"))
        )
    return temps.groupBy("panel_id").agg(F.min("t").alias("tm_low"), F.max("t").alias("tm_high"))


def tm_deviation(tm: Column, low: Column, high: Column) -> Column:
    """Signed largest deviation from any temperature in [low, high]."""
    above, below = tm - low, tm - high
    return F.when(F.abs(above) >= F.abs(below), above).otherwise(below)


def tm_compatibility(pairs: DataFrame) -> DataFrame:
    """Deviations of each pair and which side is too hot or too cold.

    Needs tm_low, tm_high and max_tm_deviation on the row.
    """
    limit = F.col("max_tm_deviation")
    df = pairs.withColumns(
        {
            "f_dev": tm_deviation(F.col("f_tm"), F.col("tm_low"), F.col("tm_high")),
            "r_dev": tm_deviation(F.col("r_tm"), F.col("tm_low"), F.col("tm_high")),
            "pair_dev": F.abs(F.col("f_tm") - F.col("r_tm")),
        }
    )
    f_dev, r_dev, pair_dev = F.col("f_dev"), F.col("r_dev"), F.col("pair_dev")
    in_range = (F.abs(f_dev) <= limit) & (F.abs(r_dev) <= limit) & (pair_dev <= limit)
    apart = (pair_dev > f_dev) & (pair_dev > r_dev) & (pair_dev > limit)
    f_out, r_out = F.abs(f_dev) > limit, F.abs(r_dev) > limit
    hot_f = apart & (f_dev > r_dev)
    cold_f = apart & ~(f_dev > r_dev)
    return df.withColumns(
        {
            "in_range": in_range,
            "f_high": ~in_range & ((f_out & (f_dev > 0)) | hot_f),
            "f_low": ~in_range & ((f_out & (f_dev <= 0)) | cold_f),
            "r_high": ~in_range & ((r_out & (r_dev > 0)) | cold_f),
            "r_low": ~in_range & ((r_out & (r_dev <= 0)) | hot_f),
        }
    )


def judged(pairs: DataFrame) -> DataFrame:
    """Pairs (with LIMITS) with scores, temperature verdict and GC clamp."""
    return tm_compatibility(pair_conservation(pairs)).withColumn("clamp", F.col("f_gc") & F.col("r_gc"))


def judged_pairs(pairs: DataFrame, params: DataFrame, temperatures: DataFrame) -> DataFrame:
    """The same for pairs that do not carry their limits."""
    return judged(pairs.join(params.select("panel_id", "max_tm_deviation").join(temperatures, "panel_id"), "panel_id"))


def valid_pairs(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("in_range") & F.col("clamp"))


def top_n_conserved(judged: DataFrame, n: int = C.KEEP_PER_TARGET) -> DataFrame:
    """The n most conserved valid pairs of each target."""
    order = [F.col("score").desc(), *[F.col(c).asc() for c in PAIR]]
    return top_n(valid_pairs(judged), TARGET, order, n)


def rejection_counters(judged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Why pairs were rejected, and the scores of those kept, per target."""
    good = F.col("in_range") & F.col("clamp")
    return judged.groupBy(*(keys or TARGET)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("good"),
        *[F.count_if(name).alias(f"n_{name}") for name in ("f_high", "f_low", "r_high", "r_low")],
        F.count_if(F.col("in_range") & ~F.col("clamp")).alias("n_no_gc"),
        F.avg(F.when(good, F.col("score"))).alias("mean_score"),
        F.max(F.when(good, F.col("score"))).alias("max_score"),
    )


def next_lengths(counters: DataFrame) -> DataFrame:
    """One step of length adjustment for every (f_try, r_try) of every target.

    A side whose net share of too hot or too cold pairs exceeds a quarter moves by one
    base towards the range; the search stops where a side that should move sits at a
    length limit and the other has no reason to move.
    """
    low, high = F.col("binding_len_min"), F.col("binding_len_max")

    def side(p: str) -> tuple[Column, Column, Column]:
        net = F.col(f"n_{p}_high") - F.col(f"n_{p}_low")
        off = F.abs(net) / F.col("total") * 100 > C.RETRY_PERCENT
        current = F.col(f"{p}_try")
        moved = current + F.when(off, F.when(net > 0, -1).otherwise(1)).otherwise(0)
        kept = F.when((moved >= low) & (moved <= high), moved).otherwise(current)
        free = (current != low) & (current != high)
        return off & free, kept, current

    f_retry, f_next, f_now = side("f")
    r_retry, r_next, r_now = side("r")
    retry = f_retry | r_retry
    return counters.withColumns(
        {
            "f_next": F.when(retry, f_next).otherwise(f_now),
            "r_next": F.when(retry, r_next).otherwise(r_now),
        }
    )


def adjusted_lengths(stepped: DataFrame) -> DataFrame:
    """Follow the steps from the ideal lengths to where they end, per target.

    The walk is over one small map per target (at most one entry per length pair) and
    ends at a fixed point, at lengths without pairs, or when lengths repeat. Of the
    lengths visited, the last with a valid pair is kept (the ideal ones only if nothing
    called for a move); ``found`` tells if there was one.
    """
    at = F.struct(F.col("f_try").alias("f"), F.col("r_try").alias("r"))
    to = F.struct(F.col("f_next").alias("f"), F.col("r_next").alias("r"), F.col("good"))
    per_target = stepped.groupBy(*TARGET).agg(
        F.map_from_entries(F.collect_list(F.struct(at, to))).alias("steps"),
        F.first("ideal_binding_size").alias("ideal"),
    )
    start = F.struct(F.col("ideal").alias("f"), F.col("ideal").alias("r"))
    none = F.lit(None).cast(start_type := "struct<f:int,r:int>")
    init = F.struct(
        start.cast(start_type).alias("at"), none.alias("best"),
        F.array().cast(f"array<{start_type}>").alias("seen"), F.lit(False).alias("stop"),
    )

    def walk(state: Column, _: Column) -> Column:
        def follow(step: Column) -> Column:
            onward = F.struct(step["f"].alias("f"), step["r"].alias("r"))
            missing = step.isNull()
            done = missing | (onward == state["at"]) | F.array_contains(state["seen"], onward)
            counts = (F.size(state["seen"]) > 0) | F.coalesce(done, F.lit(True))
            best = F.when(
                counts & (F.coalesce(step["good"], F.lit(0)) > 0), state["at"]
            ).otherwise(state["best"])
            return F.struct(
                F.when(F.coalesce(done, F.lit(True)), state["at"]).otherwise(onward).alias("at"),
                best.alias("best"),
                F.concat(state["seen"], F.array(state["at"])).alias("seen"),
                F.coalesce(done, F.lit(True)).alias("stop"),
            )

        return F.when(state["stop"], state).otherwise(
            S.let(F.try_element_at(F.col("steps"), state["at"]), follow)
        )

    bound = F.size("steps") + 1
    walked = per_target.withColumn(
        "w", F.aggregate(F.sequence(F.lit(1), bound), init, walk)
    )
    return walked.select(
        *TARGET, F.col("w.best.f").alias("f_try"), F.col("w.best.r").alias("r_try"),
        F.col("w.best").isNotNull().alias("found"),
    )


def near_best(kept: DataFrame, loss: float = C.CONSERVATION_LOSS) -> DataFrame:
    """Pairs within ``loss`` conservation points of their target's best.

    The best is an aggregate joined back, so a target's pairs need not share a task.
    """
    best = kept.groupBy(*TARGET).agg(F.max("score").alias("best_score"))
    return kept.join(best, TARGET).where(F.col("score") + loss > F.col("best_score"))


def structure_energies(
    f_seq: Column, r_seq: Column, partners: Column
) -> Column:
    """Energies of all structures a pair can form.

    With each partner (chosen binding sequences and adapters): forward and reverse; with
    itself: two homodimers and the cross dimer. Oligos are encoded once per row.
    """
    encoded = F.transform(F.concat(F.array(f_seq, r_seq), partners), S.encode_energy)

    def pairings(v: Column) -> Column:
        f, r = F.get(v, F.lit(0)), F.get(v, F.lit(1))
        others = F.slice(v, F.lit(3), F.size(v))

        def pair(a: Column, b: Column) -> Column:
            return F.struct(a.alias("a"), b.alias("b"))

        return F.concat(
            F.transform(others, lambda x: pair(f, x)),
            F.transform(others, lambda x: pair(r, x)),
            F.array(pair(f, f), pair(r, r), pair(r, f)),
        )

    return F.transform(
        S.let(encoded, pairings), lambda p: S.dimer_energy_encoded(p["a"], p["b"])
    )


def worst_share_mean(energies: Column, share: float = C.WORST_SHARE) -> Column:
    """Mean of the lowest quarter (rounded up) of a list of energies."""
    def mean_of(worst: Column) -> Column:
        return F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / F.size(worst)

    return S.let(
        F.slice(F.array_sort(energies), F.lit(1), F.ceil(F.size(energies) * share).cast("int")), mean_of
    )


def panel_partners(adapters: DataFrame, chosen: DataFrame | None, panels: DataFrame) -> DataFrame:
    """(panel_id, partners): every adapter and every binding sequence chosen so far.

    One short list per panel: its length is the number of adapters and chosen primers.
    """
    rows = adapters.select("panel_id", F.explode(F.array("forward", "reverse")).alias("oligo"))
    if chosen is not None:
        rows = rows.unionByName(
            chosen.select("panel_id", F.explode(F.array("f_seq", "r_seq")).alias("oligo"))
        )
    lists = rows.groupBy("panel_id").agg(F.sort_array(F.collect_list("oligo")).alias("partners"))
    return panels.select("panel_id").distinct().join(lists, "panel_id", "left").withColumn(
        "partners", F.coalesce("partners", F.array().cast("array<string>"))
    )


def panel_dimer_structures(pairs: DataFrame, partners: DataFrame) -> DataFrame:
    """One row per pair and structure with its energy."""
    joined = pairs.join(partners, "panel_id")
    energies = pair_energies()
    return joined.select(*TARGET, *PAIR, F.posexplode(energies).alias("structure", "energy"))


def pair_energies() -> Column:
    """Energies of all structures of a row's pair (f_seq, r_seq) and partners; long to build, the same for every table."""
    return structure_energies(F.col("f_seq"), F.col("r_seq"), F.col("partners"))


def dimer_scored(pairs: DataFrame, partners: DataFrame, energies: Column | None = None) -> DataFrame:
    """Pairs with the mean of their worst quarter of structure energies."""
    energies = pair_energies() if energies is None else energies
    return (
        pairs.join(partners, "panel_id")
        .withColumn("dimer_score", F.round(worst_share_mean(energies), 9))
        .drop("partners")
    )


def select_pair(scored: DataFrame) -> DataFrame:
    """Least dimer-prone pair of each target; then the more conserved, then the position."""
    order = [F.col("dimer_score").desc(), F.col("score").desc(), *[F.col(c).asc() for c in PAIR]]
    return top_n(scored, TARGET, order, 1)


def select_pair_random_k(kept: DataFrame, k: int, seed: str) -> DataFrame:
    """One of the k most conserved pairs of each target, chosen by a keyed hash."""
    order = [F.col("score").desc(), *[F.col(c).asc() for c in PAIR]]
    best = top_n(kept, TARGET, order, k)
    key = F.md5(F.concat_ws(":", F.lit(seed), "target", *[F.col(c).cast("string") for c in PAIR]))
    return top_n(best.withColumn("draw", key), TARGET, [F.col("draw").asc()], 1)


# --- exhaustive scan: regions and pairs against adapters ----------------------------


def scored_single_regions(singles: DataFrame, adapters: DataFrame) -> DataFrame:
    """Every region with every adapter of its side: dimer score and penalty.

    singles carry ``side``; adapters(panel_id, i, forward, reverse).
    """
    both = adapters.select(
        "panel_id", F.col("i").alias("adapter"),
        F.explode(F.create_map(F.lit("F"), F.col("forward"), F.lit("R"), F.col("reverse"))).alias("side", "oligo"),
    )
    scored = singles.join(both, ["panel_id", "side"]).withColumn(
        "dimer_score", F.round(S.overlap_dimer_score("seq", "oligo"), 9)
    )
    return scored.withColumn("penalty", F.round(S.region_penalty("mean_cons", "dimer_score"), 9))


def best_single_regions(scored: DataFrame, n: int) -> DataFrame:
    order = [F.col("penalty"), F.col("five_p"), F.col("len"), F.col("adapter")]
    return top_n(scored, [*TARGET, "side"], order, n)


def scored_region_pairs(pairs: DataFrame, adapters: DataFrame) -> DataFrame:
    """Every pair with every adapter pair (same ordinal): dimer score and penalty."""
    joined = pairs.join(adapters, "panel_id")
    mean = F.round((F.col("f_mean_cons") + F.col("r_mean_cons")) / 2, 9)
    return (
        joined.withColumn("mean_cons", mean)
        .withColumn(
            "dimer_score", F.round(S.quad_dimer_score("forward", "f_seq", "reverse", "r_seq"), 9)
        )
        .withColumn("penalty", F.round(S.region_penalty("mean_cons", "dimer_score"), 9))
        .withColumnRenamed("i", "adapter")
        .drop("forward", "reverse")
    )


def best_region_pairs(scored: DataFrame, n: int) -> DataFrame:
    order = [F.col("penalty"), *[F.col(c) for c in PAIR], F.col("adapter")]
    return top_n(scored, TARGET, order, n)


def tiered_pair_ranking(best_pairs: DataFrame, best_singles: DataFrame, n: int) -> DataFrame:
    """Best pairs ranked by how many of their regions are among the best regions too.

    tier 2: both found, 1: one, 0: none; the final score multiplies in the dimer scores
    of the regions found.
    """
    lookup = best_singles.select(
        *TARGET, "side", "five_p", "len", "adapter", F.col("dimer_score").alias("found")
    )

    def side(name: str, p: str) -> DataFrame:
        return lookup.where(F.col("side") == name).select(
            *TARGET, "adapter", F.col("five_p").alias(f"{p}_5p"), F.col("len").alias(f"{p}_len"),
            F.col("found").alias(f"{p}_found"),
        )

    joined = best_pairs.join(side("F", "f"), [*TARGET, "adapter", "f_5p", "f_len"], "left").join(
        side("R", "r"), [*TARGET, "adapter", "r_5p", "r_len"], "left"
    )
    tier = F.col("f_found").isNotNull().cast("int") + F.col("r_found").isNotNull().cast("int")
    final = F.col("penalty") * F.coalesce("f_found", F.lit(1.0)) * F.coalesce("r_found", F.lit(1.0))
    ranked = joined.withColumns({"tier": tier, "final_score": F.round(final, 6)})
    order = [F.col("tier").desc(), F.col("final_score"), *[F.col(c) for c in PAIR], F.col("adapter")]
    return top_n(ranked, TARGET, order, n, "position")
