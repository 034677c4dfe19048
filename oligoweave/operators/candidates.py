"""Candidate regions and pairs: from target sites to forward/reverse combinations.

Positions are 0-based. A forward primer covers [f_5p, f_5p + f_len - 1], a reverse primer
[r_5p - r_len + 1, r_5p]; the amplicon has r_5p - f_5p + 1 bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.functions import sequence as S
from oligoweave.functions.dimensions import weights_of

TARGET = ["panel_id", "target"]
# Columns per bucket of the interval join.
BUCKET = 256


def _flag(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(False)


def join_targets_alignments(targets: DataFrame, lengths: DataFrame) -> DataFrame:
    """Targets with the length of their alignment."""
    return targets.join(lengths, "aln_id")


def unmatched_targets(targets: DataFrame, lengths: DataFrame) -> DataFrame:
    """Targets that name an alignment which does not exist."""
    return targets.join(lengths, "aln_id", "left_anti")


def designate_regions(targets: DataFrame, params: DataFrame, lengths: DataFrame) -> DataFrame:
    """Target core, search windows and the spans that belong to each target.

    Parameters ride along as columns. Which join is broadcast is left to the planner,
    which knows the sizes.
    """
    p_dist, t_dist = F.col("primer_primer_distance"), F.col("primer_target_distance")
    reach = F.col("target_len_max") + 2 * F.col("binding_len_max")
    low, high = F.array_min("sites") - t_dist, F.array_max("sites") + t_dist
    return (
        join_targets_alignments(targets, lengths)
        .join(params, "panel_id")
        .withColumns({"target_min": low, "target_max": high, "overlap_ignore": _flag(targets, "overlap_ignore")})
        .withColumns({"min_reverse": F.col("target_max") + 1, "max_forward": F.col("target_min") - 1})
        .withColumns(
            {
                "max_reverse": F.least(F.col("max_forward") + reach, F.col("aln_len")),
                "min_forward": F.greatest(F.col("min_reverse") - reach, F.lit(0)),
                "minimal_start": F.col("max_forward") - F.col("binding_len_max") + 1,
                "minimal_end": F.col("min_reverse") + F.col("binding_len_max") - 1,
            }
        )
        .withColumns(
            {
                "designated_start": F.col("minimal_start") - p_dist,
                "designated_end": F.col("minimal_end") + p_dist,
            }
        )
    )


def _bucketed(df: DataFrame, start: str, stop: str) -> DataFrame:
    first, last = F.floor(F.col(start) / BUCKET), F.floor(F.col(stop) / BUCKET)
    return df.withColumn("first_bucket", first).withColumn(
        "bucket", F.explode(F.sequence(first, last))
    )


def _interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Pairs whose closed intervals meet; each pair is made in its first common bucket.

    Columns of the second frame get the prefix ``o_``.
    """
    a = _bucketed(left, start, stop)
    b = _bucketed(right, start, stop)
    b = b.select(*[F.col(c).alias(c if c in [*keys, "bucket"] else f"o_{c}") for c in b.columns])
    met = (F.col(start) <= F.col(f"o_{stop}")) & (F.col(f"o_{start}") <= F.col(stop))
    once = F.col("bucket") == F.greatest("first_bucket", "o_first_bucket")
    return a.join(b, [*keys, "bucket"]).where(met & once).drop("bucket", "first_bucket", "o_first_bucket")


def interval_overlap_join(regions: DataFrame, tolerance: Column | int = 0) -> DataFrame:
    """Target pairs of one alignment whose designated spans overlap beyond a tolerance.

    The pair is ordered by start (then name); an overlap at the ends that is no longer
    than the tolerance does not count.
    """
    tolerance = F.lit(tolerance) if isinstance(tolerance, int) else tolerance
    spans = regions.select("panel_id", "aln_id", "target", "designated_start", "designated_end", "overlap_ignore")
    pairs = _interval_pairs(spans, spans, ["panel_id", "aln_id"], "designated_start", "designated_end")
    s1, e1 = F.col("designated_start"), F.col("designated_end")
    s2, e2 = F.col("o_designated_start"), F.col("o_designated_end")
    ordered = (s1 < s2) | ((s1 == s2) & (F.col("target") < F.col("o_target")))
    tolerated = (e1 < e2) & (s1 < s2) & (e1 - tolerance < s2)
    ignored = F.col("overlap_ignore") & F.col("o_overlap_ignore")
    return pairs.where(ordered & ~tolerated & ~ignored).select(
        "panel_id", "aln_id", F.col("target").alias("first_target"), F.col("o_target").alias("second_target")
    )


def _class_of_pair() -> Column:
    """h: the other lies above (or equal); l: below; i: one lies inside the other."""
    f1, f2 = F.col("min_forward"), F.col("o_min_forward")
    r1, r2 = F.col("max_reverse"), F.col("o_max_reverse")
    return F.when((f1 <= f2) & (r1 <= r2), "h").when((f1 >= f2) & (r1 >= r2), "l").otherwise("i")


def classify_overlap(regions: DataFrame) -> DataFrame:
    """Class of every ordered pair of targets whose search windows meet."""
    spans = regions.select("panel_id", "aln_id", "target", "min_forward", "max_reverse", "overlap_ignore")
    pairs = _interval_pairs(spans, spans, ["panel_id", "aln_id"], "min_forward", "max_reverse")
    ignored = F.col("overlap_ignore") & F.col("o_overlap_ignore")
    return pairs.where((F.col("target") != F.col("o_target")) & ~ignored).select(
        "panel_id", "aln_id", "target", F.col("o_target").alias("other"), _class_of_pair().alias("overlap")
    )


def nearest_neighbours(regions: DataFrame) -> DataFrame:
    """Furthest-reaching lower neighbour and earliest upper neighbour of each target.

    Targets with equal spans are folded into one row first, so however many targets
    share a place, the join sees distinct spans only.
    """
    keys = ["panel_id", "aln_id", "min_forward", "max_reverse", "designated_start", "designated_end", "overlap_ignore"]
    spans = regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    pairs = _interval_pairs(spans, spans, ["panel_id", "aln_id"], "min_forward", "max_reverse")
    same = (
        (F.col("min_forward") == F.col("o_min_forward"))
        & (F.col("max_reverse") == F.col("o_max_reverse"))
        & (F.col("designated_start") == F.col("o_designated_start"))
        & (F.col("designated_end") == F.col("o_designated_end"))
        & (F.col("overlap_ignore") == F.col("o_overlap_ignore"))
    )
    ignored = F.col("overlap_ignore") & F.col("o_overlap_ignore")
    kind = _class_of_pair()
    found = (
        pairs.where((~same | (F.col("n") > 1)) & ~ignored)
        .withColumn("kind", kind)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("kind") == "l", F.col("o_designated_end"))).alias("lower_end"),
            F.min(F.when(F.col("kind") != "l", F.col("o_designated_start"))).alias("higher_start"),
        )
    )
    return regions.join(found, keys, "left")


def allowable_windows(regions: DataFrame) -> DataFrame:
    """Inclusive 5' ranges [f_lo, f_hi] and [r_lo, r_hi] for the ideal binding length.

    ``regions`` comes from nearest_neighbours. The reverse range is kept inside the
    alignment.
    """
    ideal = F.col("ideal_binding_size")
    return regions.withColumns(
        {
            "f_lo": F.greatest(F.col("min_forward") - 1, F.coalesce("lower_end", F.lit(-1))) + 1,
            "f_hi": F.col("max_forward") - ideal + 1,
            "r_lo": F.col("min_reverse") + ideal - 1,
            "r_hi": F.least(
                F.col("max_reverse"), F.col("aln_len") - 1, F.coalesce(F.col("higher_start") - 1, F.col("max_reverse"))
            ),
        }
    )


def amplicon_band(windows: DataFrame, f_len: Column | str, r_len: Column | str) -> DataFrame:
    """Half-open range [amp_lo, amp_hi) of amplicon lengths for two binding lengths."""
    f_len = F.col(f_len) if isinstance(f_len, str) else f_len
    r_len = F.col(r_len) if isinstance(r_len, str) else r_len
    both = f_len + r_len
    core = F.col("min_reverse") - F.col("max_forward") - 1
    return windows.withColumns(
        {
            "amp_lo": F.greatest(F.col("target_len_min"), core) + both,
            "amp_hi": F.least(F.col("target_len_max") + both + 1, F.col("max_binding_target_len")),
        }
    )


def resize_windows(windows: DataFrame, f_len: Column | str, r_len: Column | str) -> DataFrame:
    """Windows for other binding lengths: the inner ends move, the target stays clear."""
    f_len = F.col(f_len) if isinstance(f_len, str) else f_len
    r_len = F.col(r_len) if isinstance(r_len, str) else r_len
    ideal = F.col("ideal_binding_size")
    return amplicon_band(
        windows.withColumns(
            {"f_hi": F.col("f_hi") - (f_len - ideal), "r_lo": F.col("r_lo") + (r_len - ideal)}
        ),
        f_len,
        r_len,
    )


def restricted_windows(windows: DataFrame) -> DataFrame:
    """One length per side: the ideal one."""
    ideal = F.col("ideal_binding_size")
    sized = resize_windows(windows, ideal, ideal)
    return sized.withColumns({"f_lens": F.array(ideal), "r_lens": F.array(ideal)})


def open_length_windows(windows: DataFrame) -> DataFrame:
    """All lengths at once, windows sized for the longest."""
    longest = F.col("binding_len_max")
    lens = F.sequence("binding_len_min", "binding_len_max")
    return resize_windows(windows, longest, longest).withColumns({"f_lens": lens, "r_lens": lens})


def length_grid_windows(windows: DataFrame) -> DataFrame:
    """One row per combination of binding lengths, each with its own windows."""
    lens = F.sequence("binding_len_min", "binding_len_max")
    grid = windows.withColumn("f_try", F.explode(lens)).withColumn("r_try", F.explode(lens))
    return resize_windows(grid, "f_try", "r_try").withColumns(
        {"f_lens": F.array("f_try"), "r_lens": F.array("r_try")}
    )


def _has_room(df: DataFrame) -> DataFrame:
    return df.where((F.col("f_lo") <= F.col("f_hi")) & (F.col("r_lo") <= F.col("r_hi")))


def count_pairs(windows: DataFrame) -> DataFrame:
    """Number of candidate pairs per target, in closed form per forward start."""

    def partners(f: Column) -> Column:
        first = F.greatest(F.col("r_lo"), f + F.col("amp_lo") - 1)
        last = F.least(F.col("r_hi"), f + F.col("amp_hi") - 2)
        return F.greatest(last - first + 1, F.lit(0)).cast("bigint")

    total = F.aggregate(
        F.sequence("f_lo", "f_hi"), F.lit(0).cast("bigint"), lambda acc, f: acc + partners(f)
    )
    room = (F.col("f_lo") <= F.col("f_hi")) & (F.col("r_lo") <= F.col("r_hi"))
    return windows.withColumn(
        "n_pairs", F.when(room, total * F.size("f_lens") * F.size("r_lens")).otherwise(F.lit(0))
    )


def order_targets(counted: DataFrame) -> DataFrame:
    """Targets of each panel, fewest candidates first."""
    order = Window.partitionBy("panel_id").orderBy("n_pairs", "target")
    return counted.withColumn("rank", F.row_number().over(order))


def window_profiles(windows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Consensus and conservation under each target's search span, as short arrays.

    Distinct spans are looked up by position; a span is as wide as the search window,
    however wide the alignment.
    """
    longest = F.col("binding_len_max")
    lo = F.greatest(F.least(F.col("f_lo"), F.col("min_reverse") - longest), F.lit(0))
    hi = F.least(F.greatest(F.col("r_hi"), F.col("max_forward") + longest), F.col("aln_len") - 1)
    placed = windows.withColumns({"span_lo": lo, "span_hi": hi}).where("span_lo <= span_hi")
    keys = ["aln_id", "span_lo", "span_hi"]
    cells = (
        placed.select(*keys)
        .distinct()
        .withColumn("pos", F.explode(F.sequence("span_lo", "span_hi")))
        .join(profiles.select("aln_id", "pos", "cons_base", "conservation"), ["aln_id", "pos"])
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "cons_base", "conservation"))).alias("c"))
        .select(
            *keys,
            F.array_join(F.transform("c", lambda x: x["cons_base"]), "").alias("span_seq"),
            F.transform("c", lambda x: x["conservation"]).alias("span_cons"),
        )
    )
    return placed.join(cells, keys)


def generate_regions(seqs: DataFrame, lens: list[int], carry: list[str]) -> DataFrame:
    """Every (5', length) piece of each sequence with its bases; pieces end inside it.

    A generator on the sequence's own row: parameters and sequence come out together.
    """
    return (
        seqs.withColumn("five_p", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)))
        .withColumn("len", F.explode(F.array(*[F.lit(n) for n in lens])))
        .where(F.col("five_p") + F.col("len") <= F.length("seq"))
        .select(*carry, "five_p", "len", F.substring("seq", F.col("five_p") + 1, F.col("len")).alias("piece"))
    )


def _side_regions(profiled: DataFrame, side: str) -> DataFrame:
    """Every (5', length) region of one side, cut from the target's own span."""
    shortest = F.col("binding_len_min")
    if side == "F":
        first, last = F.col("f_lo"), F.col("max_forward") - shortest + 1
        start = F.col("five_p")
    else:
        first, last = F.col("min_reverse") + shortest - 1, F.col("r_hi")
        start = F.col("five_p") - F.col("len") + 1
    rows = (
        profiled.withColumns({"first": first, "last": last})
        .where("first <= last")
        .withColumn("five_p", F.explode(F.sequence("first", "last")))
        .withColumn("len", F.explode(F.sequence("binding_len_min", "binding_len_max")))
        .withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("aln_len")))
    )
    offset = F.col("start") - F.col("span_lo") + 1
    cut = F.substring(F.col("span_seq"), offset, F.col("len"))
    cons = F.slice("span_cons", offset, F.col("len"))
    return rows.select(
        *TARGET, "aln_id", F.lit(side).alias("side"), "five_p", "len",
        (cut if side == "F" else S.reverse_complement(cut)).alias("seq"),
        (cons if side == "F" else F.reverse(cons)).alias("cons"),
    )


def enumerate_single_regions(windows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every forward and reverse region of every target, scored.

    A region is cut and scored once, however many pairs, length combinations and search
    steps it takes part in; all of it happens on the target's own row. Regions leaving
    the alignment are not made.
    """
    profiled = window_profiles(windows, profiles)
    rows = _side_regions(profiled, "F").unionByName(_side_regions(profiled, "R"))
    product = F.zip_with("cons", weights_of(F.col("len")), lambda x, w: x * w)
    total = F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)
    plain = F.aggregate(F.col("cons"), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(
        *TARGET, "aln_id", "side", "five_p", "len", "seq",
        total.alias("weighted"),
        (plain / F.col("len")).alias("mean_cons"),
        S.melting_temperature("seq").alias("tm"),
        S.has_gc_end("seq").alias("gc_end"),
    )


def _side(singles: DataFrame, side: str) -> DataFrame:
    p = side.lower()
    return singles.where(F.col("side") == side).select(
        *TARGET, F.col("five_p").alias(f"{p}_5p"), F.col("len").alias(f"{p}_len"),
        F.col("seq").alias(f"{p}_seq"), F.col("weighted").alias(f"{p}_weighted"),
        F.col("mean_cons").alias(f"{p}_mean_cons"), F.col("tm").alias(f"{p}_tm"),
        F.col("gc_end").alias(f"{p}_gc"),
    )


def enumerate_pairs(sized: DataFrame, singles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Forward and reverse regions whose amplicon length lies in the target's band.

    The band becomes equi-joins: windows list their forward starts, each forward region
    lists the reverse starts it may pair with. Work is spread by (target, start, length),
    so one large target is many small keys.
    """
    keys = keys or []
    first = F.greatest(F.col("r_lo"), F.col("f_5p") + F.col("amp_lo") - 1)
    last = F.least(F.col("r_hi"), F.col("f_5p") + F.col("amp_hi") - 2)
    starts = (
        _has_room(sized)
        .select(*TARGET, "aln_id", *keys, "f_lo", "f_hi", "r_lo", "r_hi", "amp_lo", "amp_hi", "f_lens", "r_lens")
        .withColumn("f_5p", F.explode(F.sequence("f_lo", "f_hi")))
        .withColumns({"first": first, "last": last})
        .where("first <= last")
        .withColumn("f_len", F.explode("f_lens"))
        .select(*TARGET, "aln_id", *keys, "f_5p", "f_len", "first", "last", "r_lens")
    )
    forward = starts.join(_side(singles, "F"), [*TARGET, "f_5p", "f_len"])
    wanted = (
        forward.withColumn("r_5p", F.explode(F.sequence("first", "last")))
        .withColumn("r_len", F.explode("r_lens"))
        .drop("first", "last", "r_lens")
    )
    return wanted.join(_side(singles, "R"), [*TARGET, "r_5p", "r_len"])


def prune_used_regions(candidates: DataFrame, chosen: DataFrame, distance: Column | str, column: str) -> DataFrame:
    """Candidates whose 5' start is not inside the reach of a chosen pair.

    chosen(panel_id, aln_id, f_5p, r_5p, distance). Reach is listed by position, so the
    range anti-join is an equi-join on (panel, alignment, position).
    """
    distance = F.col(distance) if isinstance(distance, str) else distance
    taken = (
        chosen.withColumn(
            column, F.explode(F.sequence(F.greatest(F.col("f_5p") - distance, F.lit(0)), F.col("r_5p") + distance))
        )
        .select("panel_id", "aln_id", column)
        .distinct()
    )
    return candidates.join(taken, ["panel_id", "aln_id", column], "left_anti")
