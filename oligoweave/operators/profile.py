"""Alignment profiling: per-column counts and everything read off them.

Frames:
  alignments(aln_id, seq_idx, name, seq)      one row per aligned sequence
  cells(aln_id, seq_idx, name, pos, base)     one row per residue
  profile(aln_id, pos, n, n_a .. n_other, cons_base, conservation, pct_gap, pct_missed)
  regions(region_id, aln_id, start, stop)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.functions import constants as C

# Columns per task when a computation needs neighbouring columns of one alignment.
CHUNK = 65536


def alignment_length_check(alignments: DataFrame) -> DataFrame:
    """Sequences whose length differs from the first sequence of their alignment.

    The yardstick is an aggregate joined back, so an alignment of any depth is spread
    over all tasks.
    """
    sized = alignments.select("aln_id", "seq_idx", "name", F.length("seq").alias("len"))
    first = sized.groupBy("aln_id").agg(F.min_by("len", "seq_idx").alias("expected_len"))
    return sized.join(first, "aln_id").where(F.col("len") != F.col("expected_len"))


def explode_alignment(alignments: DataFrame) -> DataFrame:
    return alignments.select(
        "aln_id", "seq_idx", "name", F.posexplode(F.split("seq", "")).alias("pos", "base")
    )


def column_base_counts(alignments: DataFrame) -> DataFrame:
    """Counts of A, T, C, G, gap and anything else per column.

    Partial aggregation runs before the shuffle: what travels is one row per task and
    column, however many sequences an alignment holds.
    """
    base = F.col("base")
    return (
        alignments.select("aln_id", F.posexplode(F.split("seq", "")).alias("pos", "base"))
        .groupBy("aln_id", "pos")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(base == b).alias(f"n_{b.lower()}") for b in C.BASES],
            F.count_if(base == "-").alias("n_gap"),
            F.count_if(~base.isin(*C.BASES, "-")).alias("n_other"),
        )
    )


def _most_common() -> Column:
    """First of A, T, C, G with the highest count."""
    top = F.greatest(*[F.col(f"n_{b.lower()}") for b in C.BASES])
    choice = F.lit(C.BASES[-1])
    for b in reversed(C.BASES[:-1]):
        choice = F.when(F.col(f"n_{b.lower()}") == top, b).otherwise(choice)
    return choice


def column_consensus(counts: DataFrame) -> DataFrame:
    """Most common base; ties go to the first of A, T, C, G; gaps never win."""
    top = F.greatest(*[F.col(f"n_{b.lower()}") for b in C.BASES])
    return counts.withColumn("cons_base", _most_common()).withColumn("n_cons", top)


def profile(alignments: DataFrame) -> DataFrame:
    """Counts, consensus, conservation, gap and missed percentages per column."""
    counts = column_consensus(column_base_counts(alignments))
    gap = F.col("n_gap") / F.col("n") * 100
    return counts.withColumns(
        {
            "conservation": F.col("n_cons") / F.col("n") * 100,
            "pct_gap": gap,
            "pct_missed": F.least(gap, F.abs(gap - 100)),
        }
    )


def alignment_lengths(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("aln_id").agg((F.max("pos") + 1).alias("aln_len"))


def sliding_profile(profiles: DataFrame, value: str, width: int) -> DataFrame:
    """Mean over ``width`` columns from each start; the last full window is not emitted.

    Columns go to chunks of bounded size; the first width-1 columns of a chunk are also
    sent to the chunk before, so no task needs a whole alignment.
    """
    chunk = F.floor(F.col("pos") / CHUNK)
    halo = F.floor((F.col("pos") - (width - 1)) / CHUNK)
    spread = (
        profiles.join(alignment_lengths(profiles), "aln_id")
        .select("aln_id", "pos", "aln_len", F.col(value).alias("value"))
        .withColumn("home", chunk)
        .withColumn("chunk", F.explode(F.array_distinct(F.array(chunk, halo))))
    )
    frame = Window.partitionBy("aln_id", "chunk").orderBy("pos").rowsBetween(0, width - 1)
    return (
        spread.withColumn("mean_value", F.avg("value").over(frame))
        .where((F.col("home") == F.col("chunk")) & (F.col("pos") < F.col("aln_len") - width))
        .select("aln_id", "pos", "mean_value")
    )


#: Columns of a consensus chunk.
CHUNK_COLUMNS = 4096


def consensus_chunks(profiles: DataFrame, size: int = CHUNK_COLUMNS) -> DataFrame:
    """The consensus in rows of ``size`` columns: aln_id, chunk, bases. However wide an alignment, no row is wider."""
    chunk = F.floor(F.col("pos") / size).alias("chunk")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "cons_base")))
    return profiles.groupBy("aln_id", chunk).agg(F.array_join(F.transform(ordered, lambda x: x["cons_base"]), "").alias("bases"))


def consensus_string(profiles: DataFrame, size: int = CHUNK_COLUMNS) -> DataFrame:
    """The consensus as one string per alignment, put together from its chunks; wide alignments are better left in chunks."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "bases")))
    whole = consensus_chunks(profiles, size).groupBy("aln_id").agg(F.array_join(F.transform(ordered, lambda x: x["bases"]), "").alias("consensus"))
    means = profiles.groupBy("aln_id").agg(F.avg("conservation").alias("mean_conservation"))
    return whole.join(means, "aln_id")


def consensus_spans(spans: DataFrame, chunks: DataFrame, size: int = CHUNK_COLUMNS) -> DataFrame:
    """Bases of spans(aln_id, start, len): aln_id, start, len, bases; each distinct span once, cut off where the alignment ends.

    A span meets the chunks that it lies in, one or two unless it is longer than a chunk.
    """
    keys = ["aln_id", "start", "len"]
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("len") - 1) / size)
    placed = spans.select(*keys).distinct().where("start >= 0 and len > 0").withColumn("chunk", F.explode(F.sequence(first, last)))
    from_, to = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0)), F.least(F.col("start") + F.col("len") - F.col("chunk") * size, F.lit(size))
    piece = F.substring(F.col("bases"), (from_ + 1).cast("int"), (to - from_).cast("int"))
    pieces = placed.join(chunks, ["aln_id", "chunk"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("piece")))).alias("pieces"))
    return pieces.select(*keys, F.array_join(F.col("pieces.piece"), "").alias("bases"))


def _spans(regions: DataFrame, last: Column) -> DataFrame:
    """Distinct (alignment, start, stop) spans, one row per position in them.

    Equal spans are looked up once, so popular regions add no work.
    """
    return (
        regions.select("aln_id", "start", "stop")
        .distinct()
        .withColumn("pos", F.explode(F.sequence(F.col("start"), last)))
    )


def region_total_conservation(regions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sum and mean of conservation over the inclusive region [start, stop]."""
    size = F.col("stop") - F.col("start") + 1
    totals = (
        _spans(regions, F.col("stop"))
        .join(profiles.select("aln_id", "pos", "conservation"), ["aln_id", "pos"])
        .groupBy("aln_id", "start", "stop")
        .agg(F.sum("conservation").alias("total_conservation"))
        .withColumn("mean_conservation", F.col("total_conservation") / size)
    )
    return regions.join(totals, ["aln_id", "start", "stop"])


def mirrored_regions(regions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Regions given in coordinates of the other strand, in forward coordinates."""
    return regions.join(lengths, "aln_id").select(
        "region_id",
        "aln_id",
        (F.col("aln_len") - 1 - F.col("stop")).alias("start"),
        (F.col("aln_len") - 1 - F.col("start")).alias("stop"),
    )


def primer_positions(five_p: str, length: str, is_reverse: Column) -> Column:
    """Positions under a primer in its own 5'-3' order; reverse primers walk down."""
    up = F.sequence(F.col(five_p), F.col(five_p) + F.col(length) - 1)
    down = F.sequence(F.col(five_p), F.col(five_p) - F.col(length) + 1)
    return F.when(is_reverse, down).otherwise(up)


def primer_conservation(primers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Conservation per base of each primer, in 5'-3' order, one row per base.

    primers(primer_id, aln_id, five_p, len, is_reverse)
    """
    placed = primers.select(
        "primer_id",
        "aln_id",
        F.posexplode(primer_positions("five_p", "len", F.col("is_reverse"))).alias("i", "pos"),
    )
    return placed.join(
        profiles.select("aln_id", "pos", "conservation"), ["aln_id", "pos"]
    ).select("primer_id", "i", "pos", "conservation")


def region_polymorphisms(regions: DataFrame, alignments: DataFrame) -> DataFrame:
    """Per half-open region and sequence, the residues that are not A, T, C, G."""
    odd = explode_alignment(alignments).where(~F.col("base").isin(*C.BASES))
    hits = _spans(regions.where(F.col("start") < F.col("stop")), F.col("stop") - 1).join(
        odd, ["aln_id", "pos"]
    )
    per_sequence = hits.groupBy("aln_id", "start", "stop", "name").agg(
        F.sort_array(F.collect_list("pos")).alias("positions")
    )
    return regions.join(per_sequence, ["aln_id", "start", "stop"])


def _half_open(regions: DataFrame, profiles: DataFrame) -> DataFrame:
    return _spans(regions.where(F.col("start") < F.col("stop")), F.col("stop") - 1).join(
        profiles.select("aln_id", "pos", "conservation", "pct_missed"), ["aln_id", "pos"]
    )


def region_worst_gap(regions: DataFrame, profiles: DataFrame) -> DataFrame:
    """First position of the highest missed percentage, where there is any."""
    worst = (
        _half_open(regions, profiles)
        .groupBy("aln_id", "start", "stop")
        .agg(F.max(F.struct("pct_missed", (-F.col("pos")).alias("low"))).alias("w"))
        .where(F.col("w.pct_missed") > 0)
        .select(
            "aln_id", "start", "stop",
            (-F.col("w.low")).alias("worst_pos"), F.col("w.pct_missed").alias("worst_pct"),
        )
    )
    return regions.join(worst, ["aln_id", "start", "stop"])


def region_low_conservation(
    regions: DataFrame, profiles: DataFrame, threshold: float = C.LOW_CONSERVATION
) -> DataFrame:
    low = _half_open(regions, profiles).where(F.col("conservation") < threshold)
    return regions.join(
        low.select("aln_id", "start", "stop", "pos", "conservation"), ["aln_id", "start", "stop"]
    )


def region_warning_summary(
    regions: DataFrame,
    alignments: DataFrame,
    profiles: DataFrame,
    threshold: float = C.LOW_CONSERVATION,
) -> DataFrame:
    """One row per region: bounds check, polymorphic sequences, worst gap, weak sites.

    Sequences with odd residues are counted from (region, name) pairs; the column
    warnings come from one pass over the region's columns.
    """
    keys = ["aln_id", "start", "stop"]
    bounded = regions.join(alignment_lengths(profiles), "aln_id").withColumn(
        "in_bounds",
        (F.col("start") >= 0) & (F.col("start") < F.col("stop")) & (F.col("stop") < F.col("aln_len")),
    )
    valid = bounded.where("in_bounds")
    odd = explode_alignment(alignments).where(~F.col("base").isin(*C.BASES)).select(
        "aln_id", "pos", "seq_idx"
    )
    species = (
        _spans(valid, F.col("stop") - 1)
        .join(odd, ["aln_id", "pos"])
        .select(*keys, "seq_idx")
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_polymorphic"))
    )
    columns = (
        _half_open(valid, profiles)
        .groupBy(*keys)
        .agg(
            F.max(F.struct("pct_missed", (-F.col("pos")).alias("low"))).alias("w"),
            F.count_if(F.col("conservation") < threshold).alias("n_low"),
            F.min("conservation").alias("min_conservation"),
        )
    )
    some = F.col("w.pct_missed") > 0
    return (
        bounded.join(species, keys, "left")
        .join(columns, keys, "left")
        .select(
            "region_id", *keys, "in_bounds",
            F.coalesce("n_polymorphic", F.lit(0)).alias("n_polymorphic"),
            F.when(some, -F.col("w.low")).alias("worst_pos"),
            F.when(some, F.col("w.pct_missed")).alias("worst_pct"),
            F.coalesce("n_low", F.lit(0)).alias("n_low"),
            "min_conservation",
        )
    )


def annotate_regions(pairs: DataFrame) -> DataFrame:
    """Label each position of a chosen pair's amplicon: primer or amplicon.

    pairs(pair_id, aln_id, f_5p, f_len, r_5p, r_len)
    """
    forward_end = F.col("f_5p") + F.col("f_len") - 1
    reverse_start = F.col("r_5p") - F.col("r_len") + 1
    under_primer = (F.col("pos") <= F.col("forward_end")) | (F.col("pos") >= F.col("reverse_start"))
    return (
        pairs.withColumns({"forward_end": forward_end, "reverse_start": reverse_start})
        .withColumn("pos", F.explode(F.sequence("f_5p", "r_5p")))
        .select(
            "pair_id", "aln_id", "pos",
            F.when(under_primer, "primer").otherwise("amplicon").alias("label"),
        )
    )
