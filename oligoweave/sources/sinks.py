"""Outputs: FASTA pools and sets, binding reports, score tables, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoweave.functions.sequence import reverse_complement


def fasta_pool_text(pool: DataFrame) -> DataFrame:
    """pool(panel_id, i, target, f_primer, r_primer) to one text record per locus.

    Unnamed loci carry their number behind the direction.
    """
    named = F.coalesce(F.col("target"), F.lit("")) != ""
    label = F.when(named, F.col("target")).otherwise("")
    number = F.when(named, "").otherwise((F.col("i") + 1).cast("string"))
    text = F.concat(
        F.lit(">"), label, F.lit("_F"), number, F.lit("\n"), F.col("f_primer"), F.lit("\n>"),
        label, F.lit("_R"), number, F.lit("\n"), F.col("r_primer"),
    )
    return pool.select("panel_id", "i", text.alias("text"))


def sink_fasta_pool(pool: DataFrame, path: str) -> None:
    """One folder per panel, written by one task; the panels are spread over all tasks."""
    fasta_pool_text(pool).select("panel_id", "text").repartition(
        int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), "panel_id"
    ).write.partitionBy("panel_id").text(path)


def fasta_set_text(sets: DataFrame, fasta: bool = True) -> DataFrame:
    """Four-primer sets as text, one row per primer.

    sets(set_no, k, dir, adapter, index_seq, spacer, binding); primers are numbered
    set * 4 + 1 onwards and spacers are in lower case. Without ``fasta``: sequences only.
    """
    if not fasta:
        return sets.withColumn(
            "text", F.concat("adapter", "index_seq", "spacer", "binding")
        )
    number = (F.col("set_no") * 4 + 1 + F.col("k")).cast("string")
    direction = F.when(F.col("dir") == "F", "Forward").otherwise("Reverse")
    text = F.concat(
        F.lit(">"), direction, F.lit(" #"), number, F.lit("\n"),
        F.col("adapter"), F.col("index_seq"), F.lower("spacer"), F.col("binding"),
    )
    return sets.withColumn("text", text)


def sink_fasta_sets(sets: DataFrame, path: str, fasta: bool = True) -> None:
    fasta_set_text(sets, fasta).select("text").write.text(path)


def binding_report(pairs: DataFrame) -> DataFrame:
    """Bounds, sequences and the reverse complement of each chosen pair.

    pairs(panel_id, target, score, f_5p, f_len, r_5p, r_len, f_seq, r_seq)
    """
    return pairs.select(
        "panel_id",
        "target",
        "score",
        F.col("f_5p").alias("f_start"),
        (F.col("f_5p") + F.col("f_len") - 1).alias("f_end"),
        "f_seq",
        (F.col("r_5p") - F.col("r_len") + 1).alias("r_start"),
        F.col("r_5p").alias("r_end"),
        "r_seq",
        reverse_complement("r_seq").alias("r_seq_rc"),
    )


def sink_binding_report(pairs: DataFrame, path: str, fmt: str = "json") -> None:
    binding_report(pairs).write.format(fmt).save(path)


def sink_scores_csv(scores: DataFrame, path: str) -> None:
    scores.write.option("header", True).csv(path)


def append_run_log(
    rows: DataFrame, path: str, partition_by: list[str] | None = None, batch_id: int | None = None
) -> None:
    """Append run titles, results and failures; concurrent runs add files, never rewrite.

    With a batch id the rows are that batch's partition of the log, so a batch that is
    written again replaces itself.
    """
    if batch_id is not None:
        (
            rows.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", *(partition_by or []))
            .parquet(path)
        )
        return
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def clustal_text(alignments: DataFrame, width: int = 60) -> DataFrame:
    """Alignments as interleaved block lines, for exchange with block-format tools."""
    pieces: Column = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / width)),
        lambda b: F.substring("seq", (b * width + 1).cast("int"), F.lit(width)),
    )
    return alignments.select("aln_id", "seq_idx", "name", F.posexplode(pieces).alias("block", "chunk")).select(
        "aln_id", "block", "seq_idx", F.concat_ws("      ", "name", "chunk").alias("text")
    )
