"""Alignment files: FASTA and interleaved block formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoweave.sources.lines import numbered_records

# File name endings read as FASTA whatever format is asked for.
FASTA_SUFFIXES = ("fa", "fas", "fst", "fasta")


def fasta_fields(record: Column) -> dict[str, Column]:
    """Name (the whole description line) and sequence of one '>'-delimited record."""
    body = F.regexp_replace(record, r"^\s*>", "")
    name = F.trim(F.substring_index(body, "\n", 1))
    rest = F.substring(body, F.length(F.substring_index(body, "\n", 1)) + 1, F.length(body))
    return {"name": name, "seq": F.regexp_replace(rest, r"\s", "")}


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(aln_id, seq_idx, name, seq) of every FASTA file under a path; aln_id is the file's path.

    Records are cut at '\\n>' by the reader itself, so a file of any size is split over
    tasks and no file is held in memory.
    """
    return _fasta_rows(numbered_records(spark, path, "\n>"))


def _fasta_rows(records: DataFrame) -> DataFrame:
    fields = fasta_fields(F.col("text"))
    return records.where(F.trim("text") != "").select(
        F.col("file").alias("aln_id"),
        F.col("line_no").alias("seq_idx"),
        fields["name"].alias("name"),
        fields["seq"].alias("seq"),
    )


def _joined_chunks(chunks: DataFrame) -> DataFrame:
    """(file, name, line_no, chunk) to one row per sequence, chunks in file order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "chunk")))
    merged = chunks.groupBy("file", "name").agg(
        F.array_join(F.transform(ordered, lambda x: x["chunk"]), "").alias("seq"),
        F.min("line_no").alias("first_line"),
    )
    return merged


def scan_block_alignment(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(aln_id, seq_idx, name, seq) from clustal, stockholm or phylip-relaxed files.

    seq_idx is the line on which a sequence first appears, counted from the first
    sequence line of its file; it increases in file order.
    """
    return _block_rows(numbered_records(spark, path), fmt)


def _block_rows(lines: DataFrame, fmt: str) -> DataFrame:
    if fmt in ("clustal", "stockholm"):
        chunks = _named_chunks(lines, fmt)
    elif fmt == "phylip-relaxed":
        chunks = _phylip_chunks(lines)
    else:
        raise ValueError(f"unknown block format: {fmt}")
    merged = _joined_chunks(chunks)
    start = merged.groupBy("file").agg(F.min("first_line").alias("start"))
    return merged.join(start, "file").select(
        F.col("file").alias("aln_id"),
        (F.col("first_line") - F.col("start")).alias("seq_idx"),
        "name",
        "seq",
    )


def _named_chunks(lines: DataFrame, fmt: str) -> DataFrame:
    """Lines that start with the sequence name: 'name chunk [count]'."""
    text = F.col("text")
    skip = r"^CLUSTAL|^MUSCLE|^\s|^$" if fmt == "clustal" else r"^#|^//|^\s*$"
    return lines.where(~text.rlike(skip)).select(
        "file",
        "line_no",
        F.regexp_extract(text, r"^(\S+)\s+(\S+)", 1).alias("name"),
        F.regexp_extract(text, r"^(\S+)\s+(\S+)", 2).alias("chunk"),
    )


def _phylip_chunks(lines: DataFrame) -> DataFrame:
    """Header 'count width', then blocks of ``count`` lines; only the first is named.

    Blocks are separated by one blank line, so the line number alone tells the row.
    """
    text = F.col("text")
    header = lines.where("line_no = 0").select(
        "file", F.regexp_extract(text, r"^\s*(\d+)\s+(\d+)", 1).try_cast("int").alias("count")
    )
    body = (
        lines.where("line_no > 0")
        .join(header, "file")
        .withColumns(
            {
                "row": F.pmod(F.col("line_no") - 1, F.col("count") + 1),
                "block": F.floor((F.col("line_no") - 1) / (F.col("count") + 1)),
            }
        )
        .where(F.col("row") < F.col("count"))
    )
    named = body.where("block = 0").select(
        "file", "row", F.regexp_extract(text, r"^(\S+)\s+(.*)$", 1).alias("name")
    )
    bare = F.when(
        F.col("block") == 0, F.regexp_extract(text, r"^(\S+)\s+(.*)$", 2)
    ).otherwise(text)
    return body.join(named, ["file", "row"]).select(
        "file", "line_no", "name", F.regexp_replace(bare, r"\s", "").alias("chunk")
    )


def scan_alignments(spark: SparkSession, path: str, fmt: str = "fasta") -> DataFrame:
    """Any supported format, decided file by file: a FASTA file ending overrides the format asked for.

    The ending is a condition on the file's path, so each reading opens its own files only.
    """
    if fmt == "fasta":
        return scan_fasta(spark, path)
    is_fasta = F.lower("file").rlike(rf"\.({'|'.join(FASTA_SUFFIXES)})$")
    fasta = _fasta_rows(numbered_records(spark, path, "\n>").where(is_fasta))
    return fasta.unionByName(_block_rows(numbered_records(spark, path).where(~is_fasta), fmt))
