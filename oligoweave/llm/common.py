"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "public_tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that no other column can clash.

    The first column of that name counts where a frame has two that differ in case only.
    """
    return df.select(*(df[old].alias(new) for new, old in columns.items()))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on this machine (looked up in each worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
