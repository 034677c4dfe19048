"""Reproducible shuffle into shards: a Feistel permutation of the global row numbers.

Rows are numbered by their values, so the same rows get the same numbers whatever the
files, partitions or executors. A Feistel network over the pairs of a rectangle just
larger than the row count permutes the numbers; a result outside the count walks the
cycle on until it is inside. Shard and slot follow from the permuted number alone, and
the counts of two shards differ by one at most. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.llm.common import rows_of, text_or_empty

SHARDS = 16
ROUNDS = 6
#: Parts of the numbering; also the most rows of the table of part starts, which is broadcast.
PARTS = 4096
#: Copies of one row that one task numbers at a time.
COPIES = 65_536


def feistel(x: Column, left: Column, right: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 .. left * right - 1: the halves x div right and x mod right, mixed in turn."""
    start = F.struct(F.floor(x / right).cast("long").alias("l"), F.pmod(x, right).alias("r"))

    def half_round(p: Column, k: Column) -> Column:
        return F.when(
            k % 2 == 0,
            F.struct(F.pmod(p["l"] + F.pmod(F.xxhash64(F.lit(seed), k, p["r"]), left), left).alias("l"), p["r"].alias("r")),
        ).otherwise(
            F.struct(p["l"].alias("l"), F.pmod(p["r"] + F.pmod(F.xxhash64(F.lit(seed), k, p["l"]), right), right).alias("r"))
        )

    steps = F.array(*(F.lit(k) for k in range(2 * rounds)))
    return F.aggregate(steps, start, half_round, lambda p: p["l"] * right + p["r"])


def permuted(number: Column, total: Column, seed: int) -> Column:
    """The place of a row number in a shuffle of `total` rows.

    The rectangle has fewer than sqrt(total) + 1 numbers too many, so a walk of that many
    steps always ends inside; about one row in sqrt(total) walks at all.
    """
    left = F.greatest(F.floor(F.sqrt(total.cast("double"))).cast("long"), F.lit(1).cast("long"))
    right = F.ceil(total / left).cast("long")
    once = feistel(number, left, right, seed)
    walk = F.aggregate(
        F.sequence(F.lit(1).cast("long"), left + 1),
        once,
        lambda at, _: F.when(at < total, at).otherwise(feistel(at, left, right, seed)),
    )
    return F.when(once < total, once).otherwise(walk)


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number rows from 0 by their values: adds `row_number` and `n_rows`.

    Equal rows are counted first and numbered from their count, so a row that is repeated
    very often is one row until the end.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("copies")).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    sizes = counted.groupBy("part").agg(F.sum("copies").alias("rows"))
    ordered = Window.orderBy("part")
    starts = sizes.select(
        "part",
        (F.sum("rows").over(ordered) - F.col("rows")).alias("part_start"),
        F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"),
    )
    own = Window.partitionBy("part").orderBy(*keys)
    placed = (
        counted.withColumn("first", F.sum("copies").over(own) - F.col("copies"))
        .join(F.broadcast(starts), "part")
        .withColumn("first", F.col("part_start") + F.col("first"))
    )
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    last = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("block") * COPIES) - 1
    rows = blocks.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.select(*keys, (F.col("first") + F.col("block") * COPIES + F.col("nth")).alias("row_number"), "n_rows")


def shard_rows(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = 20_170_401) -> DataFrame:
    """Shuffle rows into shards: keys, row_number, place, shard, slot.

    The law is `rows`: place mod shards is the shard, place div shards the slot, so slots
    are gapless from 0 and counts differ by one at most. Null keys are ordinary values,
    equal rows get places of their own, and an empty table gives no rows.
    """
    rows = numbered(df, keys)
    place = permuted(F.col("row_number"), F.col("n_rows"), seed)
    return rows.withColumn("place", place).select(
        *keys, "row_number", "place", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).alias("slot")
    )


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 20_170_401) -> DataFrame:
    """Shards of documents: doc_id, size, text_crc32, shard, slot; size is the UTF-8 bytes of the text plus 1.

    Null text: no bytes. The text itself is read once and never shuffled.
    """
    rows = rows_of(df, doc_id=id_col, text=text_col).select(
        "doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(text_or_empty()).alias("text_crc32")
    )
    return shard_rows(rows, ["doc_id", "size", "text_crc32"], shards, seed)
