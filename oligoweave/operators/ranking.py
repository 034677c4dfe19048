"""Top-n, merges, gathers and orders over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group by a total order.

    Spark turns this filter into a partial limit before the shuffle, so a group of any
    size sends at most n rows per task.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn("_position", position).where(F.col("_position") <= n)
    return kept.withColumnRenamed("_position", rank) if rank else kept.drop("_position")


def n_lowest(
    df: DataFrame, keys: list[str], score: str, index: list[str], n: int, highest: bool = False
) -> DataFrame:
    """n lowest (or highest) scores per list; equal scores in index order."""
    lead = F.col(score).desc() if highest else F.col(score).asc()
    return top_n(df, keys, [lead, *[F.col(c).asc() for c in index]], n, "position")


def n_lowest_overall(df: DataFrame, score: str, index: list[str], n: int, highest: bool = False) -> DataFrame:
    """The same over one list: every task keeps n rows, the rest never moves."""
    lead = F.col(score).desc() if highest else F.col(score).asc()
    return df.orderBy(lead, *index).limit(n)


def merge_top_n(frames: list[DataFrame], keys: list[str], order: list[Column], n: int) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return top_n(merged, keys, order, n)


def co_sort(df: DataFrame, keys: list[str], score: str, index: list[str]) -> DataFrame:
    """Stable order of values and their followers: a range-partitioned sort.

    The index is part of the sort key, so even one list, or one repeated score, is split
    over many tasks.
    """
    return df.orderBy(*keys, score, *index)


def keep_lowest_scores(
    df: DataFrame, keys: list[str], score: str, index: str, n: int, reverse: bool = False
) -> DataFrame:
    """All but the n lowest dropped; reversed, all but the n highest, later index first."""
    if reverse:
        order = [F.col(score).desc(), F.col(index).desc()]
    else:
        order = [F.col(score).asc(), F.col(index).asc()]
    return top_n(df, keys, order, n)


# --- the k lowest of a group, by counts ------------------------------------------------

#: Indexes in a bucket: as many rows of equal score as are ever sorted in one place.
BUCKET = 1024


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group the distinct values in order, each with how often it occurs."""
    counts = df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("counts"))


def _cut(counts: Column, k: Column, kind: str) -> Column:
    """The value that the k-th lowest has, and how many rows of that value are among the k; no value if all rows are."""
    none = F.lit(None).cast(kind)
    start = F.struct(none.alias("value"), k.cast("bigint").alias("left"))

    def step(state: Column, x: Column) -> Column:
        here = state["value"].isNull() & (x["n"] >= state["left"])
        return F.struct(
            F.when(here, x["value"]).otherwise(state["value"]).alias("value"),
            F.when(here | state["value"].isNotNull(), state["left"]).otherwise(state["left"] - x["n"]).alias("left"),
        )

    return F.aggregate(counts, start, step)


def mean_of_lowest(df: DataFrame, keys: list[str], score: str, sizes: DataFrame, k: str) -> DataFrame:
    """Mean of the k lowest scores of each group (all if k is 0 or there are fewer); sizes(keys, k).

    Worked out on the distinct scores of a group and their numbers; its rows are not sorted.
    """
    rows = _counted(df, keys, score).join(sizes.select(*keys, F.col(k).alias("k")), keys)
    start = F.struct(F.when(F.col("k") > 0, F.col("k")).cast("bigint").alias("left"), F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n"))

    def step(state: Column, x: Column) -> Column:
        taken = F.least(x["n"], F.coalesce(state["left"] - state["n"], x["n"]))
        return F.struct(state["left"].alias("left"), (state["sum"] + x["value"] * taken).alias("sum"), (state["n"] + taken).alias("n"))

    return rows.select(*keys, F.aggregate("counts", start, step, lambda state: state["sum"] / state["n"]).alias("mean"))


def lowest_by_counts(df: DataFrame, keys: list[str], score: str, index: str, sizes: DataFrame, k: str) -> DataFrame:
    """The k lowest rows of each group, equal scores by a whole-number index; sizes(keys, k).

    Counts of the distinct scores tell the score where the k end, counts of buckets of indexes
    where they end among equal scores; only the rows of one bucket are put in order.
    """

    def split(rows: DataFrame, value: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        kind = rows.schema[value].dataType.simpleString()
        cuts = _counted(rows, keys, value).join(wanted.select(*keys, F.col("k").alias("_k")), keys).where("_k > 0")
        cuts = cuts.select(*keys, _cut(F.col("counts"), F.col("_k"), kind).alias("_cut"))
        placed = rows.join(cuts, keys)
        inside = placed.where(F.col("_cut.value").isNull() | (F.col(value) < F.col("_cut.value")))
        return inside.drop("_cut"), placed.where(F.col(value) == F.col("_cut.value")).withColumn("_left", F.col("_cut.left")).drop("_cut")

    below, ties = split(df, score, sizes.select(*keys, F.col(k).alias("k")))
    ties = ties.withColumn("_bucket", F.floor(F.col(index) / BUCKET))
    inside, last = split(ties.drop("_left"), "_bucket", ties.groupBy(*keys).agg(F.first("_left").alias("k")))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(index))
    last = last.withColumn("_order", order).where(F.col("_order") <= F.col("_left"))
    return below.select(*df.columns).unionByName(inside.select(*df.columns)).unionByName(last.select(*df.columns))


def pick_by_index(picks: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Gather values by position: an equi-join on the ordinals."""
    return picks.join(values, on)


def dedupe_keep_first(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Concatenate, keep the first row per key (earlier frame, then order columns)."""
    tagged = None
    for i, frame in enumerate(frames):
        part = frame.withColumn("source", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    rest = [c for c in tagged.columns if c not in keys]
    first = F.min(F.struct("source", *order, *[c for c in rest if c not in ("source", *order)]))
    return tagged.groupBy(*keys).agg(first.alias("first")).select(*keys, "first.*")
