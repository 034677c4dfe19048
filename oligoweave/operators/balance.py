"""Spacer lengths that make every column of a panel as even as it can be, smallest total first.

The bases of all columns are counted in a few whole numbers: one field of some bits per
column, one number per base (more if the columns do not fit). Shifting a sequence by its
spacer is a shift of its numbers, adding it an addition, and whether a column can still
become even is seen from the top bits of all fields at once. The counts are carried along
the prefix, so a combo costs a few additions per sequence.

Columns are no more than the shortest sequence has bases, so only spacers leave them vacant.

The least combo of a panel is searched with bounds (``least_spacers``). Compositions
of a total are numbered by counting what comes before them, so any of them can be made from
its number and drawn with equal chance without listing the others.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoweave.functions import constants as C
from oligoweave.functions import sequence as S
from oligoweave.operators import multiplex as M
from oligoweave.operators.least_spacers import Search
from oligoweave.session import cut_lineage, spread


def _shift(value: Column, fields: Column, bits: int) -> Column:
    """Moved up by so many fields, or down if negative."""
    up = F.call_function("shiftleft", value, F.greatest(fields, F.lit(0)) * bits)
    return F.when(fields >= 0, up).otherwise(F.call_function("shiftrightunsigned", value, -fields * bits))


class Columns:
    """Counts of bases in the first ``width`` columns of ``n`` shifted sequences."""

    def __init__(self, n: int, width: int):
        self.n, self.width = n, width
        self.bits = n.bit_length() + 1
        self.per = 62 // self.bits
        self.words = -(-width // self.per)
        self.names = [f"count_{base}_{word}" for base in C.BASES for word in range(self.words)]

    def _each(self, value: int, fields: int | None = None) -> int:
        return sum(value << (self.bits * i) for i in range(self.per if fields is None else fields))

    def _fields(self, word: int) -> int:
        return min(self.per, self.width - word * self.per)

    def masks(self, seqs: Column) -> Column:
        """For every sequence, base and word the columns that hold the base, unshifted."""

        def mask(seq: Column, base: str, word: int) -> Column:
            at = F.sequence(F.lit(0), F.lit(self._fields(word) - 1))
            same = lambda i: F.substring(seq, i + word * self.per + 1, F.lit(1)) == base
            one = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i * self.bits)
            return F.aggregate(at, F.lit(0).cast("bigint"), lambda bits, i: bits + F.when(same(i), one(i)).otherwise(F.lit(0).cast("bigint")))

        return F.flatten(F.transform(seqs, lambda q: F.array(*(mask(q, base, word) for base in C.BASES for word in range(self.words)))))

    def shifted(self, masks: Column, k: int, spacer: Column) -> list[Column]:
        """What sequence k adds to the counts behind a spacer, per base and word."""
        out = []
        for base in range(len(C.BASES)):
            at = [F.get(masks, F.lit((k * len(C.BASES) + base) * self.words + word)) for word in range(self.words)]
            for word in range(self.words):
                moved = F.lit(0).cast("bigint")
                for source in range(word + 1):
                    # fields of a word stand `per` apart from those of the word before it
                    fields = spacer - (word - source) * self.per
                    reach = (fields > -self.per) & (fields < self.per)
                    moved = moved.bitwiseOR(F.when(reach, _shift(at[source], fields, self.bits)).otherwise(F.lit(0).cast("bigint")))
                out.append(moved.bitwiseAND(self._each((1 << self.bits) - 1, self._fields(word))))
        return out

    def _at_least(self, count: Column, least: int) -> Column:
        """The top bit of each field that holds ``least`` or more."""
        top = 1 << (self.bits - 1)
        return (count + self._each(top - least)).bitwiseAND(self._each(top))

    def can_be_even(self, counts: list[Column]) -> Column:
        """Whether the vacant copies of every column can still make it as even as n copies allow.

        No base may stand more often than the even share, rounded up, and only so many bases
        as often as that, as copies are left beyond the share rounded down.
        """
        quota, rest = -(-self.n // 4), self.n % 4
        good = []
        for word in range(self.words):
            own = counts[word :: self.words]
            good += [self._at_least(count, quota + 1) == 0 for count in own]
            if rest:
                full = [F.call_function("shiftrightunsigned", self._at_least(count, quota), F.lit(self.bits - 1)) for count in own]
                good.append(self._at_least(reduce(Column.__add__, full), rest + 1) == 0)
        return reduce(Column.__and__, good)


def even_combos(sized: DataFrame, n: int, width: int, limit: int) -> DataFrame:
    """All combos of 0..limit that make all columns even, for panels(panel_id, seqs) of n sequences.

    A prefix is left as soon as a column cannot
    become even. After the second sequence rows are spread anew, so the search of one panel
    is many tasks. Adds ``combo`` and ``total``.
    """
    tasks = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    columns = Columns(n, width)
    zero = F.lit(0).cast("bigint")
    rows = sized.select("panel_id", columns.masks(F.col("seqs")).alias("masks"), F.array().cast("array<int>").alias("combo"), F.lit(0).alias("total"))
    rows = rows.select("*", *(zero.alias(name) for name in columns.names))
    for k in range(n):
        grown = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(limit))))
        counts = [F.col(name) + added for name, added in zip(columns.names, columns.shifted(F.col("masks"), k, F.col("s")), strict=True)]
        rows = grown.select(
            "panel_id", "masks", F.concat("combo", F.array("s")).alias("combo"), (F.col("total") + F.col("s")).alias("total"),
            *(count.alias(name) for name, count in zip(columns.names, counts, strict=True)),
        ).where(columns.can_be_even([F.col(name) for name in columns.names]))
        if k == 1 and n > 3:
            rows = rows.repartition(tasks, "panel_id", "combo")
    return rows.select("panel_id", "combo", "total")


def balanced_spacer_search(panels: DataFrame, width: int, limit: int) -> DataFrame:
    """The even combo of the smallest total of each panel, and how many even combos of any total it has."""
    panels = cut_lineage(panels)
    counts = M.by_panel_size(panels, lambda sized, n: even_combos(sized, n, width, limit)).groupBy("panel_id").agg(
        F.count(F.lit(1)).alias("n_balanced")
    )
    return smallest_total(panels, width, limit).join(counts, "panel_id")


def diversity_table(n: int) -> np.ndarray:
    """Score of a column of n copies by its counts of the four bases; vacant copies go to the scarcest base, one by one."""
    table = np.zeros((n + 1,) * 4, np.int64)
    for counts in itertools.product(range(n + 1), repeat=4):
        if sum(counts) <= n:
            poured = sorted(counts)
            for _ in range(n - sum(counts)):
                poured = sorted([poured[0] + 1, *poured[1:]])
            table[counts] = math.floor(round(math.prod(max(x / n * 100, 1.0) for x in poured), 6))
    return table


def counted_vectors(sized: DataFrame, n: int, width: int, limit: int) -> DataFrame:
    """Every vector of spacers 0..limit of every panel of n sequences with its column counts.

    The counts of a prefix serve all vectors that begin with it: each vector adds one
    sequence to them. Adds ``combo``, ``total`` and the counts.
    """
    tasks = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns, zero = Columns(n, width), F.lit(0).cast("bigint")
    rows = sized.select(
        "panel_id", columns.masks(F.col("seqs")).alias("masks"), F.array().cast("array<int>").alias("combo"), F.lit(0).alias("total"),
        *(zero.alias(name) for name in columns.names),
    )
    for k in range(n):
        grown = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(limit))))
        added = columns.shifted(F.col("masks"), k, F.col("s"))
        rows = grown.select(
            "panel_id", "masks", F.concat("combo", F.array("s")).alias("combo"), (F.col("total") + F.col("s")).alias("total"),
            *((F.col(name) + more).alias(name) for name, more in zip(columns.names, added, strict=True)),
        )
        if k == 1 and n > 3:
            rows = rows.repartition(tasks, "panel_id", "combo")
    return rows.drop("masks")


def vector_scores(counted: DataFrame, n: int, width: int) -> DataFrame:
    """panel_id, combo, total, score: the least diverse of the first columns, looked up by their counts."""
    columns = Columns(n, width)
    names, bits, per, table = columns.names, columns.bits, columns.per, diversity_table(n)
    kind = counted.schema["panel_id"].dataType.simpleString()
    words = columns.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [batch.column(name).to_numpy() for name in names]
            worst = np.full(batch.num_rows, 25**4, np.int64)
            for col in range(width):
                at = [(counts[base * words + col // per] >> (bits * (col % per))) & ((1 << bits) - 1) for base in range(4)]
                worst = np.minimum(worst, table[tuple(at)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("panel_id"), batch.column("combo"), batch.column("total"), pa.array(worst)], ["panel_id", "combo", "total", "score"]
            )

    return counted.mapInArrow(run, f"panel_id {kind}, combo array<int>, total int, score bigint")


def spacer_landscape(panels: DataFrame, width: int, limit: int) -> DataFrame:
    """Mean, sample deviation and worst column of every spacer vector of every panel, at its own size.

    A panel of one sequence has no deviation.
    """

    def of_size(sized: DataFrame, n: int) -> DataFrame:
        squares = F.aggregate("combo", F.lit(0), lambda a, x: a + x * x)
        total = F.col("total")
        return vector_scores(counted_vectors(sized, n, width, limit), n, width).select(
            "panel_id", "combo", (total / n).alias("mean_length"),
            F.sqrt((n * squares - total * total) / F.nullif(F.lit(n * (n - 1)), F.lit(0))).alias("sd_length"), "total", "score",
        )

    return M.by_panel_size(panels, of_size)


def landscape_by_total(landscape: DataFrame) -> DataFrame:
    """Per panel and total: vectors, their best and mean worst column."""
    return landscape.groupBy("panel_id", "total").agg(
        F.count("*").alias("n_vectors"), F.max("score").alias("best_score"), F.avg("score").alias("mean_score")
    )


def first_combo(found: DataFrame, *leading: Column) -> DataFrame:
    """Per panel the combo of least total, then of least reversed digits; ``leading`` columns go before."""
    best = F.min(F.struct(*(x.alias(f"lead{i}") for i, x in enumerate(leading)), "total", F.reverse("combo").alias("rev"), "combo")).alias("b")
    return found.groupBy("panel_id").agg(best).select("panel_id", F.col("b.combo").alias("combo"), F.col("b.total").alias("total"))


def _beams(n: int, width: int, limit: int, longest: bool):
    """Adds ``most`` to panels(panel_id, seqs): the key of a good even combo, which no least one is above."""
    columns = Columns(n, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            search = Search(batch.column("seqs").to_pylist(), n, width, limit, columns.bits, columns.per, longest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(search.beam())], ["panel_id", "seqs", "most"])

    return run


def _least(n: int, width: int, limit: int, longest: bool):
    """The least even combo of every panel of a batch of rows(panel_id, seqs, most, combo) that begins with one of their combos."""
    columns = Columns(n, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, first, panel = {}, [], []
            for i, key in enumerate(zip(batch.column("panel_id").to_pylist(), map(tuple, batch.column("seqs").to_pylist()), strict=True)):
                if key not in numbers:
                    numbers[key] = len(first)
                    first.append(i)
                panel.append(numbers[key])
            search = Search([list(seqs) for _, seqs in numbers], n, width, limit, columns.bits, columns.per, longest)
            combos = np.array(batch.column("combo").to_pylist(), np.int64).reshape(batch.num_rows, -1)
            most = batch.column("most").to_numpy()[first]
            found = list(search.least(np.array(panel, np.int64), combos, most))
            ids = batch.column("panel_id").take(pa.array([first[p] for p, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([combo.tolist() for _, combo in found], pa.list_(pa.int32()))], ["panel_id", "combo"])

    return run


def least_combos(sized: DataFrame, n: int, width: int, limit: int, longest: bool = False) -> DataFrame:
    """panel_id, combo, total: the even combo of the smallest total (``longest``: of the shortest longest spacer, then of the
    smallest total), then of the least reversed digits, for panels(panel_id, seqs) of n sequences that have one.

    A good combo of each panel is found first, as a bound. Then the search is exact, one row per
    pair of first spacers, so the search of one panel is many tasks.
    """
    tasks = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    kind = sized.schema["panel_id"].dataType.simpleString()
    spacer = F.sequence(F.lit(0), F.lit(limit))
    rows = spread(sized.select("panel_id", "seqs")).mapInArrow(_beams(n, width, limit, longest), f"panel_id {kind}, seqs array<string>, most bigint")
    if n > 3:
        rows = rows.select("*", F.explode(spacer).alias("one")).select("*", F.explode(spacer).alias("two"))
        rows = rows.select("panel_id", "seqs", "most", F.array("one", "two").alias("combo")).repartition(tasks, "panel_id", "combo")
    else:
        rows = rows.withColumn("combo", F.array().cast("array<int>"))
    found = rows.mapInArrow(_least(n, width, limit, longest), f"panel_id {kind}, combo array<int>")
    total = F.aggregate("combo", F.lit(0), lambda a, x: a + x)
    return first_combo(found.withColumn("total", total), *([F.array_max("combo")] if longest else []))


def smallest_total(panels: DataFrame, width: int, limit: int) -> DataFrame:
    """panel_id, combo, total: the even combo of the smallest total of each panel that has one, at its own size."""
    return M.by_panel_size(panels, lambda sized, n: least_combos(sized, n, width, limit))


def smallest_longest(panels: DataFrame, width: int, limit: int) -> DataFrame:
    """panel_id, combo, total, longest: the even combo whose longest spacer is shortest, then of smallest total."""
    found = M.by_panel_size(panels, lambda sized, n: least_combos(sized, n, width, limit, longest=True))
    return found.withColumn("longest", F.array_max("combo"))


# --- compositions by number ------------------------------------------------------------


def _ways(n: Column | int, limit: Column, total: Column) -> Column:
    """ways[k][t] for k = 0..n: how many k-tuples of 0..limit have the sum t = 0..total."""
    n = F.lit(n) if isinstance(n, int) else n
    sums = F.sequence(F.lit(0), total)
    start = F.transform(sums, lambda t: F.when(t == 0, 1).otherwise(0).cast("bigint"))

    def step(table: Column, _: Column) -> Column:
        ways = F.element_at(table, -1)
        before = F.aggregate(ways, F.array(F.lit(0).cast("bigint")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
        more = S.let(before, lambda b: F.transform(sums, lambda t: F.get(b, t + 1) - F.get(b, F.greatest(t - limit, F.lit(0)))))
        return F.concat(table, F.array(more))

    return F.aggregate(F.sequence(F.lit(1), n), F.array(start), step)


def with_ways(rows: DataFrame, n: int, limit: str, total: str) -> DataFrame:
    """Rows with the table ``ways`` for n-tuples of 0..limit with the sum total."""
    return rows.withColumn("ways", _ways(n, F.col(limit), F.col(total)))


def _ahead(ways: Column, k: Column, left: Column, digit: Column) -> Column:
    """How many k + 1-tuples with the sum ``left`` have a last digit below ``digit``."""
    fewer = F.when(digit > 0, F.sequence(F.lit(0), digit - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(fewer, F.lit(0).cast("bigint"), lambda done, v: done + F.coalesce(F.when(left >= v, F.get(F.get(ways, k), left - v)), F.lit(0)))


def rank_of(ways: Column, combo: Column, total: Column) -> Column:
    """Number of a composition among those of its total, the first digit running fastest."""
    start = F.struct(F.lit(0).cast("bigint").alias("rank"), total.cast("int").alias("left"))

    def step(state: Column, k: Column) -> Column:
        digit = F.get(combo, k)
        return F.struct((state["rank"] + _ahead(ways, k, state["left"], digit)).alias("rank"), (state["left"] - digit).alias("left"))

    return F.aggregate(F.reverse(F.sequence(F.lit(0), F.size(combo) - 1)), start, step, lambda state: state["rank"])


def composition_at(ways: Column, rank: Column, n: int, limit: Column, total: Column) -> Column:
    """The composition of a number, the reverse of ``rank_of``."""
    start = F.struct(F.array().cast("array<int>").alias("combo"), rank.cast("bigint").alias("rank"), total.cast("int").alias("left"))

    def step(state: Column, k: Column) -> Column:
        digits = F.sequence(F.lit(0), F.least(limit, state["left"]))
        # the last digit is the largest one that has no more tuples ahead of it than the number says
        digit = F.array_max(F.filter(digits, lambda v: _ahead(ways, k, state["left"], v) <= state["rank"]))
        return S.let(
            digit,
            lambda d: F.struct(
                F.concat(F.array(d), state["combo"]).alias("combo"), (state["rank"] - _ahead(ways, k, state["left"], d)).alias("rank"), (state["left"] - d).alias("left")
            ),
        )

    return F.aggregate(F.reverse(F.sequence(F.lit(0), F.lit(n - 1))), start, step, lambda state: state["combo"])


def fixed_total_compositions(requests: DataFrame, n: int, limit: str, total: str) -> DataFrame:
    """All n-tuples of 0..limit with a given sum, numbered (``ord``) with the first digit fastest.

    requests(panel_id, limit, total). Prefixes that cannot reach the sum are cut. A number is
    worked out on its own row, so the tuples of a panel are never sorted.
    """
    rows = with_ways(requests, n, limit, total).withColumn("combo", F.array().cast("array<int>"))
    for k in range(n):
        reached = F.aggregate("combo", F.lit(0), lambda a, x: a + x) + F.col("s")
        rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.col(limit)))).where(
            (reached <= F.col(total)) & (reached + (n - k - 1) * F.col(limit) >= F.col(total))
        )
        rows = rows.withColumn("combo", F.concat("combo", F.array("s"))).drop("s")
    return rows.withColumn("ord", rank_of(F.col("ways"), F.col("combo"), F.col(total)).cast("int")).drop("ways")


def compositions_at(requests: DataFrame, n: int, limit: str, total: str, parts: int) -> DataFrame:
    """The tuple that each of ``parts`` nearly equal ranges of a panel's tuples begins with, and the range's size.

    Made from their numbers; no other tuple is.
    """
    sized = with_ways(requests, n, limit, total).withColumn("size", F.get(F.get("ways", F.lit(n)), F.col(total)))
    part = F.col("part")
    ranges = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumns(
        {"first": F.floor(part * F.col("size") / parts), "next": F.floor((part + 1) * F.col("size") / parts)}
    )
    wanted = ranges.withColumn("range_size", (F.col("next") - F.col("first")).cast("int")).where("range_size > 0")
    combo = composition_at(F.col("ways"), F.col("first"), n, F.col(limit), F.col(total))
    return wanted.select("panel_id", "part", "range_size", combo.alias("combo"))


def drawn_compositions(rows: DataFrame, n: int, limit: int, draws: int, seed: str) -> DataFrame:
    """``draws`` compositions of 0..limit for each row(panel_id, total), every one with equal chance.

    The number of a draw is 60 bits of a keyed hash, so it is the same on any cluster; totals
    that no composition has are left out. Adds ``draw`` and ``combo``.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), *(F.col(x).cast("string") for x in ("panel_id", "total", "draw"))))
    number = F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")
    counted = with_ways(rows.where(F.col("total").between(0, n * limit)).withColumn("spacer_limit", F.lit(limit)), n, "spacer_limit", "total")
    size = F.get(F.get("ways", F.lit(n)), F.col("total"))
    drawn = counted.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("rank", number % size)
    combo = composition_at(F.col("ways"), F.col("rank"), n, F.col("spacer_limit"), F.col("total"))
    return drawn.withColumn("combo", combo).drop("ways", "spacer_limit", "rank")


def sampled_search(panels: DataFrame, width: int, limit: int, draws: int, seed: str) -> DataFrame:
    """Best of ``draws`` random combos of every total, for panels(panel_id, seqs) too large to search.

    panel_id, combo, total, score: the most diverse worst column, then the smallest total,
    then the least reversed digits.
    """

    def of_size(sized: DataFrame, n: int) -> DataFrame:
        totals = sized.withColumn("total", F.explode(F.sequence(F.lit(0), F.lit(n * limit))))
        drawn = drawn_compositions(totals, n, limit, draws, seed)
        return drawn.withColumn("score", M.min_diversity(F.col("seqs"), F.col("combo"), F.lit(width))).select("panel_id", "combo", "total", "score")

    best = F.min(F.struct((-F.col("score")).alias("lead"), "total", F.reverse("combo").alias("rev"), "combo")).alias("b")
    return M.by_panel_size(panels, of_size).groupBy("panel_id").agg(best).select(
        "panel_id", F.col("b.combo").alias("combo"), F.col("b.total").alias("total"), (-F.col("b.lead")).alias("score")
    )
