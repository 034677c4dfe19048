"""Spacers and primer pools for N different sequences amplified together."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoweave.functions import constants as C
from oligoweave.functions import sequence as S
from oligoweave.operators.ranking import mean_of_lowest
from oligoweave.session import cut_lineage


def _poured(unassigned: Column, counts: Column) -> Column:
    """Counts after giving each unassigned copy to the scarcest base (ascending order)."""
    def pour(sorted_counts: Column, _: Column) -> Column:
        first = F.get(sorted_counts, F.lit(0)) + 1
        return F.array_sort(F.concat(F.array(first), F.slice(sorted_counts, F.lit(2), F.lit(3))))

    start = F.array_sort(counts)
    return F.when(
        unassigned > 0, F.aggregate(F.sequence(F.lit(1), unassigned), start, pour)
    ).otherwise(start)


def column_diversity(unassigned: Column, counts: Column) -> Column:
    """Product of the four base percentages, each at least 1, after pouring.

    Rounded to six places before cutting, so float noise cannot cross a whole number.
    """
    total = unassigned + F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def product(v: Column) -> Column:
        return F.aggregate(
            v["poured"], F.lit(1.0),
            lambda a, x: a * F.greatest(x / v["total"] * 100, F.lit(1.0)),
        )

    bound = F.struct(_poured(unassigned, counts).alias("poured"), total.alias("total"))
    return F.floor(F.round(S.let(bound, product), 6)).cast("bigint")


def max_diversity(n: Column) -> Column:
    """Best score any column of n copies can reach."""
    return column_diversity(n.cast("bigint"), F.array_repeat(F.lit(0).cast("bigint"), 4))


def min_diversity(seqs: Column, spacers: Column, n_hetero: Column) -> Column:
    """Lowest column diversity over the first columns of the shifted sequences."""
    n = F.size(seqs)
    rows = F.arrays_zip(seqs.alias("q"), spacers.alias("s"))

    def column_score(col: Column) -> Column:
        bases = F.transform(
            rows, lambda r: F.when(col < r["s"], "-").otherwise(F.substring(r["q"], col - r["s"] + 1, F.lit(1)))
        )

        def score(b: Column) -> Column:
            def count(base: str) -> Column:
                return F.size(F.filter(b, lambda x: x == base)).cast("bigint")

            return column_diversity(count("-"), F.array(*[count(x) for x in C.BASES]))

        return S.let(bases, score)

    scores = F.transform(F.sequence(F.lit(0), n_hetero - 1), column_score)
    return F.least(F.array_min(scores), F.lit(25**4).cast("bigint"))


def panel_rows(seqs: DataFrame, value: str) -> DataFrame:
    """One row per panel with its sequences in order (a panel is what one tube holds)."""
    ordered = F.array_sort(F.collect_list(F.struct("i", value)))
    return seqs.groupBy("panel_id").agg(F.transform(ordered, lambda x: x[value]).alias("seqs"))


# --- enumeration --------------------------------------------------------------------


def _grow(df: DataFrame, n: int, limit: Column, keep) -> DataFrame:
    """Append spacers one sequence at a time to ``combo``, pruning after each step.

    After the second step rows are spread anew, so one panel's search tree becomes many
    tasks.
    """
    df = df.withColumn("combo", F.array().cast("array<int>"))
    for k in range(n):
        df = df.withColumn("s", F.explode(F.sequence(F.lit(0), limit)))
        df = df.where(keep(k)).withColumn("combo", F.concat("combo", F.array("s"))).drop("s")
        if k == 1 and n > 3:
            df = df.repartition("panel_id", "combo")
    return df


def all_spacer_vectors(panels: DataFrame, n: int, limit: int) -> DataFrame:
    """All (limit + 1)^n tuples, least significant digit first."""
    grown = _grow(panels, n, F.lit(limit), lambda k: F.lit(True))
    base = limit + 1
    number = F.aggregate(
        F.reverse("combo"), F.lit(0).cast("bigint"), lambda a, x: a * base + x
    )
    return grown.withColumn("ord", number)


def count_compositions(n: Column, limit: Column, total: Column) -> Column:
    """How many n-tuples of 0..limit have a given sum, by n convolution steps."""
    sums = F.sequence(F.lit(0), total)
    start = F.transform(sums, lambda t: F.when(t == 0, 1).otherwise(0).cast("bigint"))

    def step(ways: Column, _: Column) -> Column:
        def reach(t: Column) -> Column:
            first = F.greatest(t - limit, F.lit(0))
            return F.aggregate(
                F.slice(ways, first + 1, t - first + 1), F.lit(0).cast("bigint"), lambda a, x: a + x
            )

        return F.transform(sums, reach)

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, step), -1)


# --- panels of several sizes ----------------------------------------------------------


def by_panel_size(panels: DataFrame, search: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``search(panels of n sequences, n)`` for every panel size there is; the sizes are few."""
    panels = cut_lineage(panels)
    sizes = sorted(r[0] for r in panels.select(F.size("seqs")).distinct().collect())
    with ThreadPoolExecutor(4) as pool:  # a search may run jobs of its own; the sizes run side by side
        found = pool.map(lambda n: search(panels.where(F.size("seqs") == n), n), sizes or [1])
        return reduce(DataFrame.unionByName, found)


# --- pools --------------------------------------------------------------------------


def hetero_alignment(rows: DataFrame) -> DataFrame:
    """Shifted alignment cut at the panel's longest spacer; vacant cells are '-'.

    rows(panel_id, i, seq, spacer)
    """
    width = rows.groupBy("panel_id").agg(F.max("spacer").alias("width"))
    base = F.substring("seq", F.col("col") - F.col("spacer") + 1, F.lit(1))
    return (
        rows.join(width, "panel_id")
        .where("width > 0")
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        .select("panel_id", "i", "col", F.when(F.col("col") < F.col("spacer"), "-").otherwise(base).alias("base"))
    )


def column_base_quota(cells: DataFrame) -> DataFrame:
    """ceil(N / 4) minus what is present, per base; below zero the column cannot balance."""
    counts = cells.groupBy("panel_id", "col").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("base") == "-").alias("vacant"),
        *[F.count_if(F.col("base") == b).alias(b) for b in C.BASES],
    )
    quota = F.ceil(F.col("n") / 4)
    rows = F.array(
        *[F.struct(F.lit(b).alias("base"), (quota - F.col(b)).cast("bigint").alias("quota")) for b in C.BASES]
    )
    return counts.select("panel_id", "col", "vacant", F.explode(rows).alias("x")).select(
        "panel_id", "col", "vacant", "x.base", "x.quota", (F.col("x.quota") < 0).alias("overfull")
    )


def random_balanced_spacers(panels: DataFrame, n_pools: int, seed: str) -> DataFrame:
    """Seeded spacers per panel and pool, (panel_id, pool, i, spacer).

    panels(panel_id, seqs, spacers). In each column the vacant copies, in hash order, take
    the scarcest base, equal ones by hash: the column ends as even as it can be.
    """
    pools = panels.withColumn("pool", F.explode(F.sequence(F.lit(0), F.lit(n_pools - 1))))
    tag = F.concat_ws(":", F.lit(seed), F.col("panel_id").cast("string"), F.col("pool").cast("string"))
    rows = F.arrays_zip(F.col("seqs").alias("q"), F.col("spacers").alias("s"))

    def draw(*parts: Column) -> Column:
        return F.md5(F.concat_ws(":", tag, *[p.cast("string") for p in parts]))

    def fill_column(filled: Column, col: Column) -> Column:
        cells = F.transform(
            rows,
            lambda r, i: F.struct(
                draw(col, i).alias("h"), i.alias("i"), (col < r["s"]).alias("vacant"),
                F.substring(r["q"], col - r["s"] + 1, F.lit(1)).alias("base"),
            ),
        )

        def fill(c: Column) -> Column:
            counts = F.transform(
                F.array(*[F.lit(b) for b in C.BASES]),
                lambda b: F.struct(
                    b.alias("b"), F.size(F.filter(c, lambda x: ~x["vacant"] & (x["base"] == b))).alias("n")
                ),
            )

            def place(state: Column, cell: Column) -> Column:
                scarcest = F.array_min(
                    F.transform(
                        state["counts"],
                        lambda x: F.struct(x["n"].alias("n"), draw(col, cell["i"], x["b"]).alias("h"), x["b"].alias("b")),
                    )
                )["b"]
                return S.let(
                    scarcest,
                    lambda base: F.struct(
                        F.transform(
                            state["rows"], lambda r, i: F.when(i == cell["i"], F.concat(r, base)).otherwise(r)
                        ).alias("rows"),
                        F.transform(
                            state["counts"],
                            lambda x: F.struct(x["b"].alias("b"), (x["n"] + F.when(x["b"] == base, 1).otherwise(0)).alias("n")),
                        ).alias("counts"),
                    ),
                )

            vacant = F.array_sort(F.filter(c, lambda x: x["vacant"]))
            return F.aggregate(
                vacant, F.struct(filled.alias("rows"), counts.alias("counts")), place, lambda s: s["rows"]
            )

        return S.let(cells, fill)

    empty = F.transform("seqs", lambda _: F.lit(""))
    width = F.array_max("spacers")
    done = F.when(width > 0, F.aggregate(F.sequence(F.lit(0), width - 1), empty, fill_column)).otherwise(empty)
    return pools.select("panel_id", "pool", F.posexplode(done).alias("i", "spacer"))


def assemble_pool(parts: DataFrame, spacers: DataFrame, keys: list[str]) -> DataFrame:
    """Forward and reverse primers of every pool from adapters, spacers and bindings.

    parts(panel_id, i, f_adapt, r_adapt, f_bind, r_bind); spacers(keys, i, f_spacer, r_spacer).
    Inner join on (panel, i): a locus without spacers makes no primer, see missing_parts.
    """
    return spacers.join(parts, ["panel_id", "i"]).select(
        *keys, "i",
        S.assemble_primer("f_adapt", F.lit(""), "f_spacer", "f_bind").alias("f_primer"),
        S.assemble_primer("r_adapt", F.lit(""), "r_spacer", "r_bind").alias("r_primer"),
    )


def missing_parts(parts: DataFrame, spacers: DataFrame) -> DataFrame:
    return parts.join(spacers, ["panel_id", "i"], "left_anti")


def pool_oligos(pool: DataFrame, keys: list[str]) -> DataFrame:
    """All primers of a pool in one numbered list: forward ones first."""
    size = pool.groupBy(*keys).agg((F.max("i") + 1).alias("n_loci"))
    forward = pool.select(*keys, F.col("i").alias("idx"), F.col("f_primer").alias("primer"))
    reverse = pool.join(size, keys).select(
        *keys, (F.col("i") + F.col("n_loci")).alias("idx"), F.col("r_primer").alias("primer")
    )
    return forward.unionByName(reverse)


#: Primers of a pool in a tile: a pair of tiles is one row of work.
TILE = 256


def tiled(oligos: DataFrame, keys: list[str], encoded: Column, size: int = TILE) -> DataFrame:
    """Primers of a pool packed ``size`` to a row: keys, tile, members (idx, e)."""
    tile = F.floor(F.col("idx") / size).cast("int").alias("tile")
    rows = oligos.select(*keys, tile, F.struct("idx", encoded.alias("e")).alias("x"))
    return rows.groupBy(*keys, "tile").agg(F.collect_list("x").alias("members"))


def all_pairs_energy(oligos: DataFrame, keys: list[str], size: int = TILE) -> DataFrame:
    """Energy of every unordered pair of a pool, self pairs included.

    Primers are encoded once and packed in tiles; a tile travels once for each tile that it
    meets, not once for each primer. Pairs of tiles meet in an equi-join on (pool, tile) and
    are opened where they are scored, so one large pool is spread over all tasks.
    """
    tiles = cut_lineage(tiled(oligos, keys, S.encode_energy("primer"), size))
    last = tiles.groupBy(*keys).agg(F.max("tile").alias("last"))
    left = tiles.select(*keys, F.col("tile").alias("first"), F.col("members").alias("a")).join(last, keys).withColumn(
        "tile", F.explode(F.sequence("first", "last"))
    )
    pairs = left.join(tiles, [*keys, "tile"])
    opened = pairs.select(*keys, F.explode("a").alias("a"), "members").select(*keys, "a", F.explode("members").alias("b")).where("a.idx <= b.idx")
    return opened.select(*keys, F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), S.dimer_energy_encoded("a.e", "b.e").alias("energy"))


def pool_score(energies: DataFrame, keys: list[str], loci: DataFrame) -> DataFrame:
    """Mean of the k lowest energies of a pool, k being half the square of its loci (0: all).

    loci(keys, n_loci)
    """
    sizes = loci.withColumn("k", F.floor(F.col("n_loci") * F.col("n_loci") / 2))
    return mean_of_lowest(energies, keys, "energy", sizes, "k").select(*keys, F.round("mean", 9).alias("score"))


def best_pool(scores: DataFrame) -> DataFrame:
    """Pool with the highest (least stable) score per panel; the first on a tie."""
    best = F.max(F.struct("score", (-F.col("pool")).alias("p"))).alias("b")
    return scores.groupBy("panel_id").agg(best).select(
        "panel_id", (-F.col("b.p")).alias("pool"), F.col("b.score").alias("score")
    )
