"""Heterogeneity spacers for four copies of one binding sequence.

Combos, fillings and their checks live on one row per sequence or set: nothing is
shuffled until sets are compared or ranked.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.functions import constants as C
from oligoweave.functions import dimensions as D
from oligoweave.functions import sequence as S
from oligoweave.operators.ranking import lowest_by_counts, top_n
from oligoweave.session import cut_lineage, scratch_path, spread

COMBO = ["s1", "s2", "s3", "s4"]


# --- lengths ------------------------------------------------------------------------


def with_lag_runs(seqs: DataFrame, max_spacer: int, columns: int) -> DataFrame:
    """``clear``: per shift difference d, how many of the leading ``columns`` never clash.

    Column p clashes when base p equals base p + d (ignored bases never do) or when the
    sequence is too short to tell.
    """
    seq = S.mask_degenerate("seq")

    def first_clash(s: Column, d: Column) -> Column:
        def clashes(p: Column) -> Column:
            here, there = F.substring(s, p + 1, F.lit(1)), F.substring(s, p + d + 1, F.lit(1))
            return (p + d >= F.length(s)) | ((here == there) & (here != "I"))

        asked = F.least(F.length(s), F.lit(columns))
        positions = F.filter(F.sequence(F.lit(0), asked), clashes)
        return F.coalesce(F.array_min(positions), asked)

    runs = S.let(
        seq,
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(max_spacer)), lambda d: first_clash(s, d)
        ),
    )
    return seqs.withColumn("clear", runs)


def _fits(clear: Column, a: Column, b: Column, n_hetero: int) -> Column:
    return F.get(clear, b - a) >= n_hetero - b


def compatible_shift_edges(seqs: DataFrame, n_hetero: int, max_spacer: int) -> DataFrame:
    """Shifts a <= b whose copies differ in every one of the first n_hetero columns."""
    lags = with_lag_runs(seqs, max_spacer, n_hetero)
    return (
        lags.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(max_spacer))))
        .withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(max_spacer))))
        .where(_fits(F.col("clear"), F.col("a"), F.col("b"), n_hetero))
        .drop("clear")
    )


def spacer_length_combos(seqs: DataFrame, n_hetero: int, max_spacer: int, keep: int | None = None) -> DataFrame:
    """All non-decreasing four-tuples of pairwise compatible shifts, or each row's ``keep`` best ones.

    A four-clique grown one shift at a time on the sequence's own row; each step keeps
    only shifts that fit all shifts before it. What is not kept never leaves its row.
    """
    shifts = F.sequence(F.lit(0), F.lit(max_spacer))

    def listed(combo: list[Column]) -> Column:
        lead = [_combo_score(combo).alias("combo_score")] if keep else []  # the order in which combos are ranked
        return F.struct(*lead, *(s.alias(c) for s, c in zip(combo, COMBO, strict=True)))

    def grown(prefix: list[Column], options: Column, fitting: Column) -> Column:
        if len(prefix) == len(COMBO) - 1:
            return F.transform(options, lambda b: listed([*prefix, b]))

        def longer(b: Column) -> Column:
            after = F.get(fitting, b)
            return S.let(F.array_intersect(options, after) if prefix else after, lambda x: grown([*prefix, b], x, fitting))

        return F.flatten(F.transform(options, longer))

    # bound to variables: a column named inside a function is worked out anew for every element
    combos = S.let(
        F.col("clear"),
        lambda clear: S.let(
            F.transform(shifts, lambda a: F.filter(F.sequence(a, F.lit(max_spacer)), lambda b: _fits(clear, a, b, n_hetero))),
            lambda fitting: grown([], shifts, fitting),
        ),
    )
    if keep:
        combos = F.slice(F.array_sort(combos), 1, keep)
    # the outer form: the plain one works the list out once more, to see whether it is empty
    return with_lag_runs(seqs, max_spacer, n_hetero).withColumn("combo", F.explode_outer(combos)).where("combo is not null").select(
        *seqs.columns, *(F.col(f"combo.{c}").alias(c) for c in COMBO)
    )


def _combo_score(combo: list[Column]) -> Column:
    total = reduce(Column.__add__, combo)
    repeats = 4 - F.size(F.array_distinct(F.array(*combo)))
    return (
        (F.greatest(*combo) * C.COMBO_MAX_WEIGHT)
        * (total * C.COMBO_SUM_WEIGHT)
        * (repeats * C.COMBO_DISTINCT_WEIGHT)
    )


def rank_spacer_combos(combos: DataFrame, keep: int | None = None) -> DataFrame:
    """Combos by ascending score, then by their lengths."""
    scored = combos.withColumn("combo_score", _combo_score([F.col(c) for c in COMBO]))
    order = [F.col("combo_score"), *[F.col(c) for c in COMBO]]
    if keep:
        return top_n(scored, ["seq_id"], order, keep, "rank")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("seq_id").orderBy(*order)))


def best_combo(combos: DataFrame) -> DataFrame:
    return rank_spacer_combos(combos, 1)


# --- fillings -----------------------------------------------------------------------


def vacant_columns(combos: DataFrame, keys: list[str]) -> DataFrame:
    """Copies (0-3) that have no base of their own in a column."""
    copies = combos.select(*keys, F.posexplode(F.array(*COMBO)).alias("k", "spacer"))
    return (
        copies.where("spacer > 0")
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("spacer") - 1)))
        .select(*keys, "col", "k")
    )


def _free_bases(seq: Column, col: Column) -> Column:
    """Bases no occupied copy holds in a column, in the order A, T, C, G."""
    def taken(base: Column) -> Column:
        return F.exists(
            F.array(*COMBO),
            lambda s: (s <= col) & (F.substring(seq, col - s + 1, F.lit(1)) == base),
        )

    return F.filter(F.array(*[F.lit(b) for b in C.BASES]), lambda b: ~taken(b))


def allowed_column_bases(combos: DataFrame, keys: list[str]) -> DataFrame:
    """Bases still free in each spacer column of a combo."""
    masked = combos.withColumn("masked", S.mask_degenerate("seq")).where(F.col("s4") > 0)
    return (
        masked.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("s4") - 1)))
        .withColumn("base", F.explode(_free_bases(F.col("masked"), F.col("col"))))
        .select(*keys, "col", "base")
    )


def random_spacer_sets(combos: DataFrame, n_sets: int | Column, seed: str) -> DataFrame:
    """n seeded fillings per combo: (.., set_id, k, spacer); n may be a column.

    Columns are filled right to left. In a column every copy gets another base; a copy
    avoids the base to its right where it has a choice. Order and choice come from a
    keyed hash, so the same seed gives the same sets on any cluster.
    """
    # combos are few bytes that a shuffle before would hand to few tasks; the fillings are all the work
    sets = spread(combos).withColumn("masked", S.mask_degenerate("seq")).withColumn(
        "set_id", F.explode(F.sequence(F.lit(0), (n_sets if isinstance(n_sets, Column) else F.lit(n_sets)).cast("int") - 1))
    )
    written = F.concat_ws(":", F.lit(seed), F.col("seq_id").cast("string"), F.col("set_id").cast("string"),
                          *[F.col(c).cast("string") for c in COMBO])

    def fill_column(tag: Column, rows: Column, col: Column) -> Column:
        def draw(*parts: Column) -> Column:
            return F.md5(F.concat_ws(":", tag, *[p.cast("string") for p in parts]))

        # only vacant copies are drawn for, and a base only where there is a choice
        vacant = F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(F.array(*COMBO), k) > col),
            lambda k: F.struct(draw(col, k).alias("h"), k.alias("k")),
        )

        def fill_copy(state: Column, copy: Column) -> Column:
            k = copy["k"]
            right = F.coalesce(
                F.nullif(F.left(F.get(state["rows"], k), F.lit(1)), F.lit("")),
                F.left(F.col("masked"), F.lit(1)),
            )
            others = F.filter(state["free"], lambda b: b != right)

            def drawn(options: Column) -> Column:
                keyed = F.transform(options, lambda b: F.struct(draw(col, k, b).alias("h"), b.alias("b")))
                return F.when(F.size(options) == 1, F.get(options, F.lit(0))).otherwise(F.array_min(keyed)["b"])

            chosen = S.let(others, lambda o: S.let(F.when(F.size(o) > 0, o).otherwise(state["free"]), drawn))
            return S.let(
                F.coalesce(chosen, F.lit("")),
                lambda base: F.struct(
                    F.transform(
                        state["rows"], lambda r, i: F.when(i == k, F.concat(base, r)).otherwise(r)
                    ).alias("rows"),
                    F.filter(state["free"], lambda b: b != base).alias("free"),
                ),
            )

        start = F.struct(rows.alias("rows"), _free_bases(F.col("masked"), col).alias("free"))
        return F.aggregate(F.array_sort(vacant), start, fill_copy, lambda s: s["rows"])

    empty = F.array_repeat(F.lit(""), 4)
    filled = F.when(
        F.col("s4") > 0,
        S.let(
            written,
            lambda tag: F.aggregate(
                F.sequence(F.col("s4") - 1, F.lit(0), F.lit(-1)), empty, lambda rows, col: fill_column(tag, rows, col)
            ),
        ),
    ).otherwise(empty)
    # the outer form: the plain one fills every set once more, to see whether it is empty
    return sets.withColumn("rows", filled).select(
        *combos.columns, "set_id", F.posexplode_outer("rows").alias("k", "spacer")
    )


def random_spacer_invariants(filled: DataFrame, keys: list[str], n_hetero: int) -> DataFrame:
    """Per set and column: copies present and distinct known bases among them."""
    spacer_len = F.get(F.array(*COMBO), F.col("k"))
    whole = F.concat(F.col("spacer"), S.mask_degenerate("seq"))
    cells = (
        filled.withColumn("whole", whole)
        .withColumn("fits", F.length("spacer") == spacer_len)
        .where(F.col("s4") > 0)
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("s4") - 1)))
        .withColumn("base", F.substring("whole", F.col("col") + 1, F.lit(1)))
    )
    known = F.when((F.col("base") != "I") & (F.col("base") != ""), F.col("base"))
    return cells.groupBy(*keys, "set_id", "col").agg(
        F.every(F.col("fits")).alias("fits"),
        (F.count(known) - F.count_distinct(known)).alias("repeats"),
    )


def spacer_space_size() -> Column:
    """Number of fillings of a combo."""
    return (
        F.pow(F.lit(24.0), F.col("s1"))
        * F.pow(F.lit(6.0), F.col("s2") - F.col("s1"))
        * F.pow(F.lit(2.0), F.col("s3") - F.col("s2"))
    )


def spacer_space_by_gc(seqs: DataFrame, n_hetero: int, max_spacer: int, bands: int = 10) -> DataFrame:
    """Mean and deviation of the filling count of each sequence's best combo, per GC band."""
    best = best_combo(spacer_length_combos(seqs, n_hetero, max_spacer, 1))
    return (
        best.select(S.gc_band("seq", bands).alias("band"), spacer_space_size().alias("space"))
        .groupBy("band")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("space").alias("mean_space"), F.stddev_samp("space").alias("sd_space"))
    )


# --- scores -------------------------------------------------------------------------

OVERLAP_CRITERIA = {"run": C.RUN_WEIGHT, "total": C.TOTAL_WEIGHT}
PAIR_ENERGY_CRITERIA = {"heterodimer": C.HETERODIMER_WEIGHT}
ENERGY_CRITERIA = {"hairpin": C.HAIRPIN_WEIGHT, "homodimer": C.HOMODIMER_WEIGHT}


#: Sets of a locus in a tile.
SET_TILE = 16


def tile_pairs(left: DataFrame, right: DataFrame, keys: list[str], size: int = SET_TILE) -> DataFrame:
    """Every row of `left` with every row of `right` of equal keys, told apart by ``set_no``: structs ``f`` and ``r``.

    Rows are packed in tiles of ``size`` sets. A forward tile travels once for each reverse
    tile and meets it in an equi-join, so the sets of one locus are spread over all tasks.
    """

    def tiles(rows: DataFrame, name: str) -> DataFrame:
        packed = F.collect_list(F.struct(*(x for x in rows.columns if x not in keys))).alias(name)
        return rows.groupBy(*keys, F.floor(F.col("set_no") / size).cast("int").alias("tile")).agg(packed)

    reverse = tiles(right, "rs")
    numbers = right.select(*keys, F.floor(F.col("set_no") / size).cast("int").alias("tile")).distinct()
    forward = tiles(left, "fs").withColumnRenamed("tile", "f_tile").join(numbers, keys)
    met = forward.join(reverse, [*keys, "tile"])
    return met.select(*keys, F.explode("fs").alias("f"), "rs").select(*keys, "f", F.explode("rs").alias("r"))


def complete_primers(sets: DataFrame) -> DataFrame:
    """Adds the assembled primer, its part lengths and its encoded form."""
    primer = S.assemble_primer("adapter", "index_seq", "spacer", "binding")
    return sets.withColumns(
        {
            "primer": primer,
            "five_p_len": F.length(F.concat("adapter", "index_seq")),
            "three_p_len": F.length("binding"),
        }
    )


def _criteria_rows(df: DataFrame, keep: list[str], scores: dict[str, Column], weights: dict[str, int]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("criterion"), F.lit(weights[name]).alias("weight"), value.cast("bigint").alias("score"))
            for name, value in scores.items()
        ]
    )
    return df.select(*keep, F.explode(rows).alias("c")).select(*keep, "c.*")


def self_dimer_scores(primers: DataFrame, keys: list[str], by_energy: bool = False) -> DataFrame:
    """Criterion scores of each primer against itself.

    By overlap: alignments that involve only the ends outside the spacer are skipped. By
    energy: for panels in which every primer is shorter than the solver limit.
    """
    if by_energy:
        scored = primers.withColumn("e", S.encode_energy("primer"))
        values = {
            "hairpin": S.energy_as_int(S.hairpin_energy_encoded("e")),
            "homodimer": S.energy_as_int(S.dimer_energy_encoded("e", "e")),
        }
        return _criteria_rows(scored, keys, values, ENERGY_CRITERIA)
    skip = F.least("five_p_len", "three_p_len")
    scored = primers.withColumn("e", S.encode_overlap("primer")).withColumn(
        "o", S.overlap_scores("e", "e", skip, skip)
    )
    return _criteria_rows(scored, keys, {"run": F.col("o.run"), "total": F.col("o.total")}, OVERLAP_CRITERIA)


def pair_dimer_scores(primers: DataFrame, keys: list[str], by_energy: bool = False) -> DataFrame:
    """Criterion scores of every forward with every reverse primer of a locus.

    By overlap, or by the energy of the duplex for loci whose primers are all shorter than the
    solver limit. Oligos are encoded once, before the join. A locus has (sets x 4) primers per
    side, a number set by the sampling budget.
    """
    coded = primers.withColumn("e", S.encode_energy("primer") if by_energy else S.encode_overlap("primer"))

    def side(direction: str) -> DataFrame:
        return coded.where(F.col("dir") == direction).select(*keys, "set_no", "k", "e", "five_p_len", "three_p_len")

    pairs = tile_pairs(side("F"), side("R"), keys).select(
        *keys, *(F.col(f"{p}.{x}").alias(f"{p}_{y}") for p in "fr" for x, y in (("set_no", "set"), ("k", "k"))), "f", "r"
    )
    found = [*keys, "f_set", "f_k", "r_set", "r_k"]
    if by_energy:
        return _criteria_rows(pairs, found, {"heterodimer": S.energy_as_int(S.dimer_energy_encoded("f.e", "r.e"))}, PAIR_ENERGY_CRITERIA)
    scored = pairs.withColumn(
        "o",
        S.overlap_scores("f.e", "r.e", F.least("f.five_p_len", "r.five_p_len"), F.least("f.three_p_len", "r.three_p_len")),
    )
    return _criteria_rows(scored, found, {"run": F.col("o.run"), "total": F.col("o.total")}, OVERLAP_CRITERIA)


def inherent_dimer_scores(loci: DataFrame, keys: list[str]) -> DataFrame:
    """Best overlap between the fixed parts of a forward and a reverse primer.

    loci carry f_five, f_three, r_five, r_three.
    """
    oligos = F.transform(F.array("f_five", "f_three", "r_five", "r_three"), S.encode_overlap)

    def pairings(v: Column) -> Column:
        return F.array(
            *[
                F.struct(F.get(v, F.lit(i)).alias("a"), F.get(v, F.lit(j)).alias("b"))
                for i in (0, 1)
                for j in (2, 3)
            ]
        )

    scores = F.transform(S.let(oligos, pairings), lambda p: S.overlap_scores(p["a"], p["b"]))
    return loci.withColumn("o", scores).select(
        *keys,
        F.array_max(F.transform("o", lambda x: x["run"])).alias("run"),
        F.array_max(F.transform("o", lambda x: x["total"])).alias("total"),
    )


def variance_penalised(score: str) -> Column:
    """Mean plus a third of the sample deviation, cut to a whole number (an aggregate).

    Scores are whole numbers, so sums of squares are exact in any order.
    """
    n, total = F.count(score), F.sum(score)
    squares = F.sum(F.col(score) * F.col(score))
    variance = F.when(n > 1, (n * squares - total * total) / (n * (n - 1)))
    return (total / n + F.sqrt(variance) / C.VARIANCE_DIVISOR).cast("bigint")


def score_spacer_sets(criteria: DataFrame, keys: list[str]) -> DataFrame:
    """One plus the weighted criterion scores of each set."""
    per_criterion = criteria.groupBy(*keys, "criterion", "weight").agg(variance_penalised("score").alias("s"))
    return per_criterion.groupBy(*keys).agg((1 + F.sum(F.col("weight") * F.col("s"))).alias("set_score"))


def trim_spacer_sets(scored: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best sets of each direction."""
    return top_n(scored, [*keys, "dir"], [F.col("set_score"), F.col("set_no")], n)


#: The pairings of four forward with four reverse primers, in lexicographic order.
PAIRINGS = list(permutations(range(4)))


def penalised_of_four(scores: list[Column]) -> Column:
    """``variance_penalised`` of the scores of four primer pairs that stand on one row."""
    total = reduce(Column.__add__, scores)
    squares = reduce(Column.__add__, [x * x for x in scores])
    variance = (4 * squares - total * total) / F.lit(4 * 3)
    return (total / F.lit(4) + F.sqrt(variance) / C.VARIANCE_DIVISOR).cast("bigint")


def scores_of_pairings(cells: list[Column], weights: list[int | Column]) -> Column:
    """Scores of the 24 pairings; a cell is an array of 16 scores of one criterion, the reverse primer running faster."""

    def score(pairing: Column) -> Column:
        parts = [
            weight * penalised_of_four([F.get(cell, F.get(pairing, F.lit(f)) + 4 * f) for f in range(4)])
            for cell, weight in zip(cells, weights, strict=True)
        ]
        return reduce(Column.__add__, parts)

    return F.transform(F.array(*(F.array(*map(F.lit, pairing)) for pairing in PAIRINGS)), score)


def pairing_scores(pair_criteria: DataFrame, keys: list[str]) -> DataFrame:
    """Score of each of the 24 pairings of every forward and reverse set.

    The 16 scores of two sets and a criterion meet in an array; the pairings are expressions
    over it, and their weighted scores are added up over the criteria.
    """
    sets = [*keys, "f_set", "r_set"]
    cell = F.array_sort(F.collect_list(F.struct("f_k", "r_k", "score")))
    per_criterion = pair_criteria.groupBy(*sets, "criterion", "weight").agg(F.transform(cell, lambda x: x["score"]).alias("cell"))
    scored = per_criterion.select(*sets, scores_of_pairings([F.col("cell")], [F.col("weight")]).alias("scores"))
    summed = scored.groupBy(*sets).agg(*(F.sum(F.get("scores", F.lit(i))).alias(f"p{i}") for i in range(len(PAIRINGS))))
    return summed.select(*sets, F.posexplode(F.array(*(F.col(f"p{i}") for i in range(len(PAIRINGS))))).alias("perm_id", "score"))


def best_pairing(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest pairing score of two sets; equal scores resolve to the last pairing."""
    best = F.min(F.struct("score", (-F.col("perm_id")).alias("p"))).alias("b")
    return scores.groupBy(*keys, "f_set", "r_set").agg(best).select(
        *keys, "f_set", "r_set", (-F.col("b.p")).alias("perm_id"), F.col("b.score").alias("score")
    )


def halfset_averages(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of every row (forward) and column (reverse) of the matrix."""
    sides = matrix.withColumn(
        "x", F.explode(F.array(
            F.struct(F.lit("F").alias("dir"), F.col("f").alias("idx")),
            F.struct(F.lit("R").alias("dir"), F.col("r").alias("idx")),
        ))
    )
    return sides.groupBy(*keys, "x.dir", "x.idx").agg(F.avg("score").alias("mean_score"))


def successive_elimination(
    matrix: DataFrame, keys: list[str], n: int, first: int, every: int, rounds: int
) -> DataFrame:
    """Cells still in play after the given rounds.

    In round i the cells with (r - f) mod n = i are scored; from round ``first`` on, every
    ``every`` rounds, the row and the column with the highest mean so far drop out. Each
    elimination is one aggregate over all matrices at once; dropped rows and columns are
    two values per matrix. What was scored since the last elimination is added to one table,
    and the survivors are written out after each, so the plan does not grow with the rounds.
    """
    alive = cut_lineage(matrix.withColumn("visit", D.latin_round("f", "r", n)))
    path, start = scratch_path(matrix.sparkSession, "played"), 0
    for i in range(first, rounds, every):
        alive.where((F.col("visit") >= start) & (F.col("visit") < i)).write.mode("append").parquet(path)
        start = i
        means = halfset_averages(matrix.sparkSession.read.schema(alive.schema).parquet(path), keys)
        active = alive.select(*keys, F.lit("F").alias("dir"), F.col("f").alias("idx")).unionByName(
            alive.select(*keys, F.lit("R").alias("dir"), F.col("r").alias("idx"))
        ).distinct()
        worst = cut_lineage(
            means.join(active, [*keys, "dir", "idx"], "left_semi").groupBy(*keys, "dir").agg(
                F.min_by("idx", F.struct(-F.round("mean_score", 9), "idx")).alias("out")
            )
        )
        for direction, column in (("F", "f"), ("R", "r")):
            gone = worst.where(F.col("dir") == direction).select(*keys, F.col("out").alias(column))
            alive = alive.join(gone, [*keys, column], "left_anti")
        alive = cut_lineage(alive)
    return alive


def score_matrix_pivot(matrix: DataFrame, keys: list[str], forward: list[int]) -> DataFrame:
    """One row per reverse set, one column per forward set, and the row mean."""
    return matrix.groupBy(*keys, "r").agg(
        F.avg("score").alias("mean_score"),
        *[F.max(F.when(F.col("f") == f, F.col("score"))).alias(f"f{f}") for f in forward],
    )


def filter_summary(set_scores: DataFrame, pair_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes, averages, minima and the best pair of sets with its parts, per locus."""
    single = set_scores.groupBy(*keys).agg(
        F.count_if(F.col("dir") == "F").alias("n_sets"),
        *[
            f(F.when(F.col("dir") == d, F.col("set_score"))).alias(f"{name}_{d.lower()}")
            for d in "FR"
            for name, f in (("avg", F.avg), ("min", F.min))
        ],
    )
    best = F.min(F.struct("score", "f_set", "r_set")).alias("b")
    paired = pair_scores.groupBy(*keys).agg(
        F.count_distinct("f_set").alias("n_compared"), F.avg("score").alias("avg_pair"),
        F.min("score").alias("min_pair"), best,
    )

    def part(direction: str, p: str) -> DataFrame:
        return set_scores.where(F.col("dir") == direction).select(
            *keys, F.col("set_no").alias(f"{p}_set"), F.col("set_score").alias(f"best_{p}")
        )

    return (
        single.join(paired, keys)
        .withColumns({"f_set": F.col("b.f_set"), "r_set": F.col("b.r_set"), "best_pair": F.col("b.score")})
        .join(part("F", "f"), [*keys, "f_set"])
        .join(part("R", "r"), [*keys, "r_set"])
        .drop("b", "f_set", "r_set")
    )


# --- simultaneous filter ------------------------------------------------------------


def set_complementarity(primers: DataFrame, keys: list[str]) -> DataFrame:
    """Per set, the most complementary bases (total and run) of any reversed spacer
    contained in any primer of the set."""
    grouped = primers.groupBy(*keys).agg(
        F.collect_list("spacer").alias("spacers"), F.collect_list("primer").alias("primers")
    )  # four of each by definition
    coded = grouped.withColumns(
        {
            "sp": F.transform("spacers", lambda x: S.encode_overlap(F.reverse(x))),
            "pr": F.transform("primers", S.encode_overlap),
        }
    )
    crossed = F.flatten(
        F.transform("sp", lambda a: F.transform(F.col("pr"), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    scores = F.transform(crossed, lambda p: S.contained_scores(p["a"], p["b"]))
    return coded.withColumn("c", scores).select(
        *keys,
        F.array_max(F.transform("c", lambda x: x["total"])).alias("total"),
        F.array_max(F.transform("c", lambda x: x["run"])).alias("run"),
    )


def simultaneous_filter(sets: DataFrame, keys: list[str], percent: float) -> DataFrame:
    """Two-stage trim: lowest total first, then lowest run, each stage rounding down.

    keys name the locus and direction; sets carry set_no, total and run.
    """
    sets = cut_lineage(sets)
    size = sets.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    drop = F.col("size") * ((100 - percent) / 2) / 100

    def trim(df: DataFrame, score: str, stage: int) -> DataFrame:
        left = size.select(*keys, F.floor(F.col("size") - stage * drop).alias("k"))
        return lowest_by_counts(df, keys, score, "set_no", left, "k")

    return trim(cut_lineage(trim(sets, "total", 1)), "run", 2)


def cross_set_complementarity(primers: DataFrame, keys: list[str]) -> DataFrame:
    """Per forward and reverse set: most complementary bases of any spacer of one in any
    primer of the other."""
    grouped = primers.groupBy(*keys, "dir", "set_no").agg(F.collect_list("spacer").alias("spacers"), F.collect_list("primer").alias("primers"))
    coded = grouped.select(
        *keys, "dir", "set_no", F.transform("spacers", S.encode_overlap).alias("sp"), F.transform("primers", S.encode_overlap).alias("pr")
    )
    sides = [coded.where(F.col("dir") == d).drop("dir") for d in "FR"]
    pairs = tile_pairs(*sides, keys)

    def crossed(a: str, b: str) -> Column:
        return F.flatten(
            F.transform(a, lambda x: F.transform(F.col(b), lambda y: F.struct(x.alias("a"), y.alias("b"))))
        )

    both = F.concat(crossed("f.sp", "r.pr"), crossed("r.sp", "f.pr"))
    score = F.array_max(F.transform(both, lambda p: S.contained_scores(p["a"], p["b"])["total"]))
    return pairs.select(*keys, F.col("f.set_no").alias("f_set"), F.col("r.set_no").alias("r_set"), score.alias("score"))


def sampling_budget(runs: DataFrame, rigour: str = "rigour") -> DataFrame:
    """Random sets per side and pairings to compare for a rigour."""
    r = F.col(rigour)
    steps = F.abs(r) + 1
    root = F.pow(steps, F.lit(1 / 3))
    return runs.withColumns(
        {
            "n_random": F.when(r >= 0, C.INITIAL_SETS * steps).otherwise(F.floor(C.INITIAL_SETS / steps)).cast("bigint"),
            "n_compare": F.when(r >= 0, C.INITIAL_PAIRINGS * root).otherwise(C.INITIAL_PAIRINGS / root).cast("bigint"),
        }
    )


def random_baseline_sets(combos: DataFrame, n_sets: int, seed: str) -> DataFrame:
    """Unoptimised sets with a hash-drawn pairing each."""
    filled = random_spacer_sets(combos, n_sets, seed)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("pairing"), F.col("seq_id").cast("string"),
                                                F.col("set_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return filled.withColumn("perm_id", F.pmod(draw, F.lit(24)).cast("int"))


def score_distribution(scores: DataFrame, keys: list[str], score: str) -> tuple[DataFrame, DataFrame]:
    """Histogram (one bin per distinct score) and mean with population deviation."""
    bins = scores.groupBy(*keys, F.col(score).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    stats = scores.groupBy(*keys).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("sd_score")
    )
    return bins, stats


# --- registry -----------------------------------------------------------------------

# name -> (builder of a score from two encoded oligos, weight); users may add their own,
# a pandas_udf over the two oligos included.
CRITERIA = {
    "run": (lambda a, b: S.overlap_scores(a, b)["run"], C.RUN_WEIGHT),
    "total": (lambda a, b: S.overlap_scores(a, b)["total"], C.TOTAL_WEIGHT),
}


def weighted_criteria(first: str, second: str, criteria: dict | None = None) -> Column:
    """Weighted sum of registered criteria over two encoded oligos, as one expression."""
    total = F.lit(0)
    for build, weight in (criteria or CRITERIA).values():
        total = total + build(F.col(first), F.col(second)) * weight
    return total
