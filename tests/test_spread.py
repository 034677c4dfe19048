"""Small tables make many tasks, and what a row does not need stays on it."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from oligoweave.functions import constants as C
from oligoweave.functions import sequence as S
from oligoweave.operators import spacers as H
from oligoweave.plans import four_copy as FC
from oligoweave.plans import views as V
from oligoweave.session import cut_lineage
from oligoweave.sources import sinks as K


@pytest.fixture
def tables(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(40).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("view", [V.bindings, V.oligo_pairs, V.long_pairs, V.spacer_sets])
def test_a_table_of_one_block_is_worked_on_by_many_tasks(spark, tables, view):
    assert view(spark, tables).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_fillings_are_spread_after_the_best_combo(spark, tables):
    best = H.best_combo(H.spacer_length_combos(V.bindings(spark, tables), 8, 8, 1))
    filled = H.random_spacer_sets(best, 2, "x")
    assert filled.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_the_best_combos_of_a_row_are_the_best_of_all(spark):
    rows = [(i, "".join(random.Random(i).choices("ACGTN", k=18))) for i in range(30)] + [(3, "ACGTACGGTTACCAGT"), (40, None), (41, "")]
    seqs = spark.createDataFrame(rows, "seq_id int, seq string")
    for keep in (1, 4):
        whole = H.rank_spacer_combos(H.spacer_length_combos(seqs, 6, 6), keep)
        short = H.rank_spacer_combos(H.spacer_length_combos(seqs, 6, 6, keep), keep)
        assert sorted(map(str, whole.collect())) == sorted(map(str, short.collect()))


def _lowest(a: str, b: str) -> int:
    """Lowest energy of one run of pairs over all shifts, base by base."""
    table, swap = C.step_table(), str.maketrans("ATCG", "TAGC")
    other = b.translate(swap)[::-1]
    best = 0
    for shift in range(-len(other) + 1, len(a)):
        energy, on = 0, False
        for i in range(max(0, shift), min(len(a), shift + len(other))):
            pair = a[i] in "ATCG" and a[i] == other[i - shift]
            energy = energy + table[a[i - 1 : i + 1]][2] if pair and on else 0
            best, on = min(best, energy), pair
    return best


def test_long_duplexes_equal_a_walk_over_all_shifts(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("ACGT", k=n)), "".join(rng.choices("ACGTN", k=m))) for n, m in itertools.product((64, 77, 90), (1, 2, 20, 64, 90))]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.dimer_energy("a", "b").alias("ab"), S.dimer_energy("b", "a").alias("ba"))
    for a, b, ab, ba in rows.collect():
        assert round(ab * 100) == round(ba * 100) == _lowest(a, b)


def test_long_duplexes_take_steps_along_the_longer_oligo_only(spark):
    """The plan keeps no function of a base inside a function of a shift: work of length x length, not x length again."""
    rows = spark.createDataFrame([("A" * 70, "T" * 70)], "a string, b string")
    plan = rows.select(S.dimer_energy("a", "b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan and rows.select(S.dimer_energy("a", "b")).first()[0] == -69.0


def test_a_pool_is_written_by_one_task_per_panel(spark, tmp_path):
    path = str(tmp_path / "pool")
    pool = spark.range(60).repartition(6).select(
        F.pmod("id", F.lit(5)).alias("panel_id"), F.lit(0).alias("i"), F.lit("t").alias("target"), F.lit("ACG").alias("f_primer"), F.lit("CCG").alias("r_primer")
    )
    K.sink_fasta_pool(pool, path)
    for panel in range(5):
        assert len(list((tmp_path / "pool" / f"panel_id={panel}").glob("part-*"))) == 1


def test_sets_of_designs_are_scored_by_many_tasks(spark):
    """A design each in one row of one block: the scores of its sets are worked out over all tasks."""
    primers = spark.createDataFrame(
        [(str(i), d, 0, k, "ACGTACGTAC" + "ACGT"[k] * k + "TTGCATGCAT", 10, 10) for i in range(8) for d in "FR" for k in range(4)],
        "design string, dir string, set_no int, k int, primer string, five_p_len int, three_p_len int",
    ).coalesce(1)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    plan = FC.scored_alone(primers)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {tasks}, true" in plan or f"RepartitionByExpression {tasks}" in plan


def test_fillings_draw_for_vacant_copies_only(spark, tables):
    best = H.best_combo(H.spacer_length_combos(V.bindings(spark, tables), 8, 8, 1))
    plan = H.random_spacer_sets(best, 2, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(transform(filter(" in plan


def _designs(spark, n: int):
    rows = [(str(i), -399, "ACGTAC", "GTCATG", "ACGGTTACCAGTGGAT", "TTGACCAGTACGATCA") for i in range(n)]
    return spark.createDataFrame(rows, "design string, rigour int, f_adapt string, r_adapt string, f_bind string, r_bind string")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_designs_are_not_collected_in_the_driver(spark, monkeypatch):
    """A written table of few compressed bytes may be large in memory, and there is one row or more for each design."""
    primers = cut_lineage(spark.createDataFrame(
        [(str(i), d, j, k, "ACGTACGGTTACCAGTGGATC" + "ACGT"[k] * (k + 1), 6, 16, 3) for i in range(3) for d in "FR" for j in range(4) for k in range(4)],
        "design string, dir string, set_no int, k int, primer string, five_p_len int, three_p_len int, n_compare bigint",
    ))
    scores = cut_lineage(FC.scored_alone(primers))
    sets = cut_lineage(FC.survivors(primers, scores))
    monkeypatch.setattr(FC.W, "lowest_by_counts", lambda df, *_: df)  # its sums are sized when they are made
    plans = [_plan(FC.scored_alone(primers)), _plan(FC.survivors(primers, scores))]
    assert sets.groupBy("design", "dir").count().where("count <> 3").isEmpty() and sets.count() == 18
    pairs = FC.raced(sets)
    assert pairs.select("design").distinct().count() == 3
    plans.append(_plan(FC._leaving(pairs, cut_lineage(FC._leaving(pairs, None)))))
    assert not any("Broadcast" in plan for plan in plans)


def test_rules_of_designs_are_worked_out_by_shuffles(spark):
    designs = cut_lineage(_designs(spark, 3))
    primers = lambda a, b: [a + x + b for x in ("", "A", "CA", "TCA")]
    found = designs.where("design < 2").select(
        "design", F.lit(FC.DONE).alias("reason"), F.lit(1).cast("bigint").alias("score"), F.lit(2).cast("bigint").alias("n_drawn"), F.lit(2).cast("bigint").alias("n_compared"),
        F.array(*map(F.lit, primers("ACGTAC", "ACGGTTACCAGTGGAT"))).alias("f_primers"), F.array(*map(F.lit, primers("GTCATG", "TTGACCAGTACGATCA"))).alias("r_primers"),
    )
    rules = FC.design_rules(cut_lineage(found), designs)
    assert _plan(rules).count("BroadcastHashJoin") <= 4  # of tiles, which are sized when they are made
    assert sorted((r.design, r.whole) for r in rules.collect())[:2] == [("0", True), ("1", True)]
