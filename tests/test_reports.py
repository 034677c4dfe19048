"""Drawings of a dimer report are put together in one shuffle of its lines, wherever its chunks are cut."""

import random
import time

import pytest
from pyspark.sql import functions as F

from oligoweave.plans import catalog_tables as CT
from oligoweave.plans import views as V
from oligoweave.session import cut_lineage
from oligoweave.sources import reports as RP
from oligoweave.sources.lines import carry_down


def _report(n: int, seed: int) -> list[str]:
    rng, lines = random.Random(seed), ["Self-Dimers:"]
    for i in range(n):
        k = rng.randint(1, 3)
        lines.append(f"{k} dimer{'s' if k > 1 else ''} for set {'FR'[i % 2]}{i}")
        for _ in range(k + i % 2):
            lines += [" " * rng.randint(0, 5) + "ACGT", " " + "|" * rng.randint(0, 4), " " * rng.randint(0, 5) + "TGCA", rng.choice(["", "x"])]
        lines += rng.choice([[], ["ACGT"], ["ACGT", "||"], ["ACGT", "||", " TGCA"]])
        if i % 5 == 4:
            lines += ["Cross Primer Dimers:", f"{'FR'[i % 2]}1 with set {'RF'[i % 2]}{i}", "lead", "  AC", " ||", " TG", ""]
    return lines


def _expected(lines: list[str]) -> tuple[set, set]:
    homo, hetero, at = set(), set(), None
    for i, line in enumerate(lines):
        if " for " in line or " with " in line or line.endswith(":"):
            at, head, first = i, line, i + (2 if " with " in line else 1)
        if at is None or i < first or (i - first) % 4 or head.endswith(":"):
            continue
        end = next((j for j in range(i, len(lines)) if " for " in lines[j] or " with " in lines[j] or lines[j].endswith(":")), len(lines))
        four = lines[i : min(i + 4, end)]
        if len(four) < 3:
            continue
        bars, off = four[1].count("|"), bool(four[3:] and four[3])
        if " for " in head:
            if (i - first) // 4 < int(head.split()[0]):
                name = head.split()[-1]
                homo.add((int(name[1:]), name[0] == "F", four[2].count(" ") - four[0].count(" "), bars, i, off))
        else:
            lead, other = head.split()[0], head.split()[-1]
            pair = (int(other[1:]), int(lead[1:])) if lead[0] == "R" else (int(lead[1:]), int(other[1:]))
            shift = len(four[2]) - len(four[0]) if lead[0] == "R" else four[2].count(" ")
            hetero.add((*pair, shift, bars, i, off))
    return homo, hetero


@pytest.mark.parametrize("chunk", [3, 4, 7, 50, 100_000])
def test_drawings_across_chunks(spark, chunk):
    texts = {"a": _report(40, 1), "b": _report(3, 2), "c": ["nothing"], None: _report(9, 3)}
    rows = [(name, i, x) for name, lines in texts.items() for i, x in enumerate(lines)]
    lines = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), "file string, line_no bigint, text string").repartition(5)
    drawings = RP._drawings(lines.select("file", "line_no", *RP._marks()), chunk)
    homo, hetero = RP._homodimers(drawings).collect(), RP._heterodimers(drawings).collect()
    for name, report in texts.items():
        mine = [sorted(tuple(r)[1:] for r in found if r.file == name) for found in (homo, hetero)]
        assert mine == [sorted(x) for x in _expected(report)]


def test_lines_are_shuffled_once(spark):
    rows = [("a", i, x) for i, x in enumerate(_report(10, 5))]
    lines = cut_lineage(spark.createDataFrame(rows, "file string, line_no bigint, text string"))
    for parse in (RP.parse_homodimers, RP.parse_heterodimers):
        plan = parse(lines)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 1 and "Aggregate" not in plan and "Join" not in plan


def test_carried_value_stands_beside_lines_further_down(spark):
    lines = spark.range(20).select(F.lit("a").alias("file"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("text"))
    got = carry_down(lines, F.when(F.col("line_no") % 9 == 2, F.col("line_no")), "h", 4, [("text", 3)]).orderBy("line_no").collect()
    assert [r.h for r in got] == [None] * 2 + [2] * 9 + [11] * 9
    assert [r.text3 for r in got] == [str(i) for i in range(3, 20)] + [None] * 3


def test_written_reports_have_the_lines_of_the_numbered_ones(spark, tmp_path):
    spark.createDataFrame(
        [(i, i * 3 % 14, i % 3, i % 4, float(i % 6)) for i in range(40)] + [(1, None, 2, 3, None)],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {}
    for r in sorted(V.report_lines(spark, str(tmp_path)).collect(), key=lambda r: (r.file, r.line_no)):
        assert r.line_no == len(want.setdefault(r.file, []))
        want[r.file].append(r.text or "")
    back = spark.read.text(CT.report_files(spark, str(tmp_path)), wholetext=True).collect()
    assert {r.file: r.value for r in back} == {file: "".join(x + "\n" for x in lines) for file, lines in want.items()}


@pytest.mark.parametrize("size", [60, 700, 1 << 27])
def test_drawings_of_files_read_in_blocks(spark, tmp_path, size):
    """Blocks with less than a drawing, without a line and without a header between two with one."""
    texts = {"a": _report(12, 1), "b": _report(3, 2), "c": ["nothing"], "d": ["1 dimer for F1", *["x" * 90] * 9, "2 dimers for F2", *["yy |"] * 3]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(size))
        homo, hetero = (found.collect() for found in RP.load_results_dir(spark, str(tmp_path)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, lines in texts.items():
        mine = [sorted(tuple(r)[1:-1] for r in found if r.file.endswith(f"/{name}")) for found in (homo, hetero)]
        assert mine == [sorted(x) for x in _expected(lines)]


def test_reports_read_from_files_are_shuffled_once_and_not_sorted_for_their_sums(spark, tmp_path, monkeypatch):
    spark.createDataFrame(
        [(i, i * 3, i % 3, i % 4, float(i % 6)) for i in range(40)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(RP, "cut_lineage", written)
    result = CT.load_results_dir(spark, str(tmp_path))
    read, placed = plans
    assert "Exchange" not in read and placed.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in result._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_with_the_table_written(spark):
    """Without it they stay until the driver collects its garbage, and all steps of a query add up on disk."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = kept()
    cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before
