"""Registered queries against their SQL on the smallest tables, and plan shape."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "column_conservation", "consensus_string", "region_warning_summary", "enumerate_pairs", "select_pair",
    "max_overlap_run", "spacer_length_combos", "pairing_scores", "balanced_spacer_search", "pool_score",
    "scan_dimer_report_cross", "stats_by_param", "successive_elimination",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(dict(zip(columns, r))[c] for c in order) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_n_is_limited_before_the_shuffle(spark):
    plan = entry.queries()["n_lowest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_panel_search_serves_every_target_once(spark):
    rows = entry.entry(spark).collect()
    assert len({(r.panel_id, r.target) for r in rows}) == len(rows) > 0


def test_best_pairs_are_found_at_every_length(spark):
    """The best pair of each target over the pairs that enumerate_pairs lists, scored one by one."""
    from oligoweave.operators import scoring as G
    from oligoweave.plans.catalog_search import PAIR, TARGET, Search

    x = Search(spark, SF)
    every = G.scored_region_pairs(x.pairs, x.inputs.adapters).select(*TARGET, *PAIR, "adapter", "penalty").collect()
    got = entry.queries()["best_region_pairs"](spark, SF).collect()
    for target in {r[:2] for r in every}:
        want = sorted((round(r.penalty, 6), *r[2:7]) for r in every if r[:2] == target)[:25]
        assert sorted((r.penalty, *r[2:7]) for r in got if r[:2] == target) == want
    assert len({(r.f_len, r.r_len) for r in got}) > 1
    tiers = entry.queries()["tiered_pair_ranking"](spark, SF).collect()
    assert {r[:7] for r in tiers} <= {r[:7] for r in got} and len({(r.f_len, r.r_len) for r in tiers}) > 1
