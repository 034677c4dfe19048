"""The two runs from inputs to primers: every target and every design is in the result once."""

import os

import pytest

from oligoweave.plans import catalog_pool as CP
from oligoweave.plans import four_copy as FC
from oligoweave.plans import panel_pool as PP
from oligoweave.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_every_target_is_in_the_pool_run_once(spark):
    inputs = CP.inputs(spark, SF)
    request = PP.PoolRequest(n_hetero=9, max_spacer=2, n_pools=2, max_primer=40)
    result = cut_lineage(PP.panel_to_pool(inputs, request))
    rows = result.collect()
    want = sorted(map(tuple, inputs.targets.select("panel_id", "target").collect()))
    assert sorted((r.panel_id, r.target) for r in rows) == want
    reasons = {r.reason for r in rows}
    assert reasons <= {PP.SERVED, PP.NO_ALIGNMENT, PP.NO_ROOM, PP.NO_PAIR, PP.NO_ADAPTER, PP.TOO_SHORT, PP.NO_SPACERS, PP.TOO_LONG}
    assert PP.NO_ALIGNMENT in reasons and len(reasons) > 2
    for r in rows:
        assert (r.reason == PP.SERVED) == (r.f_primer is not None)
        if r.reason == PP.SERVED:
            assert r.f_primer.startswith(r.f_adapt) and r.f_primer.endswith(r.f_seq) and len(r.f_primer) <= request.max_primer
    rules = PP.pool_rules(result, inputs, request).collect()
    assert len(rules) == len(want) and all((r.n_rows, r.whole, r.even, r.within) == (1, True, True, True) for r in rules)


def test_every_design_has_a_row(spark):
    f, r = "ACACTCTTTCCCTACACGAC", "GTGACTGGAGTTCAGACGTG"
    rows = [
        ("short", f, r, "GTCATCTTCTTCTGCTACG", "GATCGGAATGGTCATGAAGA", -399),
        ("long", f * 2, r * 2, "GTCATCTTCTTCTGCTACG", "GATCGGAATGGTCATGAAGA", -249),
        ("none", f, r, "AAAAAAAAAAAAAAAA", "GATCGGAATGGTCATGAAGA", -399),
    ]
    designs = spark.createDataFrame(rows, "design string, f_adapt string, r_adapt string, f_bind string, r_bind string, rigour int")
    found = cut_lineage(FC.four_copy_design(designs, 4, 3, "seed"))
    got = {r.design: r for r in found.collect()}
    assert sorted(got) == ["long", "none", "short"] and got["none"].reason == FC.NO_COMBO and got["none"].f_primers is None
    for name, adapt, drawn in (("short", f, 2), ("long", f * 2, 4)):
        row = got[name]
        assert row.reason == FC.DONE and row.n_drawn == row.n_compared == drawn and 0 < row.n_scored <= drawn * drawn
        assert len(set(row.f_primers)) == 4 and all(p.startswith(adapt) and p.endswith("GTCATCTTCTTCTGCTACG") for p in row.f_primers)
    assert got["short"].n_scored == 4  # two sets a side: all pairs, before any leaves
    rules = FC.design_rules(found, designs).collect()
    assert all(r.whole and r.scored for r in rules)
