"""Every registered query against its DuckDB oracle at sf0.001 (exact)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_all_queries_match_oracles(spark):
    from oracle_check import compare
    res = compare(spark, SF, verbose=False)
    bad = {k: v[0] for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    assert not bad, bad
    assert len(res) >= 68


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "rate_pct" in df.columns
