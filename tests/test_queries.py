"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidal.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events", "customer", "nation"):
        path = f"{DATA}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return ""
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return v if isinstance(v, str) else f"{float(v):.5f}".replace("-0.00000", "0.00000")

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) and len(got)
        if "p_value" in got and "used" in got:
            ok = got[got["status"] == "ok"]
            assert (len(ok) or set(got["status"]) == {"no_statistic"}) and (abs(ok["p_value"] - (ok["exceedances"] + 1) / (ok["used"] + 1)) < 1e-6).all() and (ok["exceedances"] <= ok["used"]).all()
            assert (ok["null_q95"] <= ok["null_q99"]).all() and (ok["used"] > 400).all() and got[got["status"] != "ok"]["p_value"].isna().all()
        for p in (c for c in got.columns if c == "p" or c.endswith(("_p", "_holm", "_fdr", "q_bh"))):
            assert got[p].dropna().between(0, 1).all()
