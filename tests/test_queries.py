"""Every registered query with SQL against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from tideline.plans import catalog
from tideline.plans import catalog_more as _  # noqa: F401
from tideline.plans import catalog_sources as _sources  # noqa: F401

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = list(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out:
        column = out[c].astype(object).where(out[c].notna(), None)
        out[c] = [None if v is None else str(v)[:10] if hasattr(v, "year") else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in column]
    exact = [c for c in out if not any(isinstance(v, float) and v != int(v) for v in out[c] if v is not None and v == v)]
    return out.sort_values([*exact, *(c for c in out if c not in exact)], key=lambda s: s.map(lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)), ignore_index=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, duck, name):
    got = plain(catalog.queries()[name](spark, DIR).toPandas())
    want = plain(duck.execute(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1.5e-5)


def test_flagship(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() > 0
