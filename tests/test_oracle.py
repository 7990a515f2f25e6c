"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01), plus the contract shape."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
#: Whole searches; tests/test_trees.py runs the same code on small grids.
SLOW = {"tournament", "serve_forecast", "random_forest"}


def _norm(df):
    df = df[sorted(df.columns)]
    out = []
    for rec in df.itertuples(index=False):
        vals = []
        for v in rec:
            if v is None or (isinstance(v, float) and v != v):
                vals.append("NULL")
            elif hasattr(v, "item"):
                x = v.item()
                vals.append(repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x))
            elif isinstance(v, float):
                vals.append(repr(round(v, 6) + 0.0))
            else:
                vals.append(repr(v))
        out.append("|".join(vals))
    return hashlib.sha1("\n".join(sorted(out)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_contract_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "y_ema_7" in df.columns


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert _norm(s) == _norm(d)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0
