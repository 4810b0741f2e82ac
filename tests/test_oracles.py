"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from verbatix.plans.queries import QUERIES
from verbatix.plans.sql import SQL

SMALL = "/root/testdata/sf0.001"
#: Those with linear models; test_linear.py holds the models against plain ones.
WITHOUT_SQL = {"logreg_cv", "svm_cv", "top_features", "diagnostic_binary", "diagnostic_use_mention", "diagnostic_by_category", "diagnostic_errors", "representation_grid", "protocol_grid", "subtype_grid", "three_way_grid", "learning_curve_tasks"}


def canon(df):
    def show(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{float(v):.6g}" if isinstance(v, float) else str(v)

    return sorted(map(tuple, df[sorted(df.columns)].map(show).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_csv_round_trip(spark):
    a, b = QUERIES["scan_csv_roundtrip"](spark, SMALL).toPandas(), QUERIES["scan_corpus"](spark, SMALL).toPandas()
    assert sorted(a.text_md5) == sorted(b.text_md5)
