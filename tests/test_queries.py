"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = sorted(n.removesuffix(".parquet") for n in os.listdir(SF) if n.endswith(".parquet"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return repr(round(value, 7) + 0.0)
    return repr(float(value)) if isinstance(value, int) and not isinstance(value, bool) else str(value)


def lines(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(told(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert lines(df.collect(), df.columns) == lines(got.fetchall(), names)


def test_rows_only_queries(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        if not name.startswith("op") and name != "pipeline":
            assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_invariants(spark):
    for r in entry.queries()["place_scores"](spark, SF).collect():
        assert abs(r.placeness_score - (r.positive_count - r.negative_count) / r.evidence_count) < 1e-5
    shares = entry.queries()["weights"](spark, SF).groupBy("place").sum("weight").collect()
    assert all(abs(r[1] - round(r[1])) < 1e-5 for r in shares)
    for r in entry.queries()["deviant_factors"](spark, SF).collect():
        assert not {x for x in r.strong.split(", ") if x} & set(r.weak.split(", "))
