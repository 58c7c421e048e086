"""Every registered query with an oracle equals its DuckDB SQL on sf0.001; the rest run."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()
HEAVY = {"anomaly_overview"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(ocols, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - HEAVY))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_every_query_has_a_unique_name():
    assert len(QUERIES) == len(set(QUERIES))
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["company_number", "company_name", "company_status", "risk_tier",
                          "risk_score", "leak_hit", "kyc_status"]
