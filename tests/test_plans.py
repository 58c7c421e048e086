"""Physical plan shapes that the design relies on."""

from __future__ import annotations

import __spark_entry__ as E

from conftest import SF_SMALL

Q = E.queries()
NO_PYTHON = [n for n in Q if n not in ("iforest_flags", "ae_flags", "ae_training", "anomaly_overview", "anomaly_overview_fixed",
                                       "stream_latest_kyc", "export_roundtrip", "nested_company_docs",
                                       "p95_threshold")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key_uses_partial_window_group_limit(spark):
    p = plan(Q["latest_kyc"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_txn_filter_pushes_filters_and_prunes_columns(spark):
    df = Q["txn_filter"](spark, SF_SMALL)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "In(l_returnflag, [A,R])" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int," \
           "l_extendedprice:double,l_discount:double,l_returnflag:string>" in text


def test_sql_operators_have_no_python_or_nested_loops(spark):
    for name in NO_PYTHON:
        p = plan(Q[name](spark, SF_SMALL))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in p, (name, bad)


def test_high_risk_summary_aggregates_before_the_join(spark):
    p = plan(Q["high_risk_summary"](spark, SF_SMALL))
    join_at = p.find("Join")
    assert "HashAggregate" in p[join_at:]   # the transaction side is aggregated below the join
