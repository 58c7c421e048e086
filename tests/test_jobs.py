"""The batch jobs write the same tables the registered queries compute."""

from __future__ import annotations

import tempfile

import __spark_entry__ as E

from conftest import SF_SMALL
from riskloom.jobs import due_diligence_job, portfolio_reports_job
from riskloom.plans.portfolio_queries import TEST_LISTS
from riskloom.sources import testdata as T


def rows(df):
    return sorted(map(repr, map(tuple, df.select(sorted(df.columns)).collect())))


def test_due_diligence_job(spark):
    out_dir = tempfile.mkdtemp(prefix="riskloom-job-", dir="/tmp")
    d = SF_SMALL
    paths = due_diligence_job(spark, T.profiles(spark, d), T.officers(spark, d), T.pscs(spark, d),
                              T.filings(spark, d), T.leaked_names(spark, d), out_dir, T.AS_OF, TEST_LISTS)
    q = E.queries()
    assert rows(spark.read.parquet(paths["scores"])) == rows(q["risk_score"](spark, d))
    assert rows(spark.read.parquet(paths["flags"])) == rows(q["risk_flags"](spark, d))
    assert rows(spark.read.parquet(paths["nodes"])) == rows(q["ownership_nodes"](spark, d))


def test_portfolio_reports_job(spark):
    out_dir = tempfile.mkdtemp(prefix="riskloom-job-", dir="/tmp")
    d = SF_SMALL
    paths = portfolio_reports_job(spark, T.companies(spark, d), T.kyc_status(spark, d), out_dir, TEST_LISTS)
    q = E.queries()
    for key, name in (("portfolio", "portfolio_latest"), ("tiers", "tier_distribution"),
                      ("histogram", "score_histogram"), ("compliance", "filing_compliance"),
                      ("jurisdictions", "fatf_summary")):
        assert rows(spark.read.parquet(paths[key])) == rows(q[name](spark, d)), key
