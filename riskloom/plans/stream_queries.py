"""Registered streaming query (ST1): the streamed latest-review table equals the batch one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.plans.portfolio_queries import _COMPLIANCE_SQL, _LATEST_SQL
from riskloom.plans.registry import query
from riskloom.session import ensure_checkpoint_dir
from riskloom.sources import testdata as T
from riskloom.streaming import kyc_refresh as ST


@query("stream_latest_kyc", f"""
    SELECT id, company_number, risk_tier, risk_score, leak_hit, status
    FROM ({_LATEST_SQL})""", ("dd_kyc",))
def stream_latest_kyc(spark, d):
    """KYC rows land as four files (each company's reviews spread over them) and are
    streamed one file per micro-batch; the merged table is read back."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    ST.land(T.kyc_status(spark, d), f"{base}/landing", files=4)
    latest = ST.run_available(spark, f"{base}/landing", f"{base}/state", f"{base}/checkpoint",
                              max_files_per_trigger=1)
    return latest.select("id", F.col("company_number").cast("bigint").alias("company_number"), "risk_tier", "risk_score", "leak_hit", "status")


@query("stream_kpis", f"""
    WITH k AS ({_LATEST_SQL})
    SELECT 'risk_tier' AS kpi, risk_tier AS value, count(*) AS companies FROM k WHERE risk_tier IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'reviewed', 'all', count(*) FROM k
    UNION ALL SELECT 'reviewed', 'leak_hit', count(*) FROM k WHERE leak_hit
    UNION ALL SELECT 'accounts', 'overdue', overdue FROM ({_COMPLIANCE_SQL})
    UNION ALL SELECT 'accounts', 'on_track', on_track FROM ({_COMPLIANCE_SQL})
    UNION ALL SELECT 'accounts', 'all', count(DISTINCT company_number) FROM dd_company""", ("dd_kyc", "dd_company"))
def stream_kpis(spark, d):
    """Tier, leak and compliance counts after both streams have run file by file, kept by differences alone."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    ST.land(T.kyc_status(spark, d), f"{base}/kyc", files=3)
    ST.land_companies(T.companies(spark, d), f"{base}/companies", files=2)
    ST.run_available(spark, f"{base}/kyc", f"{base}/state", f"{base}/kyc-checkpoint", max_files_per_trigger=1, buckets=8)
    ST.run_available_companies(spark, f"{base}/companies", f"{base}/state", f"{base}/company-checkpoint",
                               max_files_per_trigger=1, buckets=8)
    return ST.read_kpis(spark, f"{base}/state")
