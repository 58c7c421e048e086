"""Batch jobs that write the portfolio's result tables (the whole portfolio in one run).

``due_diligence_job`` computes every company's risk flags once, writes them,
and derives the score, sorted-flag, leak-hit, node and edge tables from the
written flags and inputs. ``portfolio_reports_job`` writes the latest review
per company and the portfolio reports. Outputs are Parquet folders under
``out_dir`` (a shared location on a cluster); re-running overwrites them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.jurisdiction import DEFAULT_LISTS
from riskloom.operators import network as N
from riskloom.operators import portfolio as P
from riskloom.operators import scoring as K
from riskloom.operators import screening as J


def _write(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).parquet(path)


def due_diligence_job(spark: SparkSession, profiles: DataFrame, officers: DataFrame, pscs: DataFrame,
                      filings: DataFrame, leaked: DataFrame, out_dir: str, as_of: dt.date,
                      lists=DEFAULT_LISTS, mode: str = "overwrite") -> dict[str, str]:
    """Write flags, scores, sorted flags, leak hits, nodes and edges; returns their paths."""
    out = {k: f"{out_dir.rstrip('/')}/{k}" for k in
           ("flags", "scores", "flags_sorted", "leak_hits", "nodes", "edges")}
    _write(K.risk_flags(profiles, officers, pscs, filings, leaked, as_of, lists), out["flags"], mode)
    flags = spark.read.parquet(out["flags"])          # computed once, read by the next two
    _write(K.risk_scores(profiles, flags), out["scores"], mode)
    _write(K.sorted_flags(flags), out["flags_sorted"], mode)
    _write(J.hits_only(J.screened_parties(officers, pscs), leaked), out["leak_hits"], mode)
    _write(N.ownership_nodes(profiles, officers, pscs, leaked), out["nodes"], mode)
    _write(N.ownership_edges(profiles, officers, pscs), out["edges"], mode)
    return out


def portfolio_reports_job(spark: SparkSession, companies: DataFrame, kyc: DataFrame, out_dir: str,
                          lists=DEFAULT_LISTS, mode: str = "overwrite") -> dict[str, str]:
    """Write the portfolio table and its reports; returns their paths."""
    out = {k: f"{out_dir.rstrip('/')}/{k}" for k in
           ("latest_kyc", "portfolio", "tiers", "histogram", "compliance", "jurisdictions")}
    _write(P.latest_kyc(kyc), out["latest_kyc"], mode)
    latest = spark.read.parquet(out["latest_kyc"])   # the latest review feeds three reports
    _write(P.portfolio_display(
        P.dedupe_companies(companies).select("company_number", "company_name", "company_status")
        .join(latest.select("company_number", "risk_tier", "risk_score", "leak_hit",
                            latest.status.alias("kyc_status")), "company_number", "left")),
        out["portfolio"], mode)
    _write(P.tier_distribution(latest), out["tiers"], mode)
    _write(P.score_histogram(latest), out["histogram"], mode)
    _write(P.filing_compliance(companies), out["compliance"], mode)
    _write(P.fatf_summary(companies, lists), out["jurisdictions"], mode)
    return out
