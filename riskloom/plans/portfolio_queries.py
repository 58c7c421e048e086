"""Registered portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.jurisdiction import JurisdictionList
from riskloom.operators import portfolio as P
from riskloom.plans.registry import query
from riskloom.sources import testdata as T

# Screening lists for the driver data, whose countries are NATION_0..NATION_24.
# 'nation_2' also hits NATION_20..NATION_24 as a substring, so priority matters.
TEST_LISTS = (
    JurisdictionList("FATF Black List", "Critical", ("nation_24",)),
    JurisdictionList("FATF Grey List", "High", ("nation_7", "nation_21")),
    JurisdictionList("High-Risk Jurisdiction", "High", ("nation_2",)),
)
TEST_LISTS_SQL = """CASE
    WHEN lower(trim({c})) IS NULL OR lower(trim({c})) IN ('', 'nan') THEN NULL
    WHEN contains(lower(trim({c})), 'nation_24') THEN '{a}'
    WHEN contains(lower(trim({c})), 'nation_7') OR contains(lower(trim({c})), 'nation_21') THEN '{b}'
    WHEN contains(lower(trim({c})), 'nation_2') THEN '{d}' END"""


def test_label_sql(c: str) -> str:
    return TEST_LISTS_SQL.format(c=c, a="FATF Black List", b="FATF Grey List",
                                 d="High-Risk Jurisdiction")


def test_severity_sql(c: str) -> str:
    return TEST_LISTS_SQL.format(c=c, a="Critical", b="High", d="High")


_LATEST_SQL = """SELECT DISTINCT ON (company_number) * FROM dd_kyc
                 ORDER BY company_number, id DESC NULLS FIRST"""


@query("latest_kyc", f"""
    SELECT id, company_number, risk_tier, risk_score, leak_hit, status
    FROM ({_LATEST_SQL})""", ("dd_kyc",))
def latest_kyc(spark, d):
    return P.latest_kyc(T.kyc_status(spark, d))


@query("portfolio_latest", """
    SELECT c.company_number, c.company_name, c.company_status, k.risk_tier,
           CAST(coalesce(k.risk_score, 0) AS INTEGER) AS risk_score,
           CASE WHEN coalesce(k.leak_hit, FALSE) THEN 'YES' ELSE 'No' END AS leak_hit,
           k.status AS kyc_status
    FROM (SELECT DISTINCT ON (company_number) * FROM dd_company
          ORDER BY company_number, company_name, company_status, country) c
    LEFT JOIN (SELECT DISTINCT ON (company_number) * FROM dd_kyc
               ORDER BY company_number, id DESC) k
      ON c.company_number = k.company_number""", ("dd_company", "dd_kyc"))
def portfolio_latest(spark, d):
    return P.portfolio_latest(T.companies(spark, d), T.kyc_status(spark, d))


# Search: names ending in 7 followed by another digit, any case; HIGH tier only.
SEARCH = "7[0-9]$"


@query("portfolio_search", f"""
    SELECT c.company_number, c.company_name, c.company_status, k.risk_tier,
           CAST(coalesce(k.risk_score, 0) AS INTEGER) AS risk_score,
           CASE WHEN coalesce(k.leak_hit, FALSE) THEN 'YES' ELSE 'No' END AS leak_hit,
           k.status AS kyc_status
    FROM dd_company c
    JOIN (SELECT DISTINCT ON (company_number) * FROM dd_kyc
          ORDER BY company_number, id DESC) k ON c.company_number = k.company_number
    WHERE (regexp_matches(c.company_name, '(?i){SEARCH}')
           OR regexp_matches(CAST(c.company_number AS VARCHAR), '(?i){SEARCH}'))
      AND k.risk_tier = 'HIGH'""", ("dd_company", "dd_kyc"))
def portfolio_search(spark, d):
    rows = P.portfolio_rows(T.companies(spark, d), T.kyc_status(spark, d))
    return P.portfolio_display(P.portfolio_search(rows, SEARCH, "HIGH"))


@query("portfolio_leak_hits", """
    SELECT c.company_number, c.company_name, c.company_status, k.risk_tier,
           CAST(coalesce(k.risk_score, 0) AS INTEGER) AS risk_score,
           'YES' AS leak_hit, k.status AS kyc_status
    FROM dd_company c
    JOIN (SELECT DISTINCT ON (company_number) * FROM dd_kyc
          ORDER BY company_number, id DESC) k ON c.company_number = k.company_number
    WHERE k.leak_hit""", ("dd_company", "dd_kyc"))
def portfolio_leak_hits(spark, d):
    rows = P.portfolio_rows(T.companies(spark, d), T.kyc_status(spark, d))
    return P.portfolio_display(P.portfolio_search(rows, leak_only=True))


@query("portfolio_page", """
    SELECT * FROM (
      SELECT c.company_number, c.company_name, c.company_status, k.risk_tier,
             CAST(coalesce(k.risk_score, 0) AS INTEGER) AS risk_score,
             CASE WHEN coalesce(k.leak_hit, FALSE) THEN 'YES' ELSE 'No' END AS leak_hit,
             k.status AS kyc_status
      FROM dd_company c
      LEFT JOIN (SELECT DISTINCT ON (company_number) * FROM dd_kyc
                 ORDER BY company_number, id DESC) k ON c.company_number = k.company_number)
    ORDER BY risk_score DESC, company_number LIMIT 20 OFFSET 20""", ("dd_company", "dd_kyc"))
def portfolio_page(spark, d):
    rows = P.portfolio_latest(T.companies(spark, d), T.kyc_status(spark, d))
    return P.page(rows, [F.col("risk_score").desc(), F.col("company_number")], 20, 1)


@query("company_options", """
    SELECT company_name || ' (' || CAST(company_number AS VARCHAR) || ')' AS label,
           company_number AS value
    FROM (SELECT DISTINCT ON (company_number) company_number, company_name FROM dd_company
          ORDER BY company_number, company_name)""", ("dd_company",))
def company_options(spark, d):
    return P.company_options(T.companies(spark, d))


@query("tier_distribution", f"""
    SELECT risk_tier, CAST(count(*) AS BIGINT) AS companies,
           round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share_pct
    FROM ({_LATEST_SQL}) WHERE risk_tier IS NOT NULL GROUP BY risk_tier""", ("dd_kyc",))
def tier_distribution(spark, d):
    return P.tier_distribution(T.kyc_status(spark, d))


@query("score_histogram", f"""
    SELECT CAST(least(floor(risk_score / 10.0), 9) AS INTEGER) AS bin,
           least(floor(risk_score / 10.0), 9) * 10.0 AS bin_lo,
           (least(floor(risk_score / 10.0), 9) + 1) * 10.0 AS bin_hi,
           CAST(count(*) AS BIGINT) AS companies
    FROM ({_LATEST_SQL}) WHERE risk_score IS NOT NULL GROUP BY 1, 2, 3""", ("dd_kyc",))
def score_histogram(spark, d):
    return P.score_histogram(T.kyc_status(spark, d))


_COMPLIANCE_SQL = """
    SELECT CAST(sum(CASE WHEN accounts_overdue THEN 1 ELSE 0 END) AS BIGINT) AS overdue,
           CAST(sum(CASE WHEN NOT accounts_overdue THEN 1 ELSE 0 END) AS BIGINT) AS on_track
    FROM (SELECT DISTINCT ON (company_number) company_number, accounts_overdue FROM dd_company
          ORDER BY company_number, company_name, company_status, country)"""


@query("filing_compliance", _COMPLIANCE_SQL, ("dd_company",))
def filing_compliance(spark, d):
    return P.filing_compliance(T.companies(spark, d))


@query("fatf_summary", f"""
    SELECT * FROM (
      SELECT company_number, company_name, country,
             {test_label_sql('country')} AS risk_label,
             {test_severity_sql('country')} AS severity
      FROM (SELECT DISTINCT ON (company_number) * FROM dd_company
            ORDER BY company_number, company_name, company_status, country))
    WHERE risk_label IS NOT NULL""", ("dd_company",))
def fatf_summary(spark, d):
    return P.fatf_summary(T.companies(spark, d), TEST_LISTS)
