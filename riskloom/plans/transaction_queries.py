"""Registered transaction, risk-series and file queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.functions.text import join_nonempty
from riskloom.operators import paging as PG
from riskloom.operators import portfolio as P
from riskloom.operators import transactions as X
from riskloom.session import ensure_checkpoint_dir
from riskloom.sources import files as S
from riskloom.sources import testdata as T
from riskloom.plans.registry import query

# The whole portfolio, filtered like one analyst screen (every filter set).
FILTER = X.TxnFilter(start="1996-01-01", end="1999-12-31", sender="supplier#00000001",
                     types=("A", "R"), risk="high")

_FILTER_SQL = """
    SELECT * FROM dd_txn
    WHERE transaction_date >= DATE '1996-01-01' AND transaction_date <= DATE '1999-12-31'
      AND contains(lower(sender_account), 'supplier#00000001')
      AND transaction_type IN ('A', 'R') AND financial_risk > 0.7"""

_TXN_OUT_SQL = """strftime(transaction_date, '%Y-%m-%d') AS transaction_date, transaction_type,
    company_id, sender_account, recipient_account, transaction_amount, transaction_id,
    financial_risk"""


def _filtered(spark, d):
    return X.filter_transactions(T.transactions(spark, d), FILTER)


@query("txn_filter", f"SELECT {_TXN_OUT_SQL} FROM ({_FILTER_SQL})", ("dd_txn",))
def txn_filter(spark, d):
    return X.render_dates(_filtered(spark, d))


@query("txn_filter_summary", f"""
    SELECT *, '$' || format('{{:,.2f}}', total_amount) AS total_amount_label FROM (
      SELECT company_id, CAST(count(*) AS BIGINT) AS txn_rows,
             CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
             CAST(count(*) FILTER (WHERE financial_risk > 0.7) AS BIGINT) AS high_risk_rows
      FROM ({_FILTER_SQL}) GROUP BY company_id)""", ("dd_txn",))
def txn_filter_summary(spark, d):
    return X.filter_summary(_filtered(spark, d))


@query("txn_newest", f"""
    SELECT {_TXN_OUT_SQL} FROM dd_txn
    QUALIFY row_number() OVER (PARTITION BY company_id
              ORDER BY transaction_date DESC, transaction_id DESC, transaction_amount DESC) <= 20""", ("dd_txn",))
def txn_newest(spark, d):
    """The newest rows of each company, as an analyst's first page."""
    newest = X.filter_transactions(T.transactions(spark, d), X.TxnFilter(limit_per_company=20))
    return X.render_dates(newest)


@query("txn_late_page", f"""
    SELECT {_TXN_OUT_SQL}, CAST(rank AS BIGINT) AS position FROM (
        SELECT *, row_number() OVER (ORDER BY transaction_date DESC, transaction_id DESC, transaction_amount DESC) - 1 AS rank
        FROM dd_txn) WHERE rank BETWEEN 5000 AND 5019""", ("dd_txn",))
def txn_late_page(spark, d):
    """Page 250 of all transactions, newest first, out of ranked blocks."""
    path = f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    order = [F.col(c).desc() for c in ("transaction_date", "transaction_id", "transaction_amount")]
    PG.write_pages(T.transactions(spark, d), order, path)
    page = PG.read_page(spark, path, 20, 250).withColumnRenamed(PG.RANK, "position")
    return X.render_dates(page.select("position", *[c for c in page.columns if c != "position"]))


@query("txn_one_company", f"SELECT {_TXN_OUT_SQL} FROM dd_txn WHERE company_id = (SELECT min(company_id) FROM dd_txn)",
       ("dd_txn",))
def txn_one_company(spark, d):
    txn = T.transactions(spark, d)
    first = txn.agg(F.min("company_id")).first()[0]
    return X.render_dates(X.filter_transactions(txn, X.TxnFilter(company_ids=(first,))))


@query("txn_types", """
    SELECT DISTINCT company_id, transaction_type FROM dd_txn
    WHERE transaction_type IS NOT NULL""", ("dd_txn",))
def txn_types(spark, d):
    return X.txn_types(T.transactions(spark, d))


@query("risk_band_counts", """
    SELECT CASE WHEN financial_risk <= 0.5 THEN 'low' WHEN financial_risk <= 0.7 THEN 'medium'
                ELSE 'high' END AS risk_band, CAST(count(*) AS BIGINT) AS txn_rows
    FROM dd_txn WHERE financial_risk IS NOT NULL GROUP BY 1""", ("dd_txn",))
def risk_band_counts(spark, d):
    return X.risk_band_counts(T.transactions(spark, d))


@query("high_risk_summary", """
    WITH day AS (
      SELECT company_id, transaction_date, count(*) AS n, sum(CAST(transaction_amount AS DECIMAL(18,2))) AS amt
      FROM dd_txn GROUP BY ALL
    ),
    hot AS (
      SELECT s.company_id, CASE WHEN day.n IS NULL THEN 1 ELSE day.n END AS n, day.amt
      FROM (SELECT * FROM dd_risk WHERE risk_score > 0.7) s LEFT JOIN day USING (company_id, transaction_date)
    ),
    summed AS (SELECT company_id, sum(n) AS n, sum(amt) AS amt FROM hot GROUP BY company_id)
    SELECT c.company_id, CAST(coalesce(n, 0) AS BIGINT) AS high_risk_dates,
           CAST(coalesce(amt, 0) AS DOUBLE) AS total_high_risk_value
    FROM (SELECT DISTINCT company_id FROM dd_risk) c LEFT JOIN summed USING (company_id)""", ("dd_risk", "dd_txn"))
def high_risk_summary(spark, d):
    return X.high_risk_summary(T.risk_scores(spark, d), T.transactions(spark, d))


@query("risk_trend", """
    SELECT company_id, transaction_date, risk_score FROM dd_risk
    ORDER BY company_id, transaction_date, risk_score""", ("dd_risk",))
def risk_trend(spark, d):
    return X.risk_trend(T.risk_scores(spark, d))


@query("risk_trend_bounds", """
    SELECT company_id, min(transaction_date) AS first_date, max(transaction_date) AS last_date,
           CAST(count(*) AS BIGINT) AS points
    FROM dd_risk GROUP BY company_id""", ("dd_risk",))
def risk_trend_bounds(spark, d):
    return X.risk_trend_bounds(T.risk_scores(spark, d))


@query("scan_normalised", """
    SELECT lower(trim(CAST(company_number AS VARCHAR))) AS company_id,
           trim(company_name) AS company_name, company_status, country
    FROM dd_company""", ("dd_company",))
def scan_normalised(spark, d):
    c = T.companies(spark, d).withColumnRenamed("company_number", "company_id")
    return S.normalise_keys(c, ["company_id"], ["company_name"]).drop("accounts_overdue")


@query("company_profile", """
    SELECT company_number, company_name, CAST(company_number AS VARCHAR) AS registration_number,
           date_of_creation AS incorporation_date,
           concat_ws(', ', nullif(address_line_1, ''), nullif(address_line_2, ''),
                     nullif(locality, ''), nullif(postal_code, ''), nullif(address_country, ''))
             AS registered_address,
           sic_code AS nature_of_business, company_status AS status
    FROM (SELECT DISTINCT ON (company_number) * FROM dd_profile
          ORDER BY company_number, company_name)""", ("dd_profile",))
def company_profile(spark, d):
    prof = P.latest_per_key(T.profiles(spark, d), "company_number", [F.col("company_name")])
    a = F.col("registered_office_address")
    return prof.select(
        "company_number", "company_name",
        F.col("company_number").cast("string").alias("registration_number"),
        F.col("date_of_creation").alias("incorporation_date"),
        join_nonempty(", ", a.address_line_1, a.address_line_2, a.locality, a.postal_code,
                      a.country).alias("registered_address"),
        F.array_join("sic_codes", ", ").alias("nature_of_business"),
        F.col("company_status").alias("status"))


@query("psc_register", """
    SELECT company_number AS company_id, pos AS psc_id, name AS psc_name,
           CAST(dob_month AS VARCHAR) || '/' || CAST(dob_year AS VARCHAR) AS date_of_birth,
           nationality, country_of_residence AS psc_address,
           array_to_string(natures_of_control, ', ') AS control_type
    FROM dd_psc""", ("dd_psc",))
def psc_register(spark, d):
    p = T.pscs(spark, d)
    return p.select(F.col("company_number").alias("company_id"), F.col("pos").alias("psc_id"),
                    F.col("name").alias("psc_name"),
                    F.concat_ws("/", p.date_of_birth.month.cast("string"),
                                p.date_of_birth.year.cast("string")).alias("date_of_birth"),
                    "nationality", F.col("country_of_residence").alias("psc_address"),
                    F.array_join("natures_of_control", ", ").alias("control_type"))


@query("export_roundtrip", f"SELECT {_TXN_OUT_SQL} FROM ({_FILTER_SQL})", ("dd_txn",))
def export_roundtrip(spark, d):
    """S7 + S8: write the filtered page as CSV and JSON to the shared folder, read both back.

    Returns the rows found in both exports (equal to the page when the round trip is lossless).
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports/{uuid.uuid4().hex}"
    page = X.render_dates(_filtered(spark, d))
    S.write_csv(page, f"{base}/csv")
    S.write_json(page, f"{base}/json")
    schema = page.schema
    back_csv = S.read_csv(spark, f"{base}/csv", schema)
    back_json = spark.read.schema(schema).json(f"{base}/json")
    return back_csv.intersectAll(back_json.select(*back_csv.columns))
