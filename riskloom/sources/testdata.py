"""Domain tables derived from the driver's TPC-H-like parquet tables.

The library's operators work on the domain schema (companies, KYC history,
transactions, officers, PSCs, filings, leaked names, posts, features). For the
driver data we derive each domain table from the given tables with Spark, so
every query's work grows with the data. All rows are used: order lines are
officers or PSCs by their quantity; only the leak list is a subset by nature.

``riskloom.plans.oracle_views`` holds the same definitions in DuckDB SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the driver data: the newest order date is the review date.
AS_OF = dt.date(2001, 8, 1)
LARGE_LINE = 25

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _status_of_segment(seg: Column) -> Column:
    return (F.when(seg == "FURNITURE", "dissolved")
            .when(seg == "MACHINERY", "voluntary-arrangement")
            .when(seg == "HOUSEHOLD", "open")
            .otherwise("active"))


def _overdue_of_balance(bal: Column) -> Column:
    # tiny balances: flag unknown (NULL)
    return (F.when(bal < 0, F.lit(True))
            .when(bal < 100, F.lit(None).cast("boolean"))
            .otherwise(F.lit(False)))


def companies(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    n = read(spark, d, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(c.c_custkey.alias("company_number"),
                    c.c_name.alias("company_name"),
                    _status_of_segment(c.c_mktsegment).alias("company_status"),
                    n.n_name.alias("country"),
                    _overdue_of_balance(c.c_acctbal).alias("accounts_overdue")))


def kyc_status(spark: SparkSession, d: str) -> DataFrame:
    """KYC review history: one row per order."""
    o = read(spark, d, "orders")
    score = F.floor(o.o_totalprice / 5000).cast("int")
    return o.select(o.o_orderkey.alias("id"),
                    o.o_custkey.alias("company_number"),
                    F.when(score >= 85, "CRITICAL").when(score >= 60, "HIGH")
                     .when(score >= 35, "MEDIUM").otherwise("LOW").alias("risk_tier"),
                    score.alias("risk_score"),
                    F.when(o.o_orderpriority == "1-URGENT", F.lit(True))
                     .when(o.o_orderpriority == "4-NOT SPECIFIED", F.lit(None).cast("boolean"))
                     .otherwise(F.lit(False)).alias("leak_hit"),
                    F.when(o.o_orderstatus == "F", "approved")
                     .when(o.o_orderstatus == "O", "in-review")
                     .otherwise("pending").alias("status"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    o = read(spark, d, "orders")
    s = read(spark, d, "supplier")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(s, li.l_suppkey == s.s_suppkey)
            .select(o.o_custkey.alias("company_id"),
                    F.concat_ws("-", li.l_orderkey.cast("string"),
                                li.l_linenumber.cast("string")).alias("transaction_id"),
                    F.to_date(o.o_orderdate).alias("transaction_date"),
                    li.l_returnflag.alias("transaction_type"),
                    s.s_name.alias("sender_account"),
                    F.concat(F.lit("ACCT-"), li.l_partkey.cast("string")).alias("recipient_account"),
                    li.l_extendedprice.alias("transaction_amount"),
                    F.round(li.l_discount * 10, 2).alias("financial_risk")))


def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(o.o_custkey.alias("company_id"),
                    F.to_date(o.o_orderdate).alias("transaction_date"),
                    (o.o_totalprice / 500000).alias("risk_score"))


def _parties(spark: SparkSession, d: str, large: bool) -> DataFrame:
    """Suppliers of a customer's large or other order lines: the company's parties.

    A line of LARGE_LINE pieces or more makes its supplier a person with
    significant control, any other an officer, so that every line is used.
    Lines and orders are aggregated per (customer, supplier) first; the
    dimension attributes are joined to that narrower result.
    """
    li = read(spark, d, "lineitem")
    li = li.filter(li.l_quantity >= LARGE_LINE if large else li.l_quantity < LARGE_LINE)
    o = read(spark, d, "orders")
    agg = (li.join(o, li.l_orderkey == o.o_orderkey)
           .groupBy(o.o_custkey.alias("company_number"), li.l_suppkey.alias("s_suppkey"))
           .agg(F.min(o.o_orderkey).alias("pos"),
                F.min(F.to_date(o.o_orderdate)).alias("first_date"),
                F.min(li.l_returnflag).alias("flag"),
                F.min(li.l_linestatus).alias("min_ls"),
                F.max(F.to_date(li.l_shipdate)).alias("last_ship")))
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("company_number"), "c_nationkey")
    sn = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"),
                                         F.col("n_name").alias("nationality"))
    cn = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                         F.col("n_name").alias("country_of_residence"))
    return (agg.join(s, "s_suppkey").join(c, "company_number")
            .join(sn, "s_nationkey").join(cn, "c_nationkey")
            .drop("s_nationkey", "c_nationkey"))


def officers(spark: SparkSession, d: str) -> DataFrame:
    p = _parties(spark, d, large=False)
    return p.select(
        "company_number", "pos",
        F.col("s_name").alias("name"),
        F.when(p.flag == "A", "director").when(p.flag == "N", "secretary")
         .otherwise("llp-designated-member").alias("officer_role"),
        p.first_date.cast("string").alias("appointed_on"),
        F.when(p.min_ls == "F", p.last_ship.cast("string")).alias("resigned_on"),
        "nationality", "country_of_residence")


def pscs(spark: SparkSession, d: str) -> DataFrame:
    p = _parties(spark, d, large=True)
    natures = (F.when(p.s_acctbal > 9000, F.array(F.lit("ownership-of-shares-75-to-100-percent")))
               .when(p.s_acctbal < 1000, F.array(F.lit("ownership-of-shares-25-to-50-percent"),
                                                 F.lit("significant-influence-or-control")))
               .otherwise(F.array(F.lit("voting-rights-25-to-50-percent"))))
    return p.select(
        "company_number", "pos",
        F.col("s_name").alias("name"),
        "nationality", "country_of_residence",
        natures.alias("natures_of_control"),
        F.struct(F.month(p.first_date).alias("month"),
                 (F.year(p.first_date) - 45).alias("year")).alias("date_of_birth"))


def filings(spark: SparkSession, d: str) -> DataFrame:
    """Filing history: orders, newest first by position."""
    o = read(spark, d, "orders")
    return o.select(o.o_custkey.alias("company_number"),
                    o.o_orderkey.alias("pos"),
                    F.to_date(o.o_orderdate).cast("string").alias("date"),
                    o.o_orderpriority.alias("type"),
                    F.concat(F.lit("order "), o.o_orderkey.cast("string")).alias("description"),
                    F.lower(F.substring(o.o_orderpriority, 3, 100)).alias("category"))


def leaked_names(spark: SparkSession, d: str) -> DataFrame:
    """Leaked-entity names: suppliers with a negative balance, messy case and padding."""
    s = read(spark, d, "supplier").filter(F.col("s_acctbal") < 0)
    return s.select(F.concat(F.lit("  "), F.upper(s.s_name), F.lit(" ")).alias("name"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    n = read(spark, d, "nation")
    days = (F.floor(F.abs(c.c_acctbal) * 7).cast("int") % 3650)
    created = (F.when(c.c_acctbal.between(0, 100), F.lit("not-a-date"))
               .otherwise(F.date_sub(F.lit(AS_OF), days).cast("string")))
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(c.c_custkey.alias("company_number"),
                    c.c_name.alias("company_name"),
                    _status_of_segment(c.c_mktsegment).alias("company_status"),
                    created.alias("date_of_creation"),
                    F.lit("ltd").alias("type"),
                    F.lit("england-wales").alias("jurisdiction"),
                    F.array((F.lit(10000) + c.c_nationkey * 100).cast("string")).alias("sic_codes"),
                    F.struct(F.concat(c.c_name, F.lit(" House")).alias("address_line_1"),
                             F.lit("").alias("address_line_2"),
                             F.concat(F.lit("City "), c.c_nationkey.cast("string")).alias("locality"),
                             F.concat(F.lit("PC"), c.c_custkey.cast("string")).alias("postal_code"),
                             n.n_name.alias("country")).alias("registered_office_address"),
                    F.struct(_overdue_of_balance(c.c_acctbal).alias("overdue"),
                             F.date_add(F.lit(AS_OF), 30).cast("string").alias("next_due"))
                    .alias("accounts")))


def posts(spark: SparkSession, d: str) -> DataFrame:
    """Social posts: documents; doc_id order stands in for posting time."""
    doc = read(spark, d, "documents")
    return doc.select(doc.doc_id.alias("post_id"), doc.source.alias("platform"),
                      doc.text.alias("post_content"),
                      F.timestamp_seconds(F.lit(1704067200) + doc.doc_id * 60).alias("timestamp"))


def mention_names(spark: SparkSession, d: str) -> DataFrame:
    """Names searched for in posts: the benchmark passages."""
    b = read(spark, d, "benchmark")
    return b.select(b.item_id.alias("company_id"), b.text.alias("company_name"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Per-customer transaction features for the anomaly detectors."""
    c = read(spark, d, "customer")
    o = read(spark, d, "orders")
    # exact decimal sum: the result does not depend on summation order
    agg = o.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
                                     .cast("double").alias("amount"),
                                     F.count(F.lit(1)).cast("double").alias("frequency"))
    return (c.join(agg, c.c_custkey == agg.o_custkey)
            .select(c.c_custkey.alias("id"), agg.amount,
                    c.c_acctbal.alias("balance"), agg.frequency))
