"""One company holding a third of all rows: results stay whole and equal to naive formulations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import portfolio as P
from riskloom.operators import scoring as K
from riskloom.operators import transactions as X
from riskloom.operators import views as V

N = 60_000


@pytest.fixture(scope="module")
def txn(spark):
    # company 0 holds a third of the rows; the rest spread over 2,000 companies
    company = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000 + 1)
    return (spark.range(N).select(
        company.cast("long").alias("company_id"),
        F.col("id").cast("string").alias("transaction_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("transaction_date"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("R").alias("transaction_type"),
        F.concat(F.lit("S"), (F.col("id") % 50).cast("string")).alias("sender_account"),
        F.lit("X").alias("recipient_account"),
        (F.col("id") % 1000 / 10.0).alias("transaction_amount"),
        ((F.col("id") % 11) / 10.0).alias("financial_risk"))
        .repartition(6).cache())


def test_newest_n_per_company_with_hot_company(spark, txn):
    out = X.filter_transactions(txn, X.TxnFilter(types=("A",), limit_per_company=5000))
    counts = {r[0]: r[1] for r in out.groupBy("company_id").count().collect()}
    assert counts[0] == 5000                       # hot company capped by the feature, not by skew
    hot = txn.filter((F.col("company_id") == 0) & (F.col("transaction_type") == "A"))
    cutoff = hot.orderBy(F.col("transaction_date").desc()).limit(5000).agg(F.min("transaction_date")).first()[0]
    assert out.filter(F.col("company_id") == 0).agg(F.min("transaction_date")).first()[0] == cutoff
    others = txn.filter((F.col("company_id") != 0) & (F.col("transaction_type") == "A")).count()
    assert sum(v for k, v in counts.items() if k != 0) == others


def test_high_risk_summary_equals_fan_out_join(spark, txn):
    risk = (txn.select("company_id", "transaction_date").distinct()
            .withColumn("risk_score", F.abs(F.hash("company_id", "transaction_date") % 100).cast("double") / 100))
    risk = risk.unionByName(risk.filter(F.col("company_id") == 0))   # duplicated risk rows too
    got = {r[0]: (r[1], r[2]) for r in X.high_risk_summary(risk, txn).collect()}
    hot = (risk.join(txn, ["company_id", "transaction_date"], "left").filter(F.col("risk_score") > 0.7)
           .groupBy("company_id")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("transaction_amount").cast("decimal(18,2)")).alias("v")))
    # a company without hot days is asked for all the same: no rows, and a sum of 0
    naive = (risk.select("company_id").distinct().join(hot, "company_id", "left")
             .select("company_id", F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0)).cast("double")))
    want = {r[0]: (r[1], r[2]) for r in naive.collect()}
    assert got == want and 0 in got


def test_latest_review_and_top_filings_with_hot_company(spark):
    kyc = spark.range(N).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1))
                                .cast("long").alias("company_number"), F.col("id"),
                                F.lit("LOW").alias("risk_tier"))
    latest = {r["company_number"]: r["id"] for r in P.latest_kyc(kyc).collect()}
    assert latest[0] == max(i for i in range(N) if i % 3 == 0)
    assert len(latest) == 501
    fil = kyc.select("company_number", F.col("id").alias("pos"),
                     F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 5000).cast("int"))
                     .cast("string").alias("date"),
                     F.lit("AA").alias("type"), F.lit("d").alias("description"), F.lit("c").alias("category"))
    top = V.filings_top(fil, 15)
    assert top.filter(F.col("company_number") == 0).count() == 15
    assert top.count() == 15 * 501


def test_score_for_company_with_many_officers(spark):
    import datetime as dt
    from riskloom.sources import files as S
    prof = spark.createDataFrame([("big", "Big", "active", "2000-01-01", "ltd", "x", [], None, None),
                                  ("small", "Small", "active", "2000-01-01", "ltd", "x", [], None, None)],
                                 S.PROFILE_JSON)
    off = spark.range(30_000).select(
        F.when(F.col("id") < 29_990, "big").otherwise("small").alias("company_number"),
        F.col("id").alias("pos"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"),
        F.lit("director").alias("officer_role"), F.lit(None).cast("string").alias("appointed_on"),
        F.lit(None).cast("string").alias("resigned_on"),
        F.when(F.col("id") % 1000 == 0, "Iran").otherwise("France").alias("nationality"),
        F.lit(None).cast("string").alias("country_of_residence"))
    psc = spark.createDataFrame([], "company_number string, pos long, name string, nationality string, "
                                    "country_of_residence string, natures_of_control array<string>, "
                                    "date_of_birth struct<month:int,year:int>")
    fil = spark.createDataFrame([("big", 0, "2023-12-01", "AA", "d", "c"), ("small", 0, "2023-12-01", "AA", "d", "c")],
                                "company_number string, pos long, date string, type string, description string, category string")
    leaked = spark.createDataFrame([("p5",), ("P29995",)], "name string")
    flags = K.risk_flags(prof, off, psc, fil, leaked, dt.date(2024, 1, 1))
    per = {r[0]: r[1] for r in flags.groupBy("company_number", "rule").count()
           .filter(F.col("rule") == "K4").select("company_number", "count").collect()}
    assert per["big"] == 30                          # ids 0, 1000, ..., 29000
    scores = {r["company_number"]: r["score"] for r in K.risk_scores(prof, flags).collect()}
    assert scores == {"big": 100, "small": 50}       # small: no PSC 20 + leak 30
