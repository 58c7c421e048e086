"""Hand-made rows for the high-risk summary; plain SQL over the registered views."""

from __future__ import annotations

from conftest import SF_SMALL
from riskloom.operators import transactions as X
from riskloom.sources.views import register_testdata_views


def test_high_risk_summary_counts_days_and_transactions(spark):
    risk = spark.createDataFrame([("a", "2024-01-01", 0.9), ("a", "2024-01-02", 0.8), ("a", "2024-01-03", 0.1),
                                  ("b", "2024-01-01", 0.95), ("c", "2024-01-01", 0.2)],
                                 "company_id string, transaction_date string, risk_score double")
    txn = spark.createDataFrame([("a", "2024-01-01", 10.0), ("a", "2024-01-01", 2.5), ("a", "2024-01-01", 1.5),
                                 ("a", "2024-01-03", 99.0), ("b", "2024-01-01", 7.0), ("c", "2024-01-01", 5.0)],
                                "company_id string, transaction_date string, transaction_amount double")
    got = sorted(map(tuple, X.high_risk_summary(risk, txn).collect()))
    # a: three transactions on one day and a day without any; c: no day above the threshold
    assert got == [("a", 4, 14.0), ("b", 1, 7.0), ("c", 0, 0.0)]


def test_views_are_queryable(spark):
    register_testdata_views(spark, SF_SMALL)
    posts = spark.sql("SELECT post_id, sentiment_score FROM social_media")
    assert posts.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert posts.filter("sentiment_score < 0 OR sentiment_score > 1").count() == 0
    assert spark.sql("SELECT DISTINCT transaction_type FROM transactions ORDER BY 1").count() == 3
