"""Register the domain tables as temp views for users who write Spark SQL.

``register_views`` publishes DataFrames under the view names an analyst's
SQL uses (``companies``, ``psc``, ``transactions``, ``risk_scores``,
``social_media``); the posts view carries ``sentiment_score`` (the
enrichment is computed once and the view re-registered, as the dashboard
did). ``register_testdata_views`` does it for the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.sentiment import with_sentiment
from riskloom.sources import testdata as T


def register_views(spark: SparkSession, tables: dict[str, DataFrame], enrich_posts: bool = True) -> dict[str, DataFrame]:
    out = dict(tables)
    if enrich_posts and "social_media" in out and "sentiment_score" not in out["social_media"].columns:
        out["social_media"] = with_sentiment(out["social_media"])
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def register_testdata_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Domain views over the driver tables; ``company_id`` keys everywhere, names on posts' side."""
    companies = T.companies(spark, sf_dir).withColumnRenamed("company_number", "company_id")
    psc = T.pscs(spark, sf_dir).select(
        F.col("company_number").alias("company_id"), F.col("pos").alias("psc_id"),
        F.col("name").alias("psc_name"), "nationality",
        F.col("country_of_residence").alias("psc_address"),
        F.array_join("natures_of_control", ", ").alias("control_type"))
    return register_views(spark, {
        "companies": companies,
        "psc": psc,
        "transactions": T.transactions(spark, sf_dir),
        "risk_scores": T.risk_scores(spark, sf_dir),
        "social_media": T.posts(spark, sf_dir),
        "kyc_status": T.kyc_status(spark, sf_dir),
    })
