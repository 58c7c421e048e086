"""Portfolio operators: latest KYC review per company and the portfolio reports.

Scale notes
-----------
* Latest-per-key is ``row_number() == 1`` over the key: Spark plans it as a
  ``WindowGroupLimit`` that keeps one row per key in every map task before the
  shuffle, so a company with a third of all reviews ships one row per task.
* Companies and their latest review are both hash-partitioned on the company
  key, so the left join reuses that partitioning (no third exchange).
* Reports (tier counts, histogram, compliance) are partial aggregations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.bands import risk_tier as tier_of_score
from riskloom.functions.jurisdiction import DEFAULT_LISTS, jurisdiction_risk
from riskloom.functions.text import yes_no


def latest_per_key(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """First row per key under ``order`` (W1/W2/W3). ``order`` must be total for determinism."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def latest_kyc(kyc: DataFrame) -> DataFrame:
    """Newest KYC review per company (largest id; a NULL id sorts first, as DESC does in SQL).

    Equal ids are settled by the other columns, the largest values first, so
    the stream and the batch agree on the same row.
    """
    rest = [F.col(c).desc_nulls_last() for c in ("risk_tier", "risk_score", "leak_hit", "status")
            if c in kyc.columns]
    return latest_per_key(kyc, "company_number", [F.col("id").desc_nulls_first(), *rest])


def dedupe_companies(companies: DataFrame) -> DataFrame:
    """One row per company number; duplicates resolved by lowest name, then status, country."""
    return latest_per_key(companies, "company_number",
                          [F.col("company_name").asc_nulls_last(),
                           F.col("company_status").asc_nulls_last(),
                           F.col("country").asc_nulls_last()])


def portfolio_rows(companies: DataFrame, kyc: DataFrame) -> DataFrame:
    """Every company with its latest KYC review (NULLs when it has none) — J1 + W1.

    The flag column may carry its stored name, ``panama_papers_hit``.
    """
    if "leak_hit" not in kyc.columns:
        kyc = kyc.withColumnRenamed("panama_papers_hit", "leak_hit")
    k = latest_kyc(kyc).select("company_number", "risk_tier", "risk_score", "leak_hit",
                               F.col("status").alias("kyc_status"))
    c = dedupe_companies(companies).select("company_number", "company_name", "company_status")
    return c.join(k, "company_number", "left")


def portfolio_search(rows: DataFrame, search: str | None = None, tier: str | None = "ALL",
                     leak_only: bool = False) -> DataFrame:
    """Case-insensitive regex over name or number, tier equality, hit-only."""
    preds: list[Column] = []
    if search:
        pat = "(?i)" + search
        preds.append(F.coalesce(F.col("company_name").rlike(pat), F.lit(False))
                     | F.coalesce(F.col("company_number").cast("string").rlike(pat), F.lit(False)))
    if tier and tier != "ALL":
        preds.append(F.col("risk_tier") == F.lit(tier))
    if leak_only:
        preds.append(F.col("leak_hit"))
    return rows.filter(reduce(lambda a, b: a & b, preds)) if preds else rows


def portfolio_display(rows: DataFrame) -> DataFrame:
    """Score NULL -> 0 as int, hit flag -> YES/No, display column order."""
    return rows.select(
        "company_number", "company_name", "company_status", "risk_tier",
        F.coalesce(F.col("risk_score"), F.lit(0)).cast("int").alias("risk_score"),
        yes_no(F.col("leak_hit")).alias("leak_hit"),
        "kyc_status")


def portfolio_latest(companies: DataFrame, kyc: DataFrame) -> DataFrame:
    return portfolio_display(portfolio_rows(companies, kyc))


def company_options(companies: DataFrame) -> DataFrame:
    """W2 + P6: one option per number (lowest name), label ``name (number)``."""
    first = latest_per_key(companies, "company_number", [F.col("company_name").asc_nulls_last()])
    return first.select(
        F.format_string("%s (%s)", F.col("company_name"), F.col("company_number")).alias("label"),
        F.col("company_number").alias("value"))


def tier_distribution(kyc: DataFrame) -> DataFrame:
    """Companies per tier of the latest review (NULL tiers dropped) with share in percent."""
    counts = (latest_kyc(kyc).filter(F.col("risk_tier").isNotNull())
              .groupBy("risk_tier").agg(F.count(F.lit(1)).alias("companies")))
    # tiny (one row per tier): the global window is over at most a handful of rows
    total = F.sum("companies").over(Window.partitionBy())
    return counts.select("risk_tier", F.col("companies").cast("bigint").alias("companies"),
                         F.round(F.col("companies") * 100.0 / total, 4).alias("share_pct"))


def score_histogram(kyc: DataFrame, bins: int = 10, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Fixed-width bins on [lo, hi]; the top edge falls in the last bin."""
    width = (hi - lo) / bins
    s = F.col("risk_score")
    b = F.least(F.floor((s - lo) / width), F.lit(bins - 1)).cast("int")
    return (latest_kyc(kyc).filter(s.isNotNull())
            .groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("companies"))
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_hi"), "companies"))


def filing_compliance(companies: DataFrame) -> DataFrame:
    """G3 over deduplicated companies: NULL overdue flags count in neither bucket."""
    d = dedupe_companies(companies)
    f = F.col("accounts_overdue")
    return d.agg(F.sum(F.when(f, 1).otherwise(0)).cast("bigint").alias("overdue"),
                 F.sum(F.when(~f, 1).otherwise(0)).cast("bigint").alias("on_track"))


def fatf_summary(companies: DataFrame, lists=DEFAULT_LISTS) -> DataFrame:
    """J8 + P21: deduplicated companies whose country is on a screening list."""
    d = dedupe_companies(companies)
    r = jurisdiction_risk(F.col("country"), lists)
    return (d.select("company_number", "company_name", "country", r.alias("_r"))
            .filter(F.col("_r").isNotNull())
            .select("company_number", "company_name", "country",
                    F.col("_r.label").alias("risk_label"), F.col("_r.severity").alias("severity")))


def page(df: DataFrame, order: list[Column], size: int = 20, number: int = 0) -> DataFrame:
    """One page of a sorted table (``order`` should be total for stable pages)."""
    return df.orderBy(*order).offset(number * size).limit(size)


def risk_tier_of(df: DataFrame, score_col: str = "score") -> DataFrame:
    return df.withColumn("tier", tier_of_score(F.col(score_col)))
