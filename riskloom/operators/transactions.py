"""Transaction filtering and summaries.

Scale notes
-----------
* Filters are plain Column predicates over the scan, so comparisons reach the
  Parquet reader as pushed filters; values are bound as literals, never spliced
  into SQL text.
* "Newest N per company" is ``row_number() <= N`` → ``WindowGroupLimit``: each
  map task keeps at most N rows per company before the shuffle, so a company
  holding a third of all rows still ships at most N rows per task.
* The high-risk summary pre-aggregates transactions per (company, date) before
  joining the risk rows, so the join is 1:1 on aggregated keys instead of
  multiplying rows; counts still follow the left-join fan-out exactly.
* Money is summed as DECIMAL(18,2): exact, and independent of summation order.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.bands import HIGH_RISK_THRESHOLD, risk_band, risk_band_predicate
from riskloom.functions.text import money_label

TXN_COLUMNS = ("transaction_date", "transaction_type", "company_id", "sender_account",
               "recipient_account", "transaction_amount", "transaction_id", "financial_risk")

MONEY = "decimal(18,2)"


def money_sum(c: Column) -> Column:
    """Exact sum of money amounts, returned as double."""
    return F.sum(c.cast(MONEY)).cast("double")


@dataclass(frozen=True)
class TxnFilter:
    """Transaction filter; unset fields do not filter."""
    company_ids: tuple | None = None
    start: dt.date | str | None = None        # inclusive
    end: dt.date | str | None = None          # inclusive, whole day
    sender: str | None = None                 # case-insensitive contains
    sender_wildcards: bool = False            # True: % and _ act as LIKE wildcards
    types: tuple[str, ...] | None = None
    risk: str | None = None                   # 'low' | 'medium' | 'high'
    limit_per_company: int | None = None      # newest first; None: every matching row
    extra: tuple = field(default_factory=tuple)


def _as_date(v) -> Column:
    return F.lit(v).cast("date") if isinstance(v, str) else F.lit(v)


def txn_predicates(f: TxnFilter) -> list[Column]:
    preds: list[Column] = []
    if f.company_ids:
        preds.append(F.col("company_id").isin(list(f.company_ids)))
    # compare as DATE: a timestamp '<= day' would drop the rest of that day
    d = F.col("transaction_date").cast("date")
    if f.start:
        preds.append(d >= _as_date(f.start))
    if f.end:
        preds.append(d <= _as_date(f.end))
    if f.sender:
        s = F.lower(F.col("sender_account"))
        if f.sender_wildcards:
            preds.append(s.like("%" + f.sender.lower() + "%"))
        else:
            preds.append(s.contains(f.sender.lower()))
    if f.types:
        preds.append(F.col("transaction_type").isin(list(f.types)))
    if f.risk:
        preds.append(risk_band_predicate(F.col("financial_risk"), f.risk))
    preds.extend(f.extra)
    return preds


def filter_transactions(txn: DataFrame, f: TxnFilter) -> DataFrame:
    """Every matching row; O1: with ``limit_per_company`` only the newest of each company."""
    preds = txn_predicates(f)
    out = txn.filter(reduce(lambda a, b: a & b, preds)) if preds else txn
    out = out.select(*TXN_COLUMNS)
    if f.limit_per_company is not None:
        w = Window.partitionBy("company_id").orderBy(
            F.col("transaction_date").desc(), F.col("transaction_id").desc(),
            F.col("transaction_amount").desc())
        out = (out.withColumn("_rn", F.row_number().over(w))
               .filter(F.col("_rn") <= f.limit_per_company).drop("_rn"))
    return out


def render_dates(txn: DataFrame) -> DataFrame:
    """Dates rendered ``yyyy-MM-dd``."""
    return txn.withColumn("transaction_date",
                          F.date_format(F.col("transaction_date").cast("date"), "yyyy-MM-dd"))


def filter_summary(filtered: DataFrame) -> DataFrame:
    """G6 per company: rows shown, total amount (also as ``$1,234.56``), rows above the high-risk line."""
    return (filtered.groupBy("company_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("txn_rows"),
        money_sum(F.col("transaction_amount")).alias("total_amount"),
        F.count_if(F.col("financial_risk") > HIGH_RISK_THRESHOLD).cast("bigint").alias("high_risk_rows"))
        .withColumn("total_amount_label", money_label(F.col("total_amount"))))


def txn_types(txn: DataFrame) -> DataFrame:
    """G8 + F10: distinct non-null transaction types per company."""
    return (txn.filter(F.col("transaction_type").isNotNull())
            .select("company_id", "transaction_type").distinct())


def risk_band_counts(txn: DataFrame) -> DataFrame:
    """Rows per financial-risk band (NULL risk has no band)."""
    return (txn.select(risk_band(F.col("financial_risk")).alias("risk_band"))
            .filter(F.col("risk_band").isNotNull())
            .groupBy("risk_band").agg(F.count(F.lit(1)).cast("bigint").alias("txn_rows")))


def high_risk_summary(risk: DataFrame, txn: DataFrame,
                      threshold: float = HIGH_RISK_THRESHOLD) -> DataFrame:
    """J2 + G1 + F12 per company.

    Same result as ``risk r LEFT JOIN txn t ON (company, date) WHERE r.score >
    threshold`` then ``COUNT(*)`` and ``COALESCE(SUM(amount), 0)``: a risk row
    with k matching transactions counts k times, with none it counts once.
    A company without a day above the threshold has 0 and 0.0.
    """
    per_day = (txn.groupBy("company_id", "transaction_date")
               .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("transaction_amount").cast(MONEY)).alias("amt")))
    # days below the threshold meet no transactions; they keep their company in the result
    hot = F.col("risk_score") > threshold
    days = risk.select("company_id", F.when(hot, F.col("transaction_date")).alias("transaction_date"),
                       F.coalesce(hot, F.lit(False)).alias("hot"))
    j = days.join(per_day, ["company_id", "transaction_date"], "left")
    return j.groupBy("company_id").agg(
        F.sum(F.when(F.col("hot"), F.coalesce(F.col("n"), F.lit(1))).otherwise(0)).cast("bigint").alias("high_risk_dates"),
        F.coalesce(F.sum("amt"), F.lit(0).cast(MONEY)).cast("double").alias("total_high_risk_value"))


def risk_trend(risk: DataFrame) -> DataFrame:
    """O3: each company's risk series in date order.

    A global sort range-partitions on (company, date), so one huge company is
    split across tasks by date instead of landing in one task.
    """
    return (risk.select("company_id", F.col("transaction_date").cast("date").alias("transaction_date"),
                        "risk_score")
            .orderBy("company_id", "transaction_date", "risk_score"))


def risk_trend_bounds(risk: DataFrame) -> DataFrame:
    """First and last date of each company's series, with its length."""
    return risk.groupBy("company_id").agg(
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
        F.count(F.lit(1)).cast("bigint").alias("points"))
