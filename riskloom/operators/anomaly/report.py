"""Anomaly report and overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The report's money format.
MONEY_FORMAT = "%.2f €"

METHOD_COLUMNS = {"isolation": "iforest_flag", "autoencoder": "ae_flag", "density": "dbscan_flag"}


def anomaly_report(flagged: DataFrame, method: str, id_col: str = "id") -> DataFrame:
    """M6 + F11 + P15: flagged rows of one method with money formatted ``x.xx €`` and the
    frequency rounded half-even to an integer."""
    flag = METHOD_COLUMNS[method]
    return (flagged.filter(F.col(flag) == 1)
            .select(F.col(id_col).alias("index"),
                    F.format_string(MONEY_FORMAT, F.col("amount")).alias("transaction_amount"),
                    F.format_string(MONEY_FORMAT, F.col("balance")).alias("account_balance"),
                    F.bround(F.col("frequency"), 0).cast("long").alias("transaction_frequency")))


def anomaly_overview(flagged: DataFrame, cols=("amount", "balance", "frequency")) -> DataFrame:
    """M7: per method and flag value, row count and min / mean / max of every feature."""
    parts = []
    for method, flag in METHOD_COLUMNS.items():
        if flag not in flagged.columns:
            continue
        aggs = [F.count(F.lit(1)).cast("bigint").alias("rows")]
        for c in cols:
            aggs += [F.round(F.min(c), 6).alias(f"min_{c}"), F.round(F.avg(c), 6).alias(f"avg_{c}"),
                     F.round(F.max(c), 6).alias(f"max_{c}")]
        parts.append(flagged.groupBy(F.col(flag).cast("int").alias("flag")).agg(*aggs)
                     .withColumn("method", F.lit(method)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("method", "flag", *[c for c in out.columns if c not in ("method", "flag")])


def shuffle_rows(df: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """A repeatable random row order (hash of id and seed), independent of partitioning."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col))
