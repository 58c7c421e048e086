"""Keep the portfolio's KPIs fresh as new rows land: latest KYC review per company, tier and compliance counts (ST1).

Streams: ``readStream`` over a landing folder of KYC rows, and one of company
rows → streaming aggregation to one row per company (the newest review, and the
lowest company row; the state store is partitioned by company) → ``update``
output → ``foreachBatch`` puts the changed companies into a bucketed table
(``bucket_state``).

A batch rewrites only the buckets that its companies fall into and moves the
counts by the difference (old row out, new row in); the manifest that names the
buckets' versions and holds the counts commits both at once. A retried batch
finds itself committed and changes nothing. Production uses
``trigger(processingTime='60 seconds')``; tests use ``availableNow``. With many
companies choose ``buckets`` so that a bucket's rows fit a task easily.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.streaming.bucket_state import BucketState, versions

KYC_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("company_number", T.StringType()),
    T.StructField("risk_tier", T.StringType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("leak_hit", T.BooleanType()),
    T.StructField("status", T.StringType()),
])
_VALUE_COLS = ("id", "risk_tier", "risk_score", "leak_hit", "status")


COMPANY_SCHEMA = T.StructType([
    T.StructField("company_number", T.StringType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("company_status", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("accounts_overdue", T.BooleanType()),
])
_COMPANY_COLS = ("company_name", "company_status", "country", "accounts_overdue")
_versions = versions


def kyc_state(spark: SparkSession, state_dir: str, buckets: int = 64, keep: int = 5) -> BucketState:
    return BucketState(spark, state_dir, "latest", "company_number",
                       {"risk_tier": F.col("risk_tier"), "leak_hit": F.col("leak_hit")}, buckets, keep)


def company_state(spark: SparkSession, state_dir: str, buckets: int = 64, keep: int = 5) -> BucketState:
    return BucketState(spark, state_dir, "companies", "company_number",
                       {"accounts_overdue": F.col("accounts_overdue")}, buckets, keep)


def read_latest(spark: SparkSession, state_dir: str, table: str = "latest") -> DataFrame | None:
    """The ``latest`` review or the ``companies`` row of each company, or the ``tiers`` and their company counts."""
    if table == "tiers":
        counts = kyc_state(spark, state_dir).counts("risk_tier")
        return spark.createDataFrame([(k, n) for k, n in counts.items() if k is not None], "risk_tier string, companies long")
    return (company_state if table == "companies" else kyc_state)(spark, state_dir).read()


def read_kpis(spark: SparkSession, state_dir: str) -> DataFrame:
    """(kpi, value, companies): reviewed companies by tier and leak hit, companies by compliance, and totals.

    Read from the manifests, whose counts follow every batch; nothing is counted here.
    """
    kyc, companies = kyc_state(spark, state_dir), company_state(spark, state_dir)
    tiers, hits, overdue = kyc.counts("risk_tier"), kyc.counts("leak_hit"), companies.counts("accounts_overdue")
    rows = [("risk_tier", k, n) for k, n in tiers.items() if k is not None]
    rows += [("reviewed", "all", sum(tiers.values())), ("reviewed", "leak_hit", hits.get(True, 0)),
             ("accounts", "overdue", overdue.get(True, 0)), ("accounts", "on_track", overdue.get(False, 0)),
             ("accounts", "all", sum(overdue.values()))]
    return spark.createDataFrame(rows, "kpi string, value string, companies long")


def _apply_to(state, columns: tuple[str, ...]):
    def apply(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select("company_number", *[F.col(f"r.{c}").alias(c) for c in columns])
        state(batch.sparkSession).apply(batch_id, changed)
    return apply


def start_company_refresh(spark: SparkSession, landing_dir: str, state_dir: str, checkpoint_dir: str,
                          trigger: dict | None = None, max_files_per_trigger: int | None = None,
                          keep_versions: int = 5, buckets: int = 64) -> StreamingQuery:
    """Start the stream of company rows: one row per company (lowest name, status, country) and compliance counts."""
    reader = spark.readStream.schema(COMPANY_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # NULLs last, as in ``portfolio.dedupe_companies``
    order = F.struct(*[x for c in _COMPANY_COLS for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    lowest = reader.parquet(landing_dir).groupBy("company_number").agg(F.min(order).alias("r"))
    w = (lowest.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir)
         .foreachBatch(_apply_to(lambda s: company_state(s, state_dir, buckets, max(2, keep_versions)), _COMPANY_COLS)))
    return w.trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def start_kyc_refresh(spark: SparkSession, landing_dir: str, state_dir: str, checkpoint_dir: str,
                      trigger: dict | None = None, max_files_per_trigger: int | None = None,
                      keep_versions: int = 5, buckets: int = 64) -> StreamingQuery:
    """Start the refresh stream. ``trigger`` defaults to a 60-second processing-time trigger.

    The newest ``keep_versions`` (at least 2) versions stay, for a retried
    batch and for readers that still hold an older one.
    """
    reader = spark.readStream.schema(KYC_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(landing_dir)
    # a NULL id ranks first, as in the batch query
    order = F.struct(F.col("id").isNull().alias("no_id"), *_VALUE_COLS)
    newest = rows.groupBy("company_number").agg(F.max(order).alias("r"))
    w = (newest.writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint_dir)
         .foreachBatch(_apply_to(lambda s: kyc_state(s, state_dir, buckets, max(2, keep_versions)), _VALUE_COLS)))
    w = w.trigger(**(trigger or {"processingTime": "60 seconds"}))
    return w.start()


def _finish(q: StreamingQuery, timeout_s: int) -> None:
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception():
        raise q.exception()


def run_available(spark: SparkSession, landing_dir: str, state_dir: str, checkpoint_dir: str,
                  max_files_per_trigger: int | None = None, timeout_s: int = 600, buckets: int = 64) -> DataFrame | None:
    """Process everything that has landed, then stop; returns the latest table."""
    _finish(start_kyc_refresh(spark, landing_dir, state_dir, checkpoint_dir, {"availableNow": True},
                              max_files_per_trigger, buckets=buckets), timeout_s)
    return read_latest(spark, state_dir)


def run_available_companies(spark: SparkSession, landing_dir: str, state_dir: str, checkpoint_dir: str,
                            max_files_per_trigger: int | None = None, timeout_s: int = 600,
                            buckets: int = 64) -> DataFrame | None:
    """As ``run_available``, for company rows; returns the table of companies."""
    _finish(start_company_refresh(spark, landing_dir, state_dir, checkpoint_dir, {"availableNow": True},
                                  max_files_per_trigger, buckets=buckets), timeout_s)
    return read_latest(spark, state_dir, "companies")


def land_companies(df: DataFrame, landing_dir: str, files: int = 4, seed: int = 7) -> None:
    """Write company rows to the landing folder as several files."""
    (df.select(*[F.col(f.name).cast(f.dataType) for f in COMPANY_SCHEMA.fields])
     .repartition(files, F.xxhash64(F.col("company_number"), F.col("company_name"), F.lit(seed)))
     .write.mode("append").parquet(landing_dir))


def land(df: DataFrame, landing_dir: str, files: int = 4, seed: int = 7) -> None:
    """Write rows to the landing folder as several files, each company's rows spread over them.

    The flag column may carry its stored name, ``panama_papers_hit``.
    """
    if "leak_hit" not in df.columns:
        df = df.withColumnRenamed("panama_papers_hit", "leak_hit")
    (df.select(*[F.col(f.name).cast(f.dataType) for f in KYC_SCHEMA.fields])
     .repartition(files, F.xxhash64(F.col("id"), F.lit(seed)))
     .write.mode("append").parquet(landing_dir))


__all__ = ["COMPANY_SCHEMA", "KYC_SCHEMA", "start_company_refresh", "start_kyc_refresh", "run_available",
           "run_available_companies", "read_kpis", "read_latest", "land", "land_companies"]
