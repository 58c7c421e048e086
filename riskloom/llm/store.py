"""Tables between the steps of an operator, written to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in files of ``file_rows`` at most if given, and read it back.

    Cuts the lineage: a lost executor costs at most the running tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write = df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write
    write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        files = df.inputFiles()
        if not files:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        if "/llm-" in str(path):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
