"""Prefix sums over range-sorted rows, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.store import stored


def running_totals(df: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add column ``name``: the sum of ``value`` over the group's earlier rows in ``order``.

    Rows are range-sorted by (groups, order), so that a large group spans many
    partitions. Each partition sums its own pieces; the pieces' totals, at most
    one row for each partition and group, are summed into offsets and joined
    back. ``groups`` must not be null. Without groups all rows are one sequence.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *groups, *order)
                    .withColumn("__part", F.spark_partition_id()), "ranged")
    keys = ["__part", *groups]
    before = F.coalesce(F.sum(value).over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = ranged.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    offset = F.coalesce(F.sum("__sum").over(
        Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.withColumn("__offset", offset).drop("__sum")
    return (ranged.withColumn(name, before).join(offsets, keys)
            .withColumn(name, F.col(name) + F.col("__offset")).drop("__part", "__offset"))
