"""Pages of a sorted table by rank (O6), for tables of any length.

``offset`` gathers and drops every earlier row for each late page. Here the
table is sorted once into range pieces, the pieces are counted, and the running
sum of the counts gives every row its rank. Rows are written in blocks of
``block_rows`` consecutive ranks, a folder each, so a page reads the one or two
blocks (for pages no longer than a block) that hold its ranks, wherever it stands.

The sort is one range exchange. A row's place in its piece comes from the task
that sorted it, in the same checkpointed job, so no second exchange and no
window over a piece is needed. Only the counts, a row per piece, are summed in
one task: one row for about ``block_rows`` rows of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

RANK, BLOCK = "__rank", "__block"
_PLACE_BITS = 33   # Spark's monotonically increasing ids: partition above, place in it below


def ranked(df: DataFrame, order: list[Column], piece_rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``__rank``, the row's position from 0 under ``order``.

    Rows that tie keep one arbitrary order among them, the same for every page
    of this result; make ``order`` total for pages that agree between runs.
    Nulls stand where ``order`` puts them. No rows: no rows.
    """
    pieces = max(1, -(-df.count() // piece_rows))
    in_order = cut_lineage(df.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
                           .withColumn("__id", F.monotonically_increasing_id()))
    placed = (in_order.withColumn("__piece", F.shiftright("__id", _PLACE_BITS))
              .withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))))
    counts = placed.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (placed.join(starts, "__piece")
            .select(*df.columns, (F.col("__start") + F.col("__place")).alias(RANK)))


def write_pages(df: DataFrame, order: list[Column], path: str, block_rows: int = 1_000_000) -> None:
    """Write ``df`` under ``path`` in blocks of ``block_rows`` consecutive ranks.

    ``path`` is a folder that all executors share. Column names ``__rank`` and
    ``__block`` are taken.
    """
    taken = {RANK, BLOCK} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are used by the pages")
    blocks = ranked(df, order, block_rows).withColumn(BLOCK, F.floor(F.col(RANK) / F.lit(block_rows)).cast("long"))
    blocks.write.mode("overwrite").partitionBy(BLOCK).parquet(path)


def read_page(spark: SparkSession, path: str, size: int = 20, number: int = 0,
              block_rows: int = 1_000_000) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows; ``block_rows`` as written. A page beyond the end is empty.

    The rows are those of the page, with their rank; ``orderBy("__rank")`` shows them in order.
    """
    first, last = number * size, (number + 1) * size - 1
    return (spark.read.parquet(path)
            .where(F.col(BLOCK).between(first // block_rows, last // block_rows))
            .where(F.col(RANK).between(first, last)).drop(BLOCK))
