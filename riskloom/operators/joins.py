"""Joins whose small side is broadcast only after its size has been measured.

``join_bounded(big, small, ...)`` writes ``small`` once to the shared
checkpoint folder, measures it there, and broadcasts it when it is under the
limit, so the big side (for example every post's full text) is streamed
without a shuffle. Beyond the limit the join is an ordinary shuffle join.
Nothing stays in the cache: the written rows go when the frame is no longer
referenced (``spark.cleaner.referenceTracking.cleanCheckpoints``).
The limit is ``riskloom.broadcast.maxBytes`` from the session (default 256 MB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import cut_lineage

DEFAULT_LIMIT = 256 * 1024 * 1024


def _row_bytes(df: DataFrame) -> Column:
    """Approximate in-memory size of a row: strings by length, other fields 8 bytes."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 8)
        else:
            parts.append(F.lit(8))
    e = F.lit(16)
    for p in parts:
        e = e + p
    return e


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("riskloom.broadcast.maxBytes", str(DEFAULT_LIMIT)))


def measured_bytes(df: DataFrame) -> int:
    return int(df.agg(F.sum(_row_bytes(df))).first()[0] or 0)


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 limit_bytes: int | None = None) -> DataFrame:
    """``big.join(small, on, how)``, broadcasting ``small`` only when measured under the limit."""
    limit = broadcast_limit(big) if limit_bytes is None else limit_bytes
    stored = cut_lineage(small)
    return big.join(F.broadcast(stored) if measured_bytes(stored) <= limit else stored, on, how)
