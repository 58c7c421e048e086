"""Write a k-times larger copy of a driver data folder for scaling rehearsals.

Fact tables (customer, orders, lineitem, documents, labels, conversations,
events) are replicated k times with their keys shifted so joins stay
consistent; dimension tables (region, nation, supplier, part, benchmark,
pages, embeddings) are copied once. Usage:

    python tools/scale_copy.py SRC_DIR DST_DIR K
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from riskloom.session import local_session  # noqa: E402

SHIFT = {  # table -> key columns shifted by copy * (max + 1) of the named domain
    "customer": {"c_custkey": "cust"},
    "orders": {"o_orderkey": "order", "o_custkey": "cust"},
    "lineitem": {"l_orderkey": "order"},
    "documents": {"doc_id": "doc"},
    "labels": {"doc_id": "doc"},
    "conversations": {"conv_id": "conv"},
    "events": {"event_id": "event"},
}
DOMAIN = {"cust": ("customer", "c_custkey"), "order": ("orders", "o_orderkey"),
          "doc": ("documents", "doc_id"), "conv": ("conversations", "conv_id"),
          "event": ("events", "event_id")}


def main() -> None:
    src, dst, k = sys.argv[1], sys.argv[2], int(sys.argv[3])
    spark = local_session(app="scale-copy")
    span = {d: spark.read.parquet(f"{src}/{t}.parquet").agg(F.max(c)).first()[0] + 1
            for d, (t, c) in DOMAIN.items()}
    for name in ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split():
        df = spark.read.parquet(f"{src}/{name}.parquet")
        if name in SHIFT:
            # k is a small constant: explode the copy number instead of joining
            df = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            for col, dom in SHIFT[name].items():
                df = df.withColumn(col, (F.col(col) + F.col("_copy") * F.lit(span[dom])).cast(df.schema[col].dataType))
            df = df.drop("_copy")
        df.write.mode("overwrite").parquet(f"{dst}/{name}.parquet")
        print(name, spark.read.parquet(f"{dst}/{name}.parquet").count())


if __name__ == "__main__":
    main()
