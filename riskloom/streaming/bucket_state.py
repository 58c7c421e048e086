"""One row per key, kept in hash buckets, with counts kept as signed differences.

A table is a set of buckets of keys. Each batch brings new rows for some keys
and rewrites only the buckets those keys fall into; a manifest names, for every
bucket, the version (batch) whose files hold it, and the counts. The manifest
is one small file (as many entries as buckets and counted values) that appears
by a rename, so readers see either all of a batch or nothing of it.

Counts are never taken again over the table: the rows that a batch replaces go
out with -1 and the rows that it brings come in with +1.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions ``v=N`` under ``path`` (Hadoop FS, so any shared store works)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1]))


@dataclass
class Manifest:
    batch: int = -1
    buckets: int = 0                                   # number of buckets, fixed by the first batch
    where: dict[int, int] = field(default_factory=dict)    # bucket -> version that holds it
    counts: dict[str, dict[str, int]] = field(default_factory=dict)  # measure -> value (JSON) -> rows


class BucketState:
    """A keyed table under ``root/name``.

    ``measures`` maps a name to the column whose values are counted; null values
    are counted too (as null). ``buckets`` counts for a new table only. Rows must
    hold each key once a batch.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, key: str, measures: dict[str, Column],
                 buckets: int = 64, keep: int = 5):
        self.spark, self.key, self.measures, self.new_buckets, self.keep = spark, key, measures, buckets, keep
        self.data, self.manifests = f"{root}/{name}", f"{root}/{name}-manifest"

    def _read_manifest(self, batch: int) -> Manifest:
        fs, p = _fs(self.spark, f"{self.manifests}/{batch:012d}.json")
        stream = fs.open(p)
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(raw)
        return Manifest(got["batch"], got["buckets"], {int(k): v for k, v in got["where"].items()}, got["counts"])

    def batches(self) -> list[int]:
        """Committed batches whose manifests are still there."""
        fs, p = _fs(self.spark, self.manifests)
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self) -> Manifest:
        found = self.batches()
        return self._read_manifest(found[-1]) if found else Manifest()

    def _commit(self, m: Manifest) -> None:
        fs, hidden = _fs(self.spark, f"{self.manifests}/.{m.batch:012d}.json")
        _, final = _fs(self.spark, f"{self.manifests}/{m.batch:012d}.json")
        out = fs.create(hidden, True)
        try:
            out.write(bytearray(json.dumps({"batch": m.batch, "buckets": m.buckets, "where": m.where,
                                            "counts": m.counts}).encode()))
        finally:
            out.close()
        if not fs.rename(hidden, final) and not fs.exists(final):
            raise OSError(f"manifest {final} was not written")

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _rows(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.data}/v={v}/bucket={b}" for b, v in sorted(m.where.items()) if buckets is None or b in buckets]
        return self.spark.read.option("basePath", self.data).parquet(*paths).drop("v", "bucket") if paths else None

    def read(self) -> DataFrame | None:
        """The table as of the last committed batch; None before the first."""
        return self._rows(self.manifest())

    def counts(self, measure: str) -> dict:
        """value -> rows, as of the last committed batch."""
        return {json.loads(k): n for k, n in self.manifest().counts.get(measure, {}).items()}

    def apply(self, batch: int, changed: DataFrame) -> int:
        """Put the rows of ``changed`` in place of those with their keys; returns the number of buckets written.

        A batch that is already committed changes nothing.
        """
        m = self.manifest()
        if batch <= m.batch:
            return 0
        n = m.buckets or self.new_buckets
        changed = changed.withColumn("bucket", self._bucket(n))
        touched = sorted(r[0] for r in changed.select("bucket").distinct().collect())  # at most ``buckets``
        where, counts = dict(m.where), {k: dict(v) for k, v in m.counts.items()}
        if touched:
            old = self._rows(m, touched)
            path = f"{self.data}/v={batch}"
            values = [F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}).alias(k) for k, c in self.measures.items()]
            moved = changed.select(F.lit(1).alias("sign"), *values)
            rows = changed
            if old is not None:
                # a bucket's rows are next to the changed ones by key: one shuffle of the touched buckets
                rest = old.join(changed.select(self.key), self.key, "left_anti")
                rows = rest.withColumn("bucket", self._bucket(n)).unionByName(changed)
                gone = old.join(changed.select(self.key), self.key, "left_semi").select(F.lit(-1).alias("sign"), *values)
                moved = moved.unionByName(gone)
            rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            for name in self.measures:
                own = counts.setdefault(name, {})
                for r in moved.groupBy(name).agg(F.sum("sign").alias("n")).where("n <> 0").collect():
                    value = json.dumps(json.loads(r[name])["v"])
                    own[value] = own.get(value, 0) + r["n"]
                    if not own[value]:
                        del own[value]
            where |= {b: batch for b in touched}
        self._commit(Manifest(batch, n, where, counts))
        self._drop_old()
        return len(touched)

    def _drop_old(self) -> None:
        """Delete older manifests and the versions that none of those kept names."""
        found = self.batches()
        kept = found[-self.keep:]
        for b in found[:-self.keep]:
            fs, p = _fs(self.spark, f"{self.manifests}/{b:012d}.json")
            fs.delete(p, False)
        named = {v for b in kept for v in self._read_manifest(b).where.values()}
        for v in versions(self.spark, self.data):
            if v not in named and v <= kept[-1]:
                fs, p = _fs(self.spark, f"{self.data}/v={v}")
                fs.delete(p, True)
