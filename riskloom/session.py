"""Session helpers: a local session for tests/bench and the shared checkpoint dir."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "riskloom") -> SparkSession:
    """Session for tests and the local benchmark.

    On a cluster the session comes from the launcher; only the knobs that
    matter for correctness (UTC, AQE) are set here, and the UI stays off.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("RISKLOOM_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint dir, setting a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
    it is never overridden. Only local test sessions get a fresh scratch dir.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def _executors_import_package(sc) -> bool:
    """One tiny job: can executor Python workers import this package already?"""
    try:
        return bool(sc.parallelize([0], 1).map(
            lambda _: __import__("importlib.util", fromlist=["find_spec"]).find_spec("riskloom") is not None
        ).first())
    except Exception:  # noqa: BLE001 - a failing probe means "not importable"
        return False


def ship_package(spark: SparkSession) -> None:
    """Make ``riskloom`` importable in executor Python workers (once per application).

    Operators that run Python on executors (isolation forest, autoencoder)
    pickle references to this package's functions. A deployed cluster has the
    package already (installed, or passed with ``--py-files``); then nothing
    is done. Otherwise the package is zipped on the driver and added with
    ``addPyFile``, the runtime form of ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if _executors_import_package(sc):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="riskloom-pyfiles-"), "riskloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
