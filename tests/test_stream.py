"""The streamed latest-review table equals the batch computation, batch after batch."""

from __future__ import annotations

import tempfile

from riskloom.operators.portfolio import latest_kyc
from riskloom.streaming import kyc_refresh as ST


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="riskloom-stream-", dir="/tmp")
    first = [(1, "SC10", "LOW", 5, False, "a"), (2, "SC10", "HIGH", 70, True, "b"), (3, "SC11", None, None, None, "c")]
    second = [(4, "SC10", "MEDIUM", 40, None, "d"), (5, "00012345", "CRITICAL", 99, True, "e"),
              (5, "00012345", "CRITICAL", 99, None, "e"), (None, "NI000777", "LOW", 3, None, "f"),
              (7, "NI000777", "HIGH", 71, None, "g"), (0, "SC11", "LOW", 1, False, "old")]
    schema = ST.KYC_SCHEMA
    ST.land(spark.createDataFrame(first, schema), f"{base}/landing", files=2)
    got1 = ST.run_available(spark, f"{base}/landing", f"{base}/state", f"{base}/ckpt", max_files_per_trigger=1)
    want1 = latest_kyc(spark.createDataFrame(first, schema))
    assert sorted(map(tuple, got1.select(*want1.columns).collect()), key=str) == sorted(map(tuple, want1.collect()), key=str)
    ST.land(spark.createDataFrame(second, schema), f"{base}/landing", files=2)
    got2 = ST.run_available(spark, f"{base}/landing", f"{base}/state", f"{base}/ckpt", max_files_per_trigger=1)
    want2 = latest_kyc(spark.createDataFrame(first + second, schema))
    assert sorted(map(tuple, got2.select(*want2.columns).collect()), key=str) == sorted(map(tuple, want2.collect()), key=str)
    tiers = {r["risk_tier"]: r["companies"] for r in ST.read_latest(spark, f"{base}/state", "tiers").collect()}
    assert tiers == {"MEDIUM": 1, "CRITICAL": 1, "LOW": 1}
    # old versions go
    assert len(ST._versions(spark, f"{base}/state/latest")) <= 5


def test_processing_time_trigger_picks_up_new_files(spark):
    """The production path: a running stream with a processing-time trigger sees files landing."""
    import time
    base = tempfile.mkdtemp(prefix="riskloom-stream-", dir="/tmp")
    schema = ST.KYC_SCHEMA
    ST.land(spark.createDataFrame([(1, "SC10", "LOW", 5, False, "a")], schema), f"{base}/landing", files=1)
    q = ST.start_kyc_refresh(spark, f"{base}/landing", f"{base}/state", f"{base}/ckpt",
                             trigger={"processingTime": "1 second"})
    try:
        deadline = time.time() + 120

        def latest_ids():
            df = ST.read_latest(spark, f"{base}/state")
            return set() if df is None else {r["id"] for r in df.collect()}

        while time.time() < deadline and latest_ids() != {1}:
            time.sleep(1)
        assert latest_ids() == {1}
        ST.land(spark.createDataFrame([(2, "SC10", "HIGH", 70, True, "b"), (3, "SC11", "LOW", 1, False, "c")], schema),
                f"{base}/landing", files=1)
        while time.time() < deadline and latest_ids() != {2, 3}:
            time.sleep(1)
        assert latest_ids() == {2, 3}
    finally:
        q.stop()


def test_counts_follow_every_batch(spark):
    """After each batch the counts equal a recount, only touched buckets are written, and a retry changes nothing."""
    from pyspark.sql import functions as F

    from riskloom.streaming.bucket_state import versions
    base = tempfile.mkdtemp(prefix="riskloom-stream-", dir="/tmp")
    state = ST.kyc_state(spark, base, buckets=32, keep=3)
    assert state.read() is None and state.counts("risk_tier") == {}
    now = {}
    for batch in range(6):
        keys = range(0, 200) if batch == 0 else range(batch * 3, batch * 3 + 2)
        rows = [(batch * 1000 + k, f"C{k}", [None, "LOW", "HIGH"][(k + batch) % 3], k, [None, True, False][(k * batch) % 3], "s")
                for k in keys]
        changed = spark.createDataFrame(rows, ST.KYC_SCHEMA)
        before = state.manifest()
        written = state.apply(batch, changed)
        now |= {r[1]: r for r in rows}
        assert {tuple(r) for r in state.read().select([f.name for f in ST.KYC_SCHEMA]).collect()} == set(now.values())
        for measure, at in (("risk_tier", 2), ("leak_hit", 4)):
            want = {}
            for r in now.values():
                want[r[at]] = want.get(r[at], 0) + 1
            assert state.counts(measure) == want
        after = state.manifest()
        touched = {k for k, v in after.where.items() if v == batch}
        assert written == len(touched) and (batch == 0 or written <= len(rows))
        assert {k: v for k, v in after.where.items() if k not in touched} == \
            {k: v for k, v in before.where.items() if k not in touched}
        # the batch again, as after a failure between the commit and the checkpoint
        assert state.apply(batch, changed.withColumn("risk_tier", F.lit("WRONG"))) == 0
        assert state.manifest() == after
    assert len(state.batches()) == 3
    held = {v for b in state.batches() for v in state._read_manifest(b).where.values()}
    assert set(versions(spark, f"{base}/latest")) == held and 0 in held


def test_compliance_stream_equals_batch(spark):
    from riskloom.operators.portfolio import dedupe_companies, filing_compliance
    base = tempfile.mkdtemp(prefix="riskloom-stream-", dir="/tmp")
    first = [("1", "b ltd", "active", "x", True), ("2", "c ltd", None, "x", None), ("3", None, "active", None, False)]
    second = [("1", "a ltd", "active", "x", False), ("2", "d ltd", "open", "x", True), ("4", "e", "active", "y", True),
              ("3", "z", "active", "y", True)]
    for part, rows in ((first, first), (second, first + second)):
        ST.land_companies(spark.createDataFrame(part, ST.COMPANY_SCHEMA), f"{base}/landing", files=2)
        got = ST.run_available_companies(spark, f"{base}/landing", f"{base}/state", f"{base}/ckpt", 1, buckets=4)
        batch = spark.createDataFrame(rows, ST.COMPANY_SCHEMA)
        want = dedupe_companies(batch)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        kpis = {(r["kpi"], r["value"]): r["companies"] for r in ST.read_kpis(spark, f"{base}/state").collect()}
        counts = filing_compliance(batch).first()
        assert kpis["accounts", "overdue"] == counts["overdue"] and kpis["accounts", "on_track"] == counts["on_track"]
        assert kpis["accounts", "all"] == want.count() and kpis["reviewed", "all"] == 0
