"""Edge cases of the transaction filter and the portfolio operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import portfolio as P
from riskloom.operators import transactions as X

TXN = ("company_id string, transaction_id string, transaction_date timestamp, transaction_type string, "
       "sender_account string, recipient_account string, transaction_amount double, financial_risk double")


def _txn(spark):
    ts = dt.datetime
    return spark.createDataFrame([
        ("c1", "t1", ts(2024, 1, 31, 18, 30), "A", "Big_Bank", "x", 10.0, 0.5),
        ("c1", "t2", ts(2024, 1, 1, 0, 0), "R", "bigXbank", "x", 20.0, 0.7),
        ("c1", "t3", ts(2024, 2, 1, 0, 0), "A", "50% off", "x", 30.0, 0.71),
        ("c1", "t4", ts(2023, 12, 31, 23, 59), "N", None, "x", 40.0, None),
        ("c2", "t5", ts(2024, 1, 15, 12, 0), "A", "Other", "x", 50.0, 0.0),
    ], TXN)


def ids(df):
    return sorted(r["transaction_id"] for r in df.collect())


def test_date_bounds_are_inclusive_whole_days(spark):
    f = X.TxnFilter(start="2024-01-01", end="2024-01-31")
    assert ids(X.filter_transactions(_txn(spark), f)) == ["t1", "t2", "t5"]   # 18:30 on the 31st kept


def test_sender_literal_and_wildcard(spark):
    t = _txn(spark)
    assert ids(X.filter_transactions(t, X.TxnFilter(sender="BIG_BANK"))) == ["t1"]
    assert ids(X.filter_transactions(t, X.TxnFilter(sender="big_bank", sender_wildcards=True))) == ["t1", "t2"]
    assert ids(X.filter_transactions(t, X.TxnFilter(sender="50%"))) == ["t3"]


def test_risk_bands_boundaries(spark):
    t = _txn(spark)
    assert ids(X.filter_transactions(t, X.TxnFilter(risk="low"))) == ["t1", "t5"]
    assert ids(X.filter_transactions(t, X.TxnFilter(risk="medium"))) == ["t2"]
    assert ids(X.filter_transactions(t, X.TxnFilter(risk="high"))) == ["t3"]
    counts = {r[0]: r[1] for r in X.risk_band_counts(t).collect()}
    assert counts == {"low": 2, "medium": 1, "high": 1}


def test_company_and_type_filters_and_limit(spark):
    t = _txn(spark)
    f = X.TxnFilter(company_ids=("c1",), types=("A", "R"), limit_per_company=2)
    assert ids(X.filter_transactions(t, f)) == ["t1", "t3"]   # newest two of c1


def test_summary_and_types(spark):
    t = _txn(spark)
    s = {r["company_id"]: (r["txn_rows"], r["total_amount"], r["high_risk_rows"])
         for r in X.filter_summary(X.filter_transactions(t, X.TxnFilter())).collect()}
    assert s == {"c1": (4, 100.0, 1), "c2": (1, 50.0, 0)}
    assert sorted(tuple(r) for r in X.txn_types(t).collect()) == [
        ("c1", "A"), ("c1", "N"), ("c1", "R"), ("c2", "A")]


KYC = "id long, company_number string, risk_tier string, risk_score int, leak_hit boolean, status string"
COMP = "company_number string, company_name string, company_status string, country string, accounts_overdue boolean"


def test_latest_review_null_id_first_and_missing_company(spark):
    kyc = spark.createDataFrame([(1, "a", "LOW", 10, False, "old"), (5, "a", "HIGH", 70, True, "new"),
                                 (None, "b", "CRITICAL", 90, None, "nullid"), (9, "b", "LOW", 1, False, "x")], KYC)
    assert {r["company_number"]: r["status"] for r in P.latest_kyc(kyc).collect()} == {"a": "new", "b": "nullid"}
    comp = spark.createDataFrame([("a", "Alpha", "active", "UK", False), ("a", "Aardvark", "active", "UK", True),
                                  ("c", "Gamma", None, None, None)], COMP)
    rows = {r["company_number"]: r for r in P.portfolio_latest(comp, kyc).collect()}
    assert set(rows) == {"a", "c"}
    assert rows["a"]["company_name"] == "Aardvark"                 # duplicates: lowest name
    assert (rows["a"]["risk_score"], rows["a"]["leak_hit"]) == (70, "YES")
    assert (rows["c"]["risk_score"], rows["c"]["leak_hit"], rows["c"]["risk_tier"]) == (0, "No", None)


def test_search_regex_and_filters(spark):
    kyc = spark.createDataFrame([(1, "001", "HIGH", 70, True, "s"), (2, "002", "LOW", 5, None, "s")], KYC)
    comp = spark.createDataFrame([("001", "Acme Ltd", "active", "UK", False), ("002", None, "active", "UK", False)], COMP)
    rows = P.portfolio_rows(comp, kyc)
    assert [r[0] for r in P.portfolio_search(rows, "^acme").select("company_number").collect()] == ["001"]
    assert [r[0] for r in P.portfolio_search(rows, "2$").select("company_number").collect()] == ["002"]
    assert [r[0] for r in P.portfolio_search(rows, leak_only=True).select("company_number").collect()] == ["001"]
    assert P.portfolio_search(rows, tier="LOW").count() == 1 and P.portfolio_search(rows, tier="ALL").count() == 2


def test_histogram_top_edge_and_compliance_nulls(spark):
    kyc = spark.createDataFrame([(i, f"c{i}", "LOW", s, False, "s") for i, s in enumerate([0, 9, 10, 99, 100])]
                                + [(9, "cn", None, None, None, "s")], KYC)
    hist = {r["bin"]: r["companies"] for r in P.score_histogram(kyc).collect()}
    assert hist == {0: 2, 1: 1, 9: 2}
    comp = spark.createDataFrame([("a", "A", "x", "y", True), ("b", "B", "x", "y", False), ("c", "C", "x", "y", None)], COMP)
    r = P.filing_compliance(comp).first()
    assert (r["overdue"], r["on_track"]) == (1, 1)
    dist = {r["risk_tier"]: (r["companies"], r["share_pct"]) for r in P.tier_distribution(kyc).collect()}
    assert dist == {"LOW": (5, 100.0)}


def test_page(spark):
    df = spark.range(50).select(F.col("id"))
    assert [r[0] for r in P.page(df, [F.col("id").desc()], 20, 1).collect()] == list(range(29, 9, -1))


def test_ranked_pages_equal_a_sort_and_read_few_rows(spark, tmp_path):
    from riskloom.operators import paging as PG
    rows = [(i * 7919 % 5003, None if i % 11 == 0 else i % 3) for i in range(5003)]   # ties and nulls in b
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    order = [F.col("b").desc_nulls_first(), F.col("a")]
    path = str(tmp_path / "pages")
    PG.write_pages(df, order, path, block_rows=400)
    for number in (0, 1, 19, 20, 133, 166):
        got = PG.read_page(spark, path, 30, number, block_rows=400).orderBy(PG.RANK).collect()
        assert [tuple(r)[:2] for r in got] == want[number * 30:(number + 1) * 30]
        assert [r[PG.RANK] for r in got] == list(range(number * 30, min((number + 1) * 30, 5003)))
    assert PG.read_page(spark, path, 30, 10_000, block_rows=400).count() == 0
    # every block but the last holds block_rows rows: a page touches at most two blocks
    sizes = spark.read.parquet(path).groupBy(PG.BLOCK).count().orderBy(PG.BLOCK).collect()
    assert [r["count"] for r in sizes] == [400] * 12 + [203]
    plan = PG.read_page(spark, path, 30, 133, block_rows=400)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "__block" in plan and "Exchange" not in plan


def test_ranked_pages_of_equal_rows_and_no_rows(spark, tmp_path):
    from riskloom.operators import paging as PG
    same = spark.range(1000).select(F.lit(1).alias("a"))
    ranks = [r[PG.RANK] for r in PG.ranked(same, [F.col("a")], piece_rows=100).orderBy(PG.RANK).collect()]
    assert ranks == list(range(1000))
    assert PG.ranked(same.limit(0), [F.col("a")]).count() == 0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(start=st.sampled_from([None, "2023-12-31", "2024-01-15"]),
       end=st.sampled_from([None, "2024-01-01", "2024-01-31"]),
       sender=st.sampled_from([None, "big", "_", "x"]),
       wild=st.booleans(),
       types=st.sampled_from([None, ("A",), ("A", "R")]),
       risk=st.sampled_from([None, "low", "medium", "high"]))
def test_filter_result_is_the_matching_subset(spark, start, end, sender, wild, types, risk):
    import fnmatch
    t = _txn(spark)
    f = X.TxnFilter(start=start, end=end, sender=sender, sender_wildcards=wild, types=types, risk=risk,
                    limit_per_company=None)
    got = set(ids(X.filter_transactions(t, f)))
    want = set()
    for r in t.collect():
        d = r["transaction_date"].date().isoformat()
        s = (r["sender_account"] or None)
        ok = (start is None or d >= start) and (end is None or d <= end)
        if sender is not None:
            if s is None:
                ok = False
            elif wild:
                pat = "*" + sender.lower().replace("%", "*").replace("_", "?") + "*"
                ok = ok and fnmatch.fnmatchcase(s.lower(), pat)
            else:
                ok = ok and sender.lower() in s.lower()
        ok = ok and (types is None or r["transaction_type"] in types)
        fr = r["financial_risk"]
        if risk is not None:
            ok = ok and fr is not None and {"low": fr <= 0.5, "medium": 0.5 < fr <= 0.7, "high": fr > 0.7}[risk]
        if ok:
            want.add(r["transaction_id"])
    assert got == want
    assert got <= {r["transaction_id"] for r in t.collect()}
