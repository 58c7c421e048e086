"""Ownership graph merging rules, and empty inputs giving empty results with full schemas."""

from __future__ import annotations

import datetime as dt

from riskloom.operators import network as N
from riskloom.operators import portfolio as P
from riskloom.operators import scoring as K
from riskloom.operators import transactions as X
from riskloom.sources import files as S

OFF = ("company_number string, pos long, name string, officer_role string, appointed_on string, "
       "resigned_on string, nationality string, country_of_residence string")
PSC = ("company_number string, pos long, name string, nationality string, country_of_residence string, "
       "natures_of_control array<string>, date_of_birth struct<month:int,year:int>")


def test_nodes_merge_and_styles(spark):
    prof = spark.createDataFrame([("1", "Acme"), ("2", "Solo"), ("3", "Lonely")],
                                 "company_number string, company_name string")
    off = spark.createDataFrame([
        ("1", 0, "Ann", "director", None, None, None, None),
        ("1", 1, "Bob", "secretary", None, None, None, None),
        ("1", 2, "Ann", "chair", None, None, None, None),       # same name twice: later role wins
        ("2", 0, "Solo", "director", None, None, None, None),   # party named like the company
    ], OFF)
    psc = spark.createDataFrame([("1", 0, "Bob", None, None, ["ownership-of-shares-75-to-100-percent"], None)], PSC)
    leaked = spark.createDataFrame([(" bob ",)], "name string")
    nodes = {(r["company_number"], r["name"]): r for r in N.ownership_nodes(prof, off, psc, leaked).collect()}
    assert set(nodes) == {("1", "Acme"), ("1", "Ann"), ("1", "Bob")}   # 2 and 3 have < 2 nodes
    assert nodes[("1", "Ann")]["role"] == "chair" and nodes[("1", "Ann")]["node_type"] == "officer"
    bob = nodes[("1", "Bob")]
    assert (bob["node_type"], bob["role"], bob["noc"], bob["leak_hit"]) == \
        ("psc", "secretary", "ownership-of-shares-75-to-100-percent", True)
    assert (bob["node_class"], bob["node_size"], bob["symbol"]) == ("leak", 20, "star")
    acme = nodes[("1", "Acme")]
    assert (acme["node_class"], acme["node_size"], acme["symbol"], acme["leak_hit"]) == \
        ("company", 24, "square", False)
    edges = sorted((r["source"], r["target"]) for r in N.ownership_edges(prof, off, psc).collect())
    assert edges == [("Acme", "Ann"), ("Acme", "Bob")]


def test_empty_inputs_keep_schema(spark):
    kyc = spark.createDataFrame([], "id long, company_number long, risk_tier string, risk_score int, "
                                    "leak_hit boolean, status string")
    comp = spark.createDataFrame([], "company_number long, company_name string, company_status string, "
                                     "country string, accounts_overdue boolean")
    out = P.portfolio_latest(comp, kyc)
    assert out.count() == 0 and len(out.columns) == 7
    assert P.filing_compliance(comp).collect()[0]["overdue"] is None
    txn = spark.createDataFrame([], S.TRANSACTIONS_CSV)
    f = X.filter_transactions(txn, X.TxnFilter(risk="high"))
    assert f.count() == 0 and tuple(f.columns) == X.TXN_COLUMNS
    prof = spark.createDataFrame([], S.PROFILE_JSON)
    off = spark.createDataFrame([], OFF)
    psc = spark.createDataFrame([], PSC)
    fil = spark.createDataFrame([], "company_number string, pos long, date string, type string, "
                                    "description string, category string")
    leaked = spark.createDataFrame([], "name string")
    flags = K.risk_flags(prof, off, psc, fil, leaked, dt.date(2024, 1, 1))
    assert flags.count() == 0
    assert K.risk_scores(prof, flags).count() == 0


def test_empty_and_tiny_inputs_to_learners(spark):
    from riskloom.operators.anomaly.autoencoder import autoencoder_flags
    from riskloom.operators.anomaly.isolation import isolation_flags
    from riskloom.operators.anomaly.scale import minmax_scale
    schema = "id long, amount double, balance double, frequency double"
    e = spark.createDataFrame([], schema)
    assert isolation_flags(e).count() == 0
    assert autoencoder_flags(minmax_scale(e)).count() == 0
    one = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], schema)
    assert isolation_flags(one).count() == 1
    assert autoencoder_flags(minmax_scale(one)).count() == 1
