"""Party rows are read as few times, and looked up as few times, as their results need."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.jurisdiction import DEFAULT_LISTS
from riskloom.functions.text import strip_ws
from riskloom.operators import scoring as K

OFFICERS = "company_number long, pos long, name string, nationality string, country_of_residence string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_every_unicode_space_without_a_regular_expression(spark):
    chars = [(i, chr(i)) for i in range(1, 0x3100)]
    df = spark.createDataFrame(chars, "i int, c string")
    text = F.concat("c", "c", F.lit("a"), "c", F.lit("b"), "c")
    got = df.select("i", strip_ws(text).alias("new"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("old"))
    assert got.where(~F.col("new").eqNullSafe(F.col("old"))).collect() == []
    assert "regexp" not in plan(df.select(strip_ws(F.col("c"))))


def test_each_term_is_looked_up_once_a_field(spark):
    rows = [(1, 1, "A", " IRAN ", "Panama"), (1, 2, None, None, "Mali"), (2, 3, "C", "France", ""), (2, 4, "D", "nan", None)]
    off = spark.createDataFrame(rows, OFFICERS)
    flags = K.party_jurisdiction_flags(off, "officer")
    got = sorted((r["company_number"], r["pos"], r["flag"], r["severity"], r["points"]) for r in flags.collect())
    assert got == [(1, 1, "Officer A — Nationality:  IRAN  (FATF Black List)", "Critical", 20),
                   (1, 2, "Officer  — Country Of Residence: Mali (FATF Grey List)", "High", 10)]
    # from a table, as rows of a local relation are computed while planning
    text = plan(K.party_jurisdiction_flags(off.repartition(2), "officer"))
    assert text.lower().count("contains(") == 2 * sum(len(x.terms) for x in DEFAULT_LISTS)


def test_hits_are_counted_and_listed_in_one_pass(spark):
    n = K.LEAK_NAMES + 5
    rows = [(1, "officer", i, f"n{i}", True) for i in range(n)] + [(1, "psc", 0, "p", True), (2, "psc", 1, None, True), (3, "psc", 1, "x", False)]
    parties = spark.createDataFrame(rows, "company_number long, party_type string, pos long, name string, leak_hit boolean")
    agg = K.hit_aggregates(parties.repartition(3))
    got = {r["company_number"]: (r["n_hits"], r["hit_names"]) for r in agg.collect()}
    assert got == {1: (n + 1, ", ".join(f"n{i}" for i in range(K.LEAK_NAMES))), 2: (1, "")}
    assert plan(agg).count("Repartition") == 1 and "Join" not in plan(agg)


def test_nodes_are_counted_beside_themselves(spark):
    from riskloom.operators import network as N
    prof = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three"), (None, "None")], "company_number long, company_name string")
    off = spark.createDataFrame([(1, 1, "A", "director"), (1, 2, "A", "secretary"), (2, 1, "Two", "director"), (None, 1, "B", "x"),
                                 (4, 1, "C", "x"), (4, 2, None, "x")], "company_number long, pos long, name string, officer_role string")
    psc = spark.createDataFrame([(1, 1, "A", ["v"])], "company_number long, pos long, name string, natures_of_control array<string>")
    leaked = spark.createDataFrame([(" a ",)], "name string")
    nodes = N.ownership_nodes(prof, off, psc, leaked)
    got = sorted((r["company_number"], r["name"], r["node_type"], r["role"], r["noc"], r["leak_hit"]) for r in nodes.collect())
    # companies 2 and 3 have one node; 4 has no profile; a null number is no company
    assert got == [(1, "A", "psc", "secretary", "v", True), (1, "One", "company", None, None, False),
                   (4, "C", "officer", "x", None, False), (4, "Unknown", "officer", "x", None, False)]
    # merged once, after they are dealt: no second reading of the parties for the counts
    text = plan(nodes)
    assert "LeftSemi" not in text and text.count("max_by(node_type") == 1 and "RepartitionByExpression [company_number" in text
