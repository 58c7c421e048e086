"""Text functions and jurisdiction screening against plain-Python references (property tests)."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions.jurisdiction import jurisdiction_risk
from riskloom.functions.text import join_nonempty, norm_name, python_title, yes_no


BLACK, GREY, HIGH = ("FATF Black List", "Critical"), ("FATF Grey List", "High"), ("High-Risk Jurisdiction", "High")
EXPECTED = [("Russian Federation", BLACK), ("Russia", BLACK), ("Iranian", BLACK), ("Jordanian", GREY),
            ("Somalia", GREY), ("New Jersey", HIGH), ("Cayman Islands", GREY), ("nan", None), ("", None),
            ("   ", None), (None, None), ("France", None), ("UAE", GREY), ("  NORTH KOREA\t", BLACK),
            ("Isle of Man", HIGH), ("Mali", GREY), ("United Arab Emirates", GREY), ("Germany", None),
            ("British Virgin Islands", HIGH), ("congo (brazzaville)", GREY)]


def test_jurisdiction_of_countries(spark):
    df = spark.createDataFrame([(c,) for c, _ in EXPECTED], "c string")
    r = jurisdiction_risk(F.col("c"))
    got = {row["c"]: (None if row["r"] is None else (row["r"]["label"], row["r"]["severity"]))
           for row in df.select("c", r.alias("r")).collect()}
    assert got == dict(EXPECTED)


def test_exact_mode(spark):
    df = spark.createDataFrame([("Somalia",), ("mali",), (" Mali ",)], "c string")
    got = [r[0] for r in df.select(jurisdiction_risk(F.col("c"), match="exact").label).collect()]
    assert got == [None, "FATF Grey List", "FATF Grey List"]


TITLE_WORDS = ["dissolved", "voluntary-arrangement", "llp designated member", "corporate-director",
               "active", "open", "in administration", "receiver/manager", "3rd party", ""]


def test_python_title(spark):
    df = spark.createDataFrame([(w,) for w in TITLE_WORDS], "w string")
    got = {r[0]: r[1] for r in df.select("w", python_title(F.col("w"))).collect()}
    for w in TITLE_WORDS:
        assert got[w] == w.title(), w


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=" \t aBcÉ-_", max_size=8), min_size=1, max_size=8))
def test_norm_name_is_python_strip_lower(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(norm_name(F.col("n"))).collect()]
    assert got == [n.strip().lower() for n in names]


def test_join_nonempty_and_yes_no(spark):
    df = spark.createDataFrame([("a", None, "", "b", True), (None, None, None, None, None)],
                               "p1 string, p2 string, p3 string, p4 string, f boolean")
    rows = df.select(join_nonempty(", ", *[F.col(c) for c in ("p1", "p2", "p3", "p4")]),
                     yes_no(F.col("f"))).collect()
    assert [tuple(r) for r in rows] == [("a, b", "YES"), ("", "No")]


def test_very_many_jurisdiction_terms_give_the_same_result(spark):
    from riskloom.functions.jurisdiction import DEFAULT_LISTS, JurisdictionList, jurisdiction_risk
    padding = JurisdictionList("Other", "Low", tuple(f"nowhere-{i}" for i in range(2500)) + ("",))
    df = spark.createDataFrame([("Somalia",), ("Iran",), ("France",), ("NaN",), (None,), ("nowhere-2400",)], "c string")
    rows = df.select("c", jurisdiction_risk(df.c, (*DEFAULT_LISTS, padding)).alias("r")).collect()
    got = {r["c"]: r["r"] and tuple(r["r"]) for r in rows}
    assert got == {"Somalia": ("FATF Grey List", "High"), "Iran": ("FATF Black List", "Critical"),
                   "France": None, "NaN": None, None: None, "nowhere-2400": ("Other", "Low")}
