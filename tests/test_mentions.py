"""The vocabulary mention join equals the nested-loop substring join."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.operators.mentions import candidate_pairs, keyword_flags, mention_pairs, name_runs

POSTS = [
    (1, "Acme Holdings Ltd reported record growth."),
    (2, "we met XACME HOLDINGS LTDX at the fair"),          # name inside longer words
    (3, "acme   holdings"),                                   # different spacing: no 'acme holdings'
    (4, None),
    (5, ""),
    (6, "money laundering and sanctions at Beta-Corp!"),
    (7, "the 50% discount_code was used by beta-corp"),
    (8, "\tleading tab then Gamma"),
    (9, "two  spaces between words"),
]
NAMES = [
    (10, "Acme Holdings Ltd"),   # three tokens: interior key
    (11, "ACME HOLDINGS"),       # two tokens: boundary keys
    (12, "beta-corp"),           # one token: substring key
    (13, "50% discount_code"),   # wildcard characters are literal
    (14, "gamma"),
    (15, None),
    (16, ""),                    # dropped: would match everything
    (17, "  "),                  # whitespace only
    (18, "es b"),                # runs inside words on both sides
    (19, "a"),                   # one-character name
    (20, "ng tab then gam"),
    (21, "bank of the fair"),    # interior runs are stop words: a boundary key is chosen
]


def brute(posts, names):
    out = set()
    for pid, text in posts:
        for cid, name in names:
            if text is None or name is None or name.lower() == "":
                continue
            if name.lower() in text.lower():
                out.add((cid, pid))
    return out


def run(spark, posts, names):
    p = spark.createDataFrame(posts, "post_id long, post_content string")
    n = spark.createDataFrame(names, "company_id long, company_name string")
    return {(r[0], r[1]) for r in mention_pairs(p, n).collect()}


def test_fixture_equals_nested_loop(spark):
    assert run(spark, POSTS, NAMES) == brute(POSTS, NAMES)


def test_run_modes(spark):
    n = spark.createDataFrame(NAMES, "company_id long, company_name string")
    modes = {}
    for r in name_runs(n).collect():
        modes.setdefault(r["company_id"], {})[r["key"]] = r["mode"]
    assert modes[10]["holdings"] == "eq"
    assert set(modes[11].values()) == {"prefix", "suffix"}
    assert modes[12] == {"beta-corp": "sub"}
    assert modes[21]["bank"] == "suffix"


def test_names_sharing_a_last_word_are_looked_up_by_the_rare_one(spark):
    posts = [(i, f"firm{i} limited and some limited others") for i in range(60)]
    names = [(i, f"Firm{i} Limited") for i in range(60)] + [(900, "Absent Limited")]
    p = spark.createDataFrame(posts, "post_id long, post_content string")
    n = spark.createDataFrame(names, "company_id long, company_name string")
    true = brute(posts, names)
    assert {(r["company_id"], r["post_id"]) for r in mention_pairs(p, n).collect()} == true
    # 'firm1' also ends 'firm1' only; no candidate comes from 'limited'
    assert candidate_pairs(p, n).count() == len(true) == 60


def test_many_whitespace_names_and_only_empty_names(spark):
    posts = [(1, "a  b"), (2, "a b"), (3, "a\t b"), (4, None), (5, "")]
    names = [(1, " "), (2, "  "), (3, "\t "), (4, ""), (5, None)] + [(100 + i, " " * (3 + i)) for i in range(1200)]
    assert run(spark, posts, names) == brute(posts, names)
    assert run(spark, posts, [(1, ""), (2, None)]) == set()


def test_company_without_mentions_has_a_row(spark):
    from riskloom.operators.mentions import sentiment_summary
    names = spark.createDataFrame([(1, "x"), (2, "y")], "company_id long, company_name string")
    m = spark.createDataFrame([(1, 0.75)], "company_id long, sentiment_score float")
    got = {r["company_id"]: tuple(r)[1:] for r in sentiment_summary(m, names).collect()}
    assert got == {1: (0.75, 1, "positive", 0.25, False), 2: (None, 0, None, None, None)}


WORDS = ["ab", "abc", "bca", "cab", "a", "b", "c", "xa", "by", "z"]


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_random_corpora(spark, seed):
    rnd = random.Random(seed)
    posts = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 8)))) for i in range(12)]
    names = [(100 + i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 3))))
             for i in range(8)]
    names += [(200, rnd.choice(WORDS)[1:] + " " + rnd.choice(WORDS)[:1])]
    assert run(spark, posts, names) == brute(posts, names)


def test_keyword_flags_one_pass(spark):
    m = spark.createDataFrame([(1, "Money laundering and SANCTIONS"), (1, "nothing"), (2, "sanctions")],
                              "company_id long, post_content string")
    got = {(r["company_id"], r["keyword"]): (r["hits"], r["flagged"]) for r in keyword_flags(m).collect()}
    assert got[(1, "money laundering")] == (1, True)
    assert got[(1, "sanctions")] == (1, True)
    assert got[(1, "financial fraud")] == (0, False)
    assert got[(2, "sanctions")] == (1, True)
    assert len(got) == 10


def test_over_limit_falls_back_to_shuffle_join(spark):
    spark.conf.set("riskloom.broadcast.maxBytes", "0")
    try:
        assert run(spark, POSTS, NAMES) == brute(POSTS, NAMES)
        from riskloom.operators.joins import join_bounded
        big = spark.range(100).withColumnRenamed("id", "k")
        small = spark.range(0, 100, 7).withColumnRenamed("id", "k")
        j = join_bounded(big, small, "k")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" in plan and "InMemoryRelation" not in plan   # checkpoint path, no cache
        assert j.count() == 15
    finally:
        spark.conf.unset("riskloom.broadcast.maxBytes")


def test_sentiment_with_lexicon_table(spark):
    from riskloom.operators.sentiment import sentiment_scores
    posts = spark.createDataFrame([(1, "Great results"), (2, "not great"), (3, "   "), (4, None),
                                   (5, "very great")], "post_id long, post_content string")
    lex = spark.createDataFrame([("GREAT", 3.0)], "tok string, valence double")
    got = {r[0]: r[1] for r in sentiment_scores(posts, lexicon=lex).collect()}
    import math
    norm = lambda s: round((s / math.sqrt(s * s + 15) + 1) / 2, 4)
    assert got[1] == float(__import__("numpy").float32(norm(3.0)))
    assert got[2] == float(__import__("numpy").float32(norm(3.0 * -0.74)))
    assert got[3] == 0.5 and got[4] == 0.5
    assert got[5] == float(__import__("numpy").float32(norm(3.0 + 0.293)))


def test_keywords_equal_contains(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from riskloom.operators import keywords as KW
    rng = random.Random(4)
    alphabet = "abAB é%_ "
    words = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5]))) for _ in range(300)]
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(40)] + ["", None, "x" * 5000 + "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "post_id long, post_content string")
    kw = spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "keyword string")
    low = {w.lower() for w in words} | {""}
    want = sorted((i, w) for i, t in enumerate(texts) if t is not None for w in low if w in t.lower())
    for chars in (KW.SLICE_CHARS, 200):  # one automaton, and several
        assert sorted(map(tuple, KW.keyword_matches(df, kw, ["post_id"], slice_chars=chars).collect())) == want
    assert KW.keyword_counts(df, kw.limit(0), ["post_id"]).collect() == []
    # as large a plan for many keywords as for few
    size = lambda k: len(KW.keyword_matches(df, k, ["post_id"])._jdf.queryExecution().analyzed().toString())
    some = kw.where(F.length("keyword") > 0)
    assert size(some) == size(some.limit(5))


@pytest.mark.parametrize("limit", ["268435456", "0"])
def test_pairs_of_runs_equal_nested_loop(spark, monkeypatch, limit):
    """Every name of several words by its pairs of words, with and without broadcasts."""
    from riskloom.operators import mentions as M
    monkeypatch.setattr(M, "RUN_POSTS", 0)
    spark.conf.set("riskloom.broadcast.maxBytes", limit)
    try:
        assert run(spark, POSTS, NAMES) == brute(POSTS, NAMES)
        rnd = random.Random(77)
        posts = [(i, "".join(rnd.choice(WORDS) + rnd.choice([" ", "  ", "\t"]) for _ in range(rnd.randint(0, 8)))) for i in range(30)]
        names = [(100 + i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4)))) for i in range(20)]
        names += [(200, WORDS[0][1:] + " " + WORDS[1][:1]), (201, " " + WORDS[2] + " " + WORDS[3] + " ")]
        assert run(spark, posts, names) == brute(posts, names)
    finally:
        spark.conf.unset("riskloom.broadcast.maxBytes")


@pytest.mark.parametrize("passes", [16, 0])
@pytest.mark.parametrize("limit", ["268435456", "0"])
def test_automaton_and_vocabulary_join_give_each_pair_once(spark, monkeypatch, passes, limit):
    from riskloom.operators import mentions as M
    monkeypatch.setattr(M, "PASSES", passes)
    spark.conf.set("riskloom.broadcast.maxBytes", limit)
    try:
        # posts that share an id, one without, a company of two names, two companies of one name
        posts = POSTS + [(1, "Acme Holdings Ltd again, with Beta-Corp"), (3, "acme   holdings"), (None, "gamma")]
        names = NAMES + [(12, "Gamma"), (30, "acme holdings")]
        p = spark.createDataFrame(posts, "post_id long, post_content string")
        n = spark.createDataFrame(names, "company_id long, company_name string")
        got = [tuple(r) for r in mention_pairs(p, n).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {x for x in brute(posts, names) if x[1] is not None}
    finally:
        spark.conf.unset("riskloom.broadcast.maxBytes")


def test_posts_are_read_without_a_shuffle_of_tokens_or_pairs(spark):
    p = spark.createDataFrame(POSTS, "post_id long, post_content string")
    n = spark.createDataFrame(NAMES, "company_id long, company_name string")
    plan = mention_pairs(p, n)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert not any(x in plan for x in ("Generate", "Aggregate", "Window", "Distinct"))


def test_pairs_are_found_once_for_the_sentiments(spark):
    from riskloom.operators.mentions import mentions_with_sentiment
    p = spark.createDataFrame(POSTS, "post_id long, post_content string")
    n = spark.createDataFrame(NAMES, "company_id long, company_name string")
    rows = mentions_with_sentiment(p, n)
    assert {(r["company_id"], r["post_id"]) for r in rows.collect()} == brute(POSTS, NAMES)
    assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()
