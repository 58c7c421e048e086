"""Registered text queries: mention join, sentiment, keyword flags, recent mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import keywords as KW
from riskloom.operators import mentions as M
from riskloom.operators import sentiment as SE
from riskloom.plans.registry import query
from riskloom.sources import testdata as T

_PAIRS_SQL = """
    SELECT b.item_id AS company_id, d.doc_id AS post_id
    FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))
    WHERE lower(b.text) <> ''"""


def _sentiment_sql() -> str:
    lex = ", ".join(f"('{k}', CAST({v} AS DECIMAL(12,6)))" for k, v in SE.LEXICON.items())
    mods = ", ".join([f"('{w.replace(chr(39), chr(39) * 2)}', 'neg', CAST(0 AS DECIMAL(12,6)))"
                      for w in SE.NEGATIONS]
                     + [f"('{w}', 'boost', CAST({b} AS DECIMAL(12,6)))" for w, b in SE.BOOSTERS.items()])
    decay = ", ".join(f"CAST({d} AS DECIMAL(12,6))" for d in SE.BOOST_DECAY)
    split = SE.TOKEN_SPLIT.replace("'", "''")
    return f"""
    WITH lex(tok, valence) AS (VALUES {lex}),
    mods(tok, kind, boost) AS (VALUES {mods}),
    raw AS (SELECT doc_id AS post_id, string_split_regex(lower(text), '{split}') AS t FROM documents),
    toks AS (SELECT post_id, unnest(t) AS tok, unnest(range(0, len(t))) AS pos FROM raw),
    hits AS (SELECT post_id, pos, valence FROM toks JOIN lex USING (tok) WHERE tok <> ''),
    scope AS (SELECT post_id, kind, boost, dist, pos + dist AS pos
              FROM (SELECT post_id, pos, kind, boost, unnest(range(1, {SE.WINDOW + 1})) AS dist
                    FROM toks JOIN mods USING (tok) WHERE tok <> '')),
    per_hit AS (SELECT h.post_id, h.pos, h.valence, bool_or(s.kind = 'neg') AS negated,
                       sum(CASE WHEN s.kind = 'boost' THEN s.boost * ([{decay}])[s.dist] END) AS boost
                FROM hits h LEFT JOIN scope s ON h.post_id = s.post_id AND h.pos = s.pos
                GROUP BY 1, 2, 3),
    vals AS (SELECT post_id,
                    CAST(CASE WHEN coalesce(negated, FALSE)
                              THEN (valence + sign(valence) * coalesce(boost, 0)) * CAST({SE.NEGATION_SCALAR} AS DECIMAL(6,2))
                              ELSE valence + sign(valence) * coalesce(boost, 0) END AS DECIMAL(20,8)) AS v
             FROM per_hit),
    sums AS (SELECT post_id, CAST(sum(v) AS DOUBLE) AS s FROM vals GROUP BY 1)
    SELECT d.doc_id AS post_id,
           CAST(CASE WHEN d.text IS NULL OR trim(d.text) = '' THEN 0.5
                     ELSE round((coalesce(s.s / sqrt(s.s * s.s + {SE.ALPHA}), 0.0) + 1) / 2, 4) END AS FLOAT)
             AS sentiment_score
    FROM documents d LEFT JOIN sums s ON d.doc_id = s.post_id"""


def _names(spark, d):
    return M.company_name_lookup(T.mention_names(spark, d))


def _mentioned(spark, d):
    return M.mentions_with_sentiment(T.posts(spark, d), _names(spark, d))


@query("mention_join", _PAIRS_SQL)
def mention_join(spark, d):
    return M.mention_pairs(T.posts(spark, d), _names(spark, d))


@query("sentiment_score", _sentiment_sql())
def sentiment_score(spark, d):
    return SE.sentiment_scores(T.posts(spark, d))


_MENTIONED_SQL = f"""
    SELECT p.company_id, p.post_id, d.source AS platform, d.text AS post_content, s.sentiment_score
    FROM ({_PAIRS_SQL}) p JOIN documents d ON p.post_id = d.doc_id
    JOIN ({_sentiment_sql()}) s ON s.post_id = p.post_id"""


@query("sentiment_summary", f"""
    WITH per AS (SELECT company_id, count(*) AS n, round(avg(CAST(sentiment_score AS DOUBLE)), 6) AS a
                 FROM ({_MENTIONED_SQL}) GROUP BY company_id)
    SELECT b.item_id AS company_id, per.a AS avg_sentiment, CAST(coalesce(per.n, 0) AS BIGINT) AS post_count,
           CASE WHEN per.a < 0.4 THEN 'negative' WHEN per.a < 0.6 THEN 'neutral'
                WHEN per.a IS NOT NULL THEN 'positive' END AS sentiment_band,
           round(per.a - 0.5, 6) AS delta_to_neutral, per.a < 0.4 AS below_alert
    FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN per ON per.company_id = b.item_id""")
def sentiment_summary(spark, d):
    return M.sentiment_summary(_mentioned(spark, d), _names(spark, d))


# Short names taken from the documents themselves: the opening two words of each.
_SHORT_SQL = r"""
    WITH names AS (SELECT DISTINCT regexp_extract(lower(text), '^([a-z]+) [a-z]+', 1) || ' '
                                || regexp_extract(lower(text), '^[a-z]+ ([a-z]+)', 1) AS name
                   FROM documents WHERE regexp_matches(lower(text), '^[a-z]+ [a-z]+'))
    SELECT n.name AS company_id, d.doc_id AS post_id
    FROM names n JOIN documents d ON contains(lower(d.text), n.name)"""


@query("mention_join_short", _SHORT_SQL)
def mention_join_short(spark, d):
    """Names of two words, the opening words of every document, looked up in all documents."""
    posts = T.posts(spark, d)
    phrase = F.regexp_extract(F.lower("post_content"), "^([a-z]+ [a-z]+)", 1)
    names = posts.select(phrase.alias("company_name")).filter(F.col("company_name") != "").distinct()
    return M.mention_pairs(posts, names.withColumn("company_id", F.col("company_name")))


@query("recent_mentions", f"""
    SELECT company_id, CAST(rank AS INTEGER) AS rank, post_id, platform, sentiment_score,
           CASE WHEN sentiment_score >= 0.5 THEN 'success' ELSE 'danger' END AS sentiment_class FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY post_id DESC) AS rank
      FROM ({_MENTIONED_SQL})) WHERE rank <= 5""")
def recent_mentions(spark, d):
    return M.recent_mentions(_mentioned(spark, d), 5)


def _keyword_sql(keywords) -> str:
    arms = " UNION ALL ".join(
        f"SELECT company_id, '{kw}' AS keyword, "
        f"CAST(count(*) FILTER (WHERE contains(lower(post_content), '{kw.lower()}')) AS BIGINT) AS hits "
        f"FROM m GROUP BY company_id" for kw in keywords)
    title = ("list_aggr(list_transform(string_split(lower(keyword), ' '), "
             "lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' ')")
    return f"""
    WITH m AS ({_MENTIONED_SQL})
    SELECT company_id, keyword, {title} AS keyword_title, hits, hits > 0 AS flagged,
           CASE WHEN hits > 0 THEN 'YES — ' || CAST(hits AS VARCHAR) || ' mention(s)'
                ELSE 'No mentions' END AS label
    FROM ({arms})"""


@query("keyword_flags", f"SELECT * FROM ({_keyword_sql(M.FRAUD_KEYWORDS)})")
def keyword_flags(spark, d):
    return M.keyword_flags(_mentioned(spark, d))


# Words that do occur in the driver's documents, to exercise hits > 0.
CUSTOM_KEYWORDS = ("license", "copyright", "@", "the")


@query("keyword_flags_custom", f"SELECT * FROM ({_keyword_sql(CUSTOM_KEYWORDS)})")
def keyword_flags_custom(spark, d):
    return M.keyword_flags(_mentioned(spark, d), CUSTOM_KEYWORDS)


# Thousands of keywords: every word of four letters or more of the benchmark passages.
@query("keyword_hits_many", r"""
    WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS keyword FROM benchmark)
    SELECT d.source AS platform, k.keyword, count(*) AS hits
    FROM documents d JOIN k ON contains(lower(d.text), k.keyword) GROUP BY ALL""")
def keyword_hits_many(spark, d):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    keywords = T.read(spark, d, "benchmark").select(words.alias("keyword")).distinct()
    return KW.keyword_counts(T.posts(spark, d), keywords, ["platform"])
