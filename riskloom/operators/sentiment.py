"""Lexicon sentiment in [0, 1] as a Spark join.

The score follows the published lexicon-and-rules method (Hutto & Gilbert,
2014) in a reduced form: token valences from a lexicon table, a booster or a
negation within the three preceding tokens scales a valence, the valence sum
``s`` is normalised as ``s / sqrt(s*s + 15)`` and mapped to ``(x + 1) / 2``,
rounded to 4 places, as FLOAT. NULL or blank text scores 0.5.

Plan: tokens are exploded with their positions; only tokens found in the
lexicon (broadcast when measured under the limit) and the few
negation/booster tokens survive the joins, and the "three preceding tokens"
rule is an equi-join on (post, position) — no window over whole posts, so a
very long post is never sorted as one group. Valences are DECIMAL so sums do
not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.joins import join_bounded

# A small English lexicon of our own (valence on a -4..4 scale),
# the negation and booster words, and the method's constants.
LEXICON = {
    "good": 1.9, "great": 3.1, "excellent": 3.2, "positive": 2.3, "strong": 2.3,
    "growth": 1.6, "profit": 1.9, "profitable": 2.0, "success": 2.7, "successful": 2.8,
    "trust": 2.3, "trusted": 2.1, "reliable": 2.2, "secure": 1.6, "safe": 1.9,
    "win": 2.8, "gain": 2.0, "gains": 1.9, "improve": 1.9, "improved": 2.1,
    "benefit": 2.0, "happy": 2.7, "love": 3.2, "like": 1.5, "best": 3.2,
    "better": 1.9, "honest": 2.3, "clean": 1.7, "stable": 1.2, "recommend": 1.5,
    "bad": -2.5, "poor": -2.1, "terrible": -3.0, "awful": -2.9, "negative": -2.7,
    "weak": -1.9, "loss": -1.3, "losses": -1.7, "fail": -2.5, "failed": -2.3,
    "failure": -2.3, "fraud": -3.1, "fraudulent": -3.2, "scam": -3.0, "theft": -2.6,
    "illegal": -2.6, "corrupt": -3.0, "corruption": -3.0, "risk": -1.1, "risky": -1.4,
    "breach": -1.8, "crime": -2.5, "criminal": -2.4, "laundering": -2.2, "sanctions": -1.3,
    "penalty": -1.8, "fine": 0.8, "warning": -1.4, "lawsuit": -2.0, "bankrupt": -2.6,
    "bankruptcy": -2.6, "debt": -1.5, "default": -1.6, "scandal": -2.7, "suspicious": -1.6,
    "hate": -2.7, "angry": -2.3, "worst": -3.1, "worse": -2.1, "problem": -1.7,
}
NEGATIONS = ("not", "no", "never", "none", "nobody", "nothing", "neither", "nor",
             "cannot", "can't", "don't", "doesn't", "didn't", "isn't", "wasn't",
             "aren't", "won't", "without")
BOOSTERS = {"very": 0.293, "extremely": 0.293, "really": 0.293, "highly": 0.293,
            "so": 0.293, "most": 0.293, "slightly": -0.293, "somewhat": -0.293,
            "barely": -0.293, "hardly": -0.293}
NEGATION_SCALAR = -0.74
ALPHA = 15
WINDOW = 3
BOOST_DECAY = (1.0, 0.95, 0.9)   # booster one, two, three tokens before

TOKEN_SPLIT = r"[^\p{L}\p{N}'_-]+"


def lexicon_df(spark: SparkSession, lexicon: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """The lexicon as a (tok, valence DECIMAL) table: the built-in one, a dict, or a
    DataFrame with ``tok``/``valence`` columns (lower-cased here). Any size works."""
    if not isinstance(lexicon, DataFrame):
        lex = LEXICON if lexicon is None else lexicon
        lexicon = spark.createDataFrame([(k, float(v)) for k, v in lex.items()], "tok string, valence double")
    return lexicon.select(F.lower(F.col("tok")).alias("tok"), F.col("valence").cast("decimal(12,6)").alias("valence"))


def _modifiers(spark: SparkSession) -> DataFrame:
    rows = [(w, "neg", 0.0) for w in NEGATIONS] + [(w, "boost", float(b)) for w, b in BOOSTERS.items()]
    return spark.createDataFrame(rows, "tok string, kind string, boost double") \
        .select("tok", "kind", F.col("boost").cast("decimal(12,6)").alias("boost"))


def tokens_with_pos(posts: DataFrame, text_col: str, id_col: str) -> DataFrame:
    toks = F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)
    return (posts.select(F.col(id_col).alias("post_id"), F.posexplode(toks).alias("pos", "tok"))
            .filter(F.col("tok") != ""))


def post_valence_sums(posts: DataFrame, text_col: str = "post_content", id_col: str = "post_id",
                      lexicon: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """(post_id, s): the valence sum of every post with at least one lexicon word."""
    spark = posts.sparkSession
    toks = tokens_with_pos(posts, text_col, id_col)
    lex = lexicon_df(spark, lexicon)
    # a lexicon table is measured before it is broadcast; the built-in one has a fixed size
    hits = join_bounded(toks, lex, "tok") if lexicon is not None else toks.join(F.broadcast(lex), "tok")
    hits = hits.select("post_id", "pos", "valence")
    mods = toks.join(F.broadcast(_modifiers(spark)), "tok")
    # each modifier reaches the next WINDOW positions: (post, target pos, distance)
    scope = mods.select("post_id", "kind", "boost", F.col("pos").alias("src"),
                        F.explode(F.sequence(F.lit(1), F.lit(WINDOW))).alias("dist")) \
        .select("post_id", "kind", "boost", "dist", (F.col("src") + F.col("dist")).alias("pos"))
    decay = F.element_at(F.array(*[F.lit(d) for d in BOOST_DECAY]), F.col("dist").cast("int"))
    per_hit = (hits.join(scope, ["post_id", "pos"], "left")
               .groupBy("post_id", "pos", "valence")
               .agg(F.max(F.col("kind") == "neg").alias("negated"),
                    F.sum(F.when(F.col("kind") == "boost",
                                 F.col("boost") * decay.cast("decimal(12,6)"))).alias("boost")))
    sign = F.when(F.col("valence") > 0, F.lit(1)).when(F.col("valence") < 0, F.lit(-1)).otherwise(0)
    v = F.col("valence") + sign * F.coalesce(F.col("boost"), F.lit(0).cast("decimal(12,6)"))
    v = F.when(F.coalesce(F.col("negated"), F.lit(False)),
               v * F.lit(NEGATION_SCALAR).cast("decimal(6,2)")).otherwise(v)
    return per_hit.groupBy("post_id").agg(F.sum(v.cast("decimal(20,8)")).cast("double").alias("_s"))


def score_column(text: Column) -> Column:
    """Score from the valence sum ``_s`` (NULL when no lexicon word) and the text."""
    s = F.col("_s")
    compound = s / F.sqrt(s * s + F.lit(ALPHA))
    blank = text.isNull() | (F.trim(text) == "")
    return (F.when(blank, F.lit(0.5))
            .otherwise(F.round((F.coalesce(compound, F.lit(0.0)) + 1) / 2, 4))).cast("float")


def with_sentiment(posts: DataFrame, text_col: str = "post_content", id_col: str = "post_id",
                   lexicon: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """Posts with ``sentiment_score``. The per-post sums are broadcast when measured small,
    so the posts (with their texts) are not shuffled."""
    sums = post_valence_sums(posts, text_col, id_col, lexicon).withColumnRenamed("post_id", id_col)
    return (join_bounded(posts, sums, id_col, "left")
            .withColumn("sentiment_score", score_column(F.col(text_col))).drop("_s"))


def sentiment_scores(posts: DataFrame, text_col: str = "post_content", id_col: str = "post_id",
                     lexicon: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """(post_id, sentiment_score FLOAT) for every post.

    The sums are joined to a slim (id, blank-flag) projection of the posts, so
    even when they are too large to broadcast no text is shuffled.
    """
    sums = post_valence_sums(posts, text_col, id_col, lexicon)
    slim = posts.select(F.col(id_col).alias("post_id"),
                        F.when(F.col(text_col).isNull() | (F.trim(F.col(text_col)) == ""), F.lit(None))
                        .otherwise(F.lit("x")).alias("_t"))
    return (join_bounded(slim, sums, "post_id", "left")
            .select("post_id", score_column(F.col("_t")).alias("sentiment_score")))
