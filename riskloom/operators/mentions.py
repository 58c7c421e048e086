"""Posts that mention a company: an exact substring join without a nested loop.

``mention_pairs(posts, names)`` returns every (company, post) with
``contains(lower(post), lower(name))`` — the reference's ``LIKE '%name%'``
with the name taken literally. The posts stream past the names, held in an automaton
(``keywords.keyword_matches``): neither tokens nor texts are shuffled, nothing
is written but the pairs. Each million characters of names read the posts once
more; beyond ``PASSES`` of them the pairs come from a *vocabulary join*, whose
shuffles and candidates take several times the posts on disk:

1. Texts become (post, token) rows: distinct whitespace-split tokens of the
   lower-cased text (``\\s+``, the same split used for names).
2. Every maximal non-whitespace *run* of a lower-cased name has a mode fixed
   by what surrounds it in the name: whitespace on both sides → it equals a
   whole text token (``eq``); only before → it is a prefix of a text token
   (``prefix``); only after → a suffix (``suffix``); neither (the name has no
   whitespace) → a substring of one token (``sub``).
3. The distinct runs are matched against the *distinct vocabulary* of the posts
   with its document counts: ``eq`` by equality, the others through
   bounded-length prefix / gram keys (a necessary condition) and then the exact
   ``startswith``/``endswith``/``contains`` test. A name with a run (or pair of
   runs) that matches nothing occurs in no post and leaves here.
4. A name is looked up by its *rarest* run, ``acme`` of ``Acme Limited``. If even
   that is in more than ``RUN_POSTS`` posts, it is looked up by two neighbouring ones: the posts'
   pairs of adjacent tokens (*bigrams*) are indexed like the tokens, a name's
   pair of runs matches the bigrams whose first token ends in (or equals) the
   one and whose second begins with (or equals) the other, and the name's rarest
   pair becomes its key: ``of`` and ``the`` are in every post, ``bank of`` in few.
5. Only the tokens and bigrams of chosen keys go back to the posts, and every
   candidate pair is verified with ``contains`` on the whole text: the result is
   exact, and the key choice only affects how many candidates there are.

Names made only of whitespace are one ``sub`` run looked up in the posts'
whitespace runs. Names that are empty after lower-casing mention nothing
(``LIKE '%%'`` would match every post); ``sentiment_summary`` lists them with
no mentions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.text import python_title
from riskloom.operators.joins import broadcast_limit, join_bounded, measured_bytes
from riskloom.operators.keywords import SLICE_CHARS, keyword_matches
from riskloom.session import cut_lineage

# The five fraud keywords of the keyword panel, its labels, and
# the post badge classes (a score of at least 0.5 is good).
FRAUD_KEYWORDS = ("financial fraud", "regulatory breach", "illegitimate transaction",
                  "money laundering", "sanctions")
HIT_LABEL = ("YES — ", " mention(s)")
NO_HIT_LABEL = "No mentions"
GOOD_SENTIMENT = 0.5
BADGE_GOOD, BADGE_BAD = "success", "danger"

WS = r"\s+"
PREFIX_KEY_LEN = 8      # prefix/suffix keys use at most this many leading chars
PASSES = 16             # up to so many automata read the posts one after the other; more names take the vocabulary join
RUN_POSTS = 100         # a name whose rarest run is in more posts is looked up by two neighbouring runs
GRAM_LEN = 3            # substring keys use a gram of at most this many chars


def company_name_lookup(companies: DataFrame, id_col: str = "company_id",
                        name_col: str = "company_name") -> DataFrame:
    """One searchable name per company (the lowest, so duplicates are deterministic).

    Replaces the per-company scalar subquery with one aggregation feeding the join;
    a company without a row simply has no mentions (count 0, no average).
    """
    return companies.groupBy(id_col).agg(F.min(name_col).alias(name_col))


def post_tokens(posts: DataFrame, text_col: str = "post_content", id_col: str = "post_id") -> DataFrame:
    """(post_id, tok): distinct tokens per post of the lower-cased text."""
    return (posts.select(F.col(id_col).alias("post_id"),
                         F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), WS))).alias("tok"))
            .filter(F.col("tok") != ""))


def post_spaces(posts: DataFrame, text_col: str = "post_content", id_col: str = "post_id") -> DataFrame:
    """(post_id, tok): distinct maximal whitespace runs per post."""
    runs = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({WS})"), 1)
    return posts.select(F.col(id_col).alias("post_id"), F.explode(F.array_distinct(runs)).alias("tok"))


def name_runs(names: DataFrame, name_col: str = "company_name", id_col: str = "company_id") -> DataFrame:
    """All runs of each name: (company_id, name_l, i, key, mode, blank, runs, key2, mode2); key2 is the next run.

    NULL and empty names have none.
    """
    name_l = F.lower(F.col(name_col))
    core = F.regexp_replace(name_l, r"^\s+|\s+$", "")
    blank = core == ""
    lead = name_l.rlike(r"^\s")
    trail = name_l.rlike(r"\s$")
    toks = F.split(core, WS)
    k = F.size(toks)

    def describe(t: Column, i: Column) -> Column:
        before = (i > 0) | lead
        after = (i < k - 1) | trail
        mode = (F.when(before & after, "eq").when(before, "prefix")
                .when(after, "suffix").otherwise("sub"))
        return F.struct(i.alias("i"), t.alias("key"), mode.alias("mode"))

    whole = F.array(F.struct(F.lit(0).alias("i"), name_l.alias("key"), F.lit("sub").alias("mode")))
    return (names.filter(name_l != "")
            .select(F.col(id_col).alias("company_id"), name_l.alias("name_l"), blank.alias("blank"),
                    F.when(blank, whole).otherwise(F.transform(toks, describe)).alias("rs"))
            .select("company_id", "name_l", "blank", "rs", F.size("rs").alias("runs"), F.explode("rs").alias("r"))
            # the run after it, null for the last
            .withColumn("next", F.get("rs", F.col("r.i") + 1))
            .select("company_id", "name_l", "r.i", "r.key", "r.mode", "blank", "runs",
                    F.col("next.key").alias("key2"), F.col("next.mode").alias("mode2")))


def post_bigrams(posts: DataFrame, text_col: str = "post_content", id_col: str = "post_id") -> DataFrame:
    """(post_id, gram): distinct pairs of adjacent tokens per post, as ``first second`` (tokens hold no space)."""
    t = F.split(F.lower(F.col(text_col)), WS)
    n = F.size(t) - 1
    grams = F.when(n > 0, F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda x, y: F.concat(x, F.lit(" "), y)))
    return (posts.select(F.col(id_col).alias("post_id"), F.explode(F.array_distinct(grams)).alias("gram"))
            # no token before a leading or after a trailing space
            .filter(~F.col("gram").startswith(" ") & ~F.col("gram").endswith(" ")))


def _vocab_prefixes(vocab: DataFrame, reverse: bool) -> DataFrame:
    """(tok, df, p): every prefix of length 1..PREFIX_KEY_LEN of each (reversed) vocabulary token."""
    t = F.reverse(F.col("tok")) if reverse else F.col("tok")
    n = F.least(F.length(t), F.lit(PREFIX_KEY_LEN))
    return vocab.select("tok", "df", F.explode(F.transform(F.sequence(F.lit(1), n),
                                                           lambda l: F.substring(t, 1, l))).alias("p"))


def _vocab_grams(vocab: DataFrame) -> DataFrame:
    """(tok, df, g): every substring of length 1..GRAM_LEN of each vocabulary token."""
    t = F.col("tok")
    starts = F.sequence(F.lit(1), F.length(t))
    grams = F.flatten(F.transform(starts, lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(GRAM_LEN), F.length(t) - s + 1)),
        lambda l: F.substring(t, s, l))))
    return vocab.select("tok", "df", F.explode(F.array_distinct(grams)).alias("g"))


def key_tokens(vocab: DataFrame, keys: DataFrame, modes: set[str]) -> DataFrame:
    """(key, mode, tok, df): the vocabulary tokens that each distinct key matches, exactly."""
    parts = []
    if "eq" in modes:
        parts.append(keys.filter(F.col("mode") == "eq").withColumn("tok", F.col("key")).join(vocab, "tok"))
    for mode, rev in (("prefix", False), ("suffix", True)):
        if mode not in modes:
            continue
        kk = F.reverse(F.col("key")) if rev else F.col("key")
        ks = keys.filter(F.col("mode") == mode).withColumn("p", F.substring(kk, 1, PREFIX_KEY_LEN))
        test = F.col("tok").endswith(F.col("key")) if rev else F.col("tok").startswith(F.col("key"))
        parts.append(_vocab_prefixes(vocab, rev).join(ks, "p").filter(test))
    if "sub" in modes:
        ks = keys.filter(F.col("mode") == "sub").withColumn("g", F.substring("key", 1, GRAM_LEN))
        parts.append(_vocab_grams(vocab).join(ks, "g").filter(F.col("tok").contains(F.col("key"))))
    return reduce(DataFrame.unionByName, [p.select("key", "mode", "tok", "df") for p in parts])


def rarest_keys(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """(company_id, name_l, key, mode, cost, runs): per name the run whose tokens occur in the fewest posts.

    Names with a run that no token matches are left out: no post contains them.
    """
    cost = matches.groupBy("key", "mode").agg(F.sum("df").alias("cost"))
    # a run that most names share (limited) is a hot key: the costs, one row per distinct run, are broadcast
    best = (join_bounded(runs, cost, ["key", "mode"], "left").groupBy("company_id", "name_l")
            .agg(F.min(F.struct("cost", "i", "key", "mode", "runs")).alias("b")))
    # a run without a match has a NULL cost, which is the least
    return best.filter(F.col("b.cost").isNotNull()).select("company_id", "name_l", "b.key", "b.mode", "b.cost", "b.runs")


def _bigram_candidates(posts: DataFrame, runs: DataFrame, matches: DataFrame, text_col: str) -> DataFrame:
    """(company_id, name_l, post_id) for names of several runs, by each name's rarest pair of adjacent runs."""
    pairs = runs.filter(F.col("key2").isNotNull()).select("company_id", "name_l", "i", "key", "mode", "key2", "mode2")
    at = ["key", "mode", "key2", "mode2"]
    wanted = pairs.select(*at).distinct()
    first = matches.select("key", "mode", F.col("tok").alias("t1"))
    second = matches.select(F.col("key").alias("key2"), F.col("mode").alias("mode2"), F.col("tok").alias("t2"))
    grams = post_bigrams(posts, text_col)
    t1, t2 = F.substring_index("gram", " ", 1), F.substring_index("gram", " ", -1)
    # with few names most bigrams begin with a token that no name asks for: leave those in the posts
    starts = cut_lineage(first.join(wanted.select("key", "mode").distinct(), ["key", "mode"], "left_semi").select("t1").distinct())
    if measured_bytes(starts) <= broadcast_limit(posts):
        grams = (grams.withColumn("t1", t1).join(F.broadcast(starts), "t1", "left_semi").drop("t1"))
    vocab = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).withColumn("t1", t1).withColumn("t2", t2)
    # a token matches no more keys than it has prefixes or suffixes, so neither join multiplies much
    hits = cut_lineage(vocab.join(first, "t1").join(second, "t2").join(wanted, at, "left_semi").select("gram", "df", *at))
    cost = hits.groupBy(*at).agg(F.sum("df").alias("cost"))
    best = (join_bounded(pairs, cost, at, "left").groupBy("company_id", "name_l")
            .agg(F.min(F.struct("cost", "i", *at)).alias("b")))
    # a pair without a match has a NULL cost, which is the least: no post has that name
    chosen = best.filter(F.col("b.cost").isNotNull()).select("company_id", "name_l", *[f"b.{c}" for c in at])
    return (join_bounded(grams, hits.join(chosen, at).select("gram", "company_id", "name_l"), "gram")
            .select("company_id", "name_l", "post_id"))


def candidate_pairs(posts: DataFrame, names: DataFrame, text_col: str = "post_content",
                    name_col: str = "company_name") -> DataFrame | None:
    """(company_id, name_l, post_id): a superset of the answer; None when no name has a run."""
    runs = name_runs(names, name_col)
    # one small job: which modes occur (at most 4), whether any name is only whitespace, and the names' lengths
    stats = runs.agg(F.collect_set("mode").alias("modes"), F.max("blank").alias("blank"),
                     F.max("runs").alias("most")).first()
    if not stats["modes"]:
        return None
    tokens = post_tokens(posts, text_col)
    if stats["blank"]:
        tokens = tokens.unionByName(post_spaces(posts, text_col))
    vocab = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    # read several times, for the costs and for the chosen keys: stored once, small next to the posts
    matches = cut_lineage(key_tokens(vocab, runs.select("key", "mode").distinct(), set(stats["modes"])))
    chosen = rarest_keys(runs, matches)
    common = (F.col("runs") > 1) & (F.col("cost") > RUN_POSTS)
    wanted = matches.join(chosen.filter(~common), ["key", "mode"]).select("tok", "company_id", "name_l")
    parts = [join_bounded(tokens, wanted, "tok").select("company_id", "name_l", "post_id")]
    if stats["most"] > 1:
        names_left = cut_lineage(chosen.filter(common).select("company_id", "name_l"))
        if not names_left.isEmpty():
            parts.append(_bigram_candidates(posts, runs.join(names_left, ["company_id", "name_l"], "left_semi"),
                                            matches, text_col))
    return reduce(DataFrame.unionByName, parts).distinct()


def _pairs_by_vocabulary(posts: DataFrame, names: DataFrame, text_col: str, name_col: str) -> DataFrame:
    """The pairs by the vocabulary join; every post has an id, some name is not empty."""
    cand = candidate_pairs(posts, names, text_col, name_col)
    # verify against the whole text; the candidates are broadcast when measured small,
    # so the texts are streamed instead of shuffled, and only candidate posts are lower-cased
    # a post is lower-cased once, not once per candidate
    texts = posts.select(F.col("post_id"), F.lower(F.col(text_col)).alias("_text"))
    return (join_bounded(texts, cand, "post_id")
            .filter(F.col("_text").contains(F.col("name_l")))
            .select("company_id", "post_id").distinct())


def mention_pairs(posts: DataFrame, names: DataFrame, text_col: str = "post_content",
                  name_col: str = "company_name") -> DataFrame:
    """Exact (company_id, post_id) pairs where the post contains the company name, each once."""
    spark = posts.sparkSession
    owned = cut_lineage(names.select("company_id", F.lower(F.col(name_col)).alias("name_l"))
                        .filter(F.col("name_l") != "").distinct())
    each = owned.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("name_l")).alias("chars"))
    chars, most = each.agg(F.sum("chars"), F.max("n")).first()
    if not chars:
        return spark.createDataFrame([], T.StructType([names.schema["company_id"], posts.schema["post_id"]]))
    posts = posts.filter(F.col("post_id").isNotNull())
    if chars > PASSES * SLICE_CHARS:
        return _pairs_by_vocabulary(posts, names, text_col, name_col)

    def found(some: DataFrame) -> DataFrame:
        hits = keyword_matches(some, owned, ["post_id"], text_col, "name_l").withColumnRenamed("keyword", "name_l")
        return join_bounded(hits, owned, "name_l").select("company_id", "post_id")

    # a text gives a name once: only posts that share an id, and companies of several names, can repeat a pair
    shared = cut_lineage(posts.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("post_id"))
    size = measured_bytes(shared)
    if most > 1 or size > broadcast_limit(posts):
        return found(posts).distinct()
    if not size:
        return found(posts)
    shared = F.broadcast(shared)
    return found(posts.join(shared, "post_id", "left_anti")).unionByName(found(posts.join(shared, "post_id", "left_semi")).distinct())


def mention_posts(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """Join the pairs back to the post rows (pairs broadcast when measured small)."""
    return join_bounded(posts, pairs, "post_id")


def mentions_with_sentiment(posts: DataFrame, names: DataFrame, text_col: str = "post_content",
                            name_col: str = "company_name") -> DataFrame:
    """Mentioning posts with their sentiment score, one row per (company, post).

    Sentiment is computed only for posts that mention some company (picked
    with a size-checked broadcast semi-join, so no text is shuffled). The
    verified pairs and those posts' valence sums are both small; they are
    combined first and joined to the posts once.
    """
    from riskloom.operators.sentiment import post_valence_sums, score_column
    if "company_id" in posts.columns:   # the poster's own company, not the mentioned one
        posts = posts.withColumnRenamed("company_id", "post_company_id")
    pairs = cut_lineage(mention_pairs(posts, names, text_col, name_col))   # read twice
    mentioned = join_bounded(posts, pairs.select("post_id").distinct(), "post_id", "left_semi")
    small = pairs.join(post_valence_sums(mentioned, text_col), "post_id", "left")
    return (join_bounded(posts, small, "post_id")
            .withColumn("sentiment_score", score_column(F.col(text_col))).drop("_s"))


def sentiment_summary(mentioned: DataFrame, names: DataFrame, score_col: str = "sentiment_score") -> DataFrame:
    """G2 + P17: average sentiment and post count per company; band and delta to neutral.

    Every company of ``names`` has a row; one without mentions has count 0 and
    NULL average, band, delta and alert.
    """
    from riskloom.functions.bands import sentiment_band
    agg = mentioned.groupBy("company_id").agg(
        F.avg(F.col(score_col).cast("double")).alias("avg_sentiment"),
        F.count(F.lit(1)).cast("bigint").alias("post_count"))
    agg = names.select("company_id").distinct().join(agg, "company_id", "left")
    avg = F.round(F.col("avg_sentiment"), 6)
    return agg.select("company_id", avg.alias("avg_sentiment"),
                      F.coalesce("post_count", F.lit(0).cast("bigint")).alias("post_count"),
                      F.when(avg.isNotNull(), sentiment_band(avg)).alias("sentiment_band"),
                      F.round(avg - F.lit(0.5), 6).alias("delta_to_neutral"),
                      (avg < 0.4).alias("below_alert"))


def recent_mentions(mentioned: DataFrame, n: int = 5) -> DataFrame:
    """O2 + T2: the ``n`` newest mentioning posts per company (WindowGroupLimit)."""
    w = Window.partitionBy("company_id").orderBy(F.col("timestamp").desc_nulls_last(),
                                                 F.col("post_id").desc())
    return (mentioned.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("company_id", F.col("rank").cast("int").alias("rank"), "post_id", "platform",
                    "sentiment_score",
                    # P17 badge: at least neutral is good
                    F.when(F.col("sentiment_score") >= GOOD_SENTIMENT, BADGE_GOOD).otherwise(BADGE_BAD)
                    .alias("sentiment_class")))


def keyword_flags(mentioned: DataFrame, keywords=FRAUD_KEYWORDS, text_col: str = "post_content") -> DataFrame:
    """One pass counting, per company, mentioning posts that contain each keyword.

    Returns one row per (company, keyword) with ``hits`` and ``flagged``.
    """
    low = F.lower(F.col(text_col))
    counts = mentioned.groupBy("company_id").agg(*[
        F.count_if(low.contains(kw.lower())).cast("bigint").alias(f"k{i}") for i, kw in enumerate(keywords)])
    pairs = ", ".join(f"'{kw.replace(chr(39), chr(39) * 2)}', k{i}" for i, kw in enumerate(keywords))
    hits = F.col("hits").cast("bigint")
    return (counts.select("company_id", F.expr(f"stack({len(keywords)}, {pairs}) AS (keyword, hits)"))
            .select("company_id", "keyword", python_title(F.col("keyword")).alias("keyword_title"),
                    hits.alias("hits"), (hits > 0).alias("flagged"),
                    F.when(hits > 0, F.concat(F.lit(HIT_LABEL[0]), hits.cast("string"), F.lit(HIT_LABEL[1])))
                    .otherwise(F.lit(NO_HIT_LABEL)).alias("label")))
