"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.ordering import running_totals
from riskloom.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
PERCENT = 150
EPOCHS = 2


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT,
                   epochs: int = EPOCHS) -> DataFrame:
    """One row per source: no_source, src, source_size, target.

    ``sizes`` has no_source (boolean), src (not null) and size. Sources in code
    point order, null last, take the ``weights`` in turn and share ``percent`` %
    of all sizes; no target exceeds ``epochs`` times its source's size, what is
    above goes to the others by weight until none is above. The level at which
    that ends is found with one small aggregate over the sources a step.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
    ranked = running_totals(totals, [], ["no_source", "src"], "one", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = stored(ranked.select("no_source", "src", "source_size", weight.alias("weight"),
                                   (F.col("source_size") * epochs).alias("cap")), "sources")
    everything, heft = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    share = (everything or 0) * percent / 100
    level = share / heft if heft else 0.0
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        capped, rest = sources.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        new = (share - (capped or 0)) / rest if rest else level
        if new <= level:
            break
        level = new
    return sources.select("no_source", "src", "source_size",
                          F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT,
                epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): how many of its words the mix takes.

    Returns doc_id, source, size, source_size, target, taken. A source is taken
    whole as often as its target allows; of the next round its rows are taken
    in the order of ``md5(seed:doc_id)`` until the target, rounded to a whole
    word, is met exactly: the row at the cut gives only the missing words.

    Defined cases: null or empty text has size 0 and gives nothing; null
    sources are one source, ordered last; a null doc_id hashes as empty; rows
    with equal keys are ordered by doc_id and size; a source without words has
    target 0; an empty table gives no rows. Other columns are not read.
    """
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
        word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(rows, weights, percent, epochs)
    ordered = running_totals(rows, ["no_source", "src"], ["key", "doc_id", "size"], "size", "before")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    return (ordered.join(targets, ["no_source", "src"])
            .withColumn("budget", budget).withColumn("rounds", rounds)
            .withColumn("left", F.col("budget") - F.col("rounds") * F.col("source_size"))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("rounds") * F.col("size")
                     + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before"))))
                    .cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT,
                    epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs`` repeated, cut and left out as ``mix_sources`` says.

    Columns are those of ``docs``. The row at a source's cut ends after its
    last taken word (n_chars, if there, follows). Of rows that agree in doc_id,
    source and size, null ids included, as many give as many words as rows of
    the mix do, those of the smaller md5 of the text first.
    """
    names = docs.columns
    # rows are numbered within what the mix cannot tell apart; so each is taken as one row of the mix is
    alike = ["__id", "__no_id", "__src", "__no_src", "__size"]
    key = [F.coalesce(F.col("doc_id"), F.lit(-1)).alias("__id"), F.col("doc_id").isNull().alias("__no_id"),
           F.coalesce("source", F.lit("")).alias("__src"), F.col("source").isNull().alias("__no_src")]
    taken = mix_sources(docs, weights, percent, epochs, seed).select(*key, F.col("size").alias("__size"), "taken")
    # of alike rows at most one is cut: rows of the same taken words are counted, and number ranges dealt to them
    runs = (taken.groupBy(*alike, "taken").agg(F.count("*").alias("__rows"))
            .withColumn("__to", F.sum("__rows").over(Window.partitionBy(*alike).orderBy(F.desc("taken"))))
            .withColumn("__from", F.col("__to") - F.col("__rows")).where("taken > 0")
            .select(*alike, "__from", "__to", F.col("taken").alias("__taken")))
    rows = docs.select(*names, *key, word_count(F.col("text")).alias("__size"))
    copies = F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")).cast("int"))
    words = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    cut = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"),
                                                            words.cast("string"), F.lit("}+")), F.lit(0))
    # only ids that stand on several rows need a number
    several = taken.groupBy(*alike).agg(F.count("*").alias("__all")).where("__all > 1").drop("__all")
    several = stored(several, "alike")
    order = F.row_number().over(Window.partitionBy(*alike).orderBy(F.md5("text"))) - 1
    repeated = rows.join(several, alike, "left_semi").withColumn("__nth", order.cast("long"))
    single = rows.join(several, alike, "left_anti").withColumn("__nth", F.lit(0).cast("long"))
    out = (single.unionByName(repeated).join(runs, alike).where("__nth >= __from and __nth < __to")
           .withColumn("__copy", F.explode(copies))
           .withColumn("text", F.when(words < F.col("__size"), cut).otherwise(F.col("text"))))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(words < F.col("__size"), F.length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    return out.select(*names)
