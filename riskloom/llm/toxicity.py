"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

For each class, a model gives every character of a word its probability after
the up to ``order - 1`` characters before it (a word begins and ends with a
mark). Counts are in how many documents a word stands, so that a repeated line
counts once. The longest n-grams are counted by class and discounted; what the
discount frees goes to the next shorter n-gram, whose Kneser-Ney continuation
counts (in how many distinct contexts it stands) are shared by both classes.
All n-grams of the training rows are kept. One that was never seen is left to
the shared counts in both models, times what each class frees in its context, so
it says how much more one class frees there than the other.

A text's evidence is the difference of its log-likelihoods under the toxic and
the ordinary model, divided by its number of words. One logistic function, fit
on a bounded sample of the training rows, turns it into a score from 0 to 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.store import stored
from riskloom.session import ship_package

ORDER = 5
MIN_COUNT = 1
DISCOUNT = 0.75
LABELS_BROADCAST = 2_000_000   # rows of labels (16 bytes each); more are joined by a shuffle
MODEL_SLICE = 500_000          # n-grams of the model that one scoring pass broadcasts
FIT_ROWS = 20_000              # labelled rows the logistic function is fit on
WORDS_HELD = 300_000           # words a task keeps before it hands on their counts
BEGIN, END = "\x02", "\x03"
OTHER = "\x00"   # stands in the model for every character not seen after a context
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, order: int) -> Iterator[str]:
    """The n-gram of each character of the word and of its end, as long as the order allows."""
    marked = BEGIN + word + END
    for i in range(1, len(marked)):
        yield marked[max(0, i - order + 1):i + 1]


def _count(order: int):
    def rows(count: Counter) -> pd.DataFrame:
        total: dict[str, list[int]] = {}
        for (word, toxic), n in count.items():
            for g in grams(word, order):
                total.setdefault(g, [0, 0])[toxic] += n
        return pd.DataFrame({"gram": list(total), "ordinary": [v[0] for v in total.values()],
                             "toxic": [v[1] for v in total.values()]},
                            columns=["gram", "ordinary", "toxic"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter = Counter()
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                count.update((w, int(toxic)) for w in set(words(text)))
                if len(count) > WORDS_HELD:
                    yield rows(count)
                    count.clear()
        if count:
            yield rows(count)
    return run


def train(labelled: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT,
          discount: float = DISCOUNT) -> DataFrame:
    """(gram, llr): log of toxic over ordinary probability of the n-gram's last character.

    A context followed by OTHER has the log of toxic over ordinary backoff weight,
    for n-grams that are not in the model (unseen, or in fewer than ``min_count``
    documents of both classes together).

    ``labelled`` has text and toxic (0 or 1), one row per document; all rows
    are counted. Null texts count nothing. No rows give an empty model.
    """
    ship_package(labelled.sparkSession)
    top = stored(labelled.select("text", "toxic").mapInPandas(_count(order), "gram string, ordinary long, toxic long")
                 .groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "grams")
    head = F.expr("substring(gram, 1, length(gram) - 1)")
    tail = F.expr("substring(gram, 2)")
    # shared lower orders: distinct one-longer n-grams that end in it
    every = top.select(F.explode(F.expr(
        "transform(sequence(1, length(gram)), i -> substring(gram, i))")).alias("gram")).distinct()
    cont = (every.where("length(gram) > 1").groupBy(tail.alias("gram")).agg(F.count("*").alias("n"))
            .withColumn("ctx", head))
    of = cont.groupBy("ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    terms = stored(cont.join(of, "ctx").select(
        F.col("gram").alias("suffix"), (F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("all")).alias("own"),
        (F.lit(discount) * F.col("kinds") / F.col("all")).alias("rest")), "terms")
    letters = terms.where("length(suffix) = 1").count()
    chain = (top.select("gram", F.explode(F.expr("transform(sequence(2, length(gram)), i -> substring(gram, i))"))
                        .alias("suffix"))
             .join(terms, "suffix")
             .groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(F.length("suffix").alias("n"), "own", "rest")))
                                  .alias("terms"))
             .select("gram", F.aggregate("terms", F.lit(1.0 / max(1, letters)),
                                         lambda p, t: t["own"] + t["rest"] * p).alias("shared")))
    top = top.withColumn("ctx", head)
    by_ctx = top.groupBy("ctx").agg(*[f(c) for c in ("ordinary", "toxic") for f in (
        lambda c: F.sum(c).alias(f"{c}_all"), lambda c: F.sum((F.col(c) > 0).cast("int")).alias(f"{c}_kinds"))])

    def prob(c: str) -> Column:
        return F.when(F.col(f"{c}_all") > 0, (
            F.greatest(F.col(c) - discount, F.lit(0.0)) + F.lit(discount) * F.col(f"{c}_kinds") * F.col("shared"))
            / F.col(f"{c}_all")).otherwise(F.col("shared"))

    def rest(c: str) -> Column:
        return F.when(F.col(f"{c}_all") > 0, F.lit(discount) * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(1.0)

    seen = (top.where(F.col("ordinary") + F.col("toxic") >= min_count).join(by_ctx, "ctx").join(chain, "gram")
            .select("gram", F.log(prob("toxic") / prob("ordinary")).alias("llr")))
    return stored(seen.unionByName(by_ctx.select(F.concat("ctx", F.lit(OTHER)).alias("gram"),
                                                 F.log(rest("toxic") / rest("ordinary")).alias("llr"))), "model")


def _evidence(sent, order: int, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = sent.value, {}
        for pdf in batches:
            total, count = np.zeros(len(pdf)), np.zeros(len(pdf), np.int64)
            for i, text in enumerate(pdf["text"]):
                ws = words(text)
                if len(known) > WORDS_HELD:
                    known.clear()
                for w in set(ws).difference(known):
                    known[w] = sum(model[g] if g in model else model.get(g[:-1] + OTHER, 0.0) for g in grams(w, order))
                total[i] = sum(map(known.__getitem__, ws))
                count[i] = len(ws)
            yield pdf[keep].assign(total=total, words=count)
    return run


def evidence(docs: DataFrame, model: DataFrame, keep: str, order: int = ORDER) -> DataFrame:
    """Columns ``keep`` (a schema string) of every row, and ``evidence``: log-likelihood ratio per word.

    0 without words. A model of more than MODEL_SLICE n-grams is applied in
    slices of that size, one pass over the texts each, whose sums are added.
    """
    spark = docs.sparkSession
    ship_package(spark)
    names = [c.split()[0] for c in keep.split(", ")]
    rows = model.count()
    slices = max(1, -(-rows // MODEL_SLICE))
    if slices > 1:
        docs = docs.withColumn("__row", F.monotonically_increasing_id())
        keep, names = keep + ", __row long", [*names, "__row"]
    parts = None
    for k in range(slices):
        # all n-grams of a context and its backoff weight are in one slice
        part = model.where(F.pmod(F.xxhash64(F.expr("substring(gram, 1, length(gram) - 1)")), F.lit(slices)) == k).toPandas()
        sent = spark.sparkContext.broadcast(dict(zip(part["gram"], part["llr"])))
        got = docs.mapInPandas(_evidence(sent, order, names), f"{keep}, total double, words long")
        parts = got if parts is None else parts.unionByName(got)
    if slices > 1:
        shown = names[:-1]
        parts = parts.groupBy("__row").agg(*[F.first(n).alias(n) for n in shown], F.sum("total").alias("total"),
                                           F.first("words").alias("words")).drop("__row")
    return parts.withColumn("evidence", F.when(F.col("words") > 0, F.col("total") / F.col("words")).otherwise(0.0)) \
        .drop("total", "words")


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic regression of y on x (slightly ridged, Newton steps)."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, -1.0
    scale = float(np.std(x)) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hess, a.T @ (y - p) - np.array([1e-3, 1e-6]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Learns from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id as text)
    mod 5 is not 0; only the text enters a score. Defined cases: a null or
    empty text, or one without words, has evidence 0 and the score that goes
    with it; a null doc_id is scored, not held out and never learned from; a
    doc_id labelled twice is toxic if any label says so, null labels are
    ignored; rows that repeat a doc_id are scored each; without labels of both
    classes scores follow the evidence alone; very long texts are scored whole;
    columns beyond those named are not read; an empty table gives no rows.
    """
    return _judged(docs, labels, order).select("doc_id", "held_out", "score", "predicted")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _judged(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """``toxicity_scores`` with the digest of the row's text, on which alone the score depends."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       _digest(F.col("text")).alias("digest"))
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    if labels.count() <= LABELS_BROADCAST:
        known = F.broadcast(known)
    model = train(docs.join(known, "doc_id"), order)
    rows = stored(evidence(docs, model, "doc_id long, digest string", order), "evidence")
    fit = (rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "evidence").limit(FIT_ROWS)
           .select("evidence", "toxic").toPandas())
    slope, shift = fit_logistic(fit["evidence"].to_numpy(float), fit["toxic"].to_numpy(float))
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(shift))))
    return (rows.withColumn("score", score)
            .select("doc_id", "digest", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Every row is judged by its own text, whatever rows share its doc_id or have
    none either.
    """
    toxic = (_judged(docs, labels).where("predicted = 1")
             .select(F.col("doc_id").alias("__toxic"), F.col("digest").alias("__digest")).distinct())
    return docs.join(toxic, docs["doc_id"].cast("long").eqNullSafe(toxic["__toxic"])
                     & (_digest(docs["text"]) == toxic["__digest"]), "left_anti")
