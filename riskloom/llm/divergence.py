"""Source divergence audit: which sources of a language use its words differently, and which words.

Term frequencies come from single-pass in-memory indexing. A task reads its
texts once and builds block postings, (language, source) -> term -> occurrences
and documents, in memory. When they fill ``block_entries`` entries they leave
as a run sorted by language, term and source, and the block starts anew. Runs
are dealt to shards by a hash of (language, term), and the shuffle's external
sort merges a shard's runs (a heap over spilled runs) into frequencies.
However often a term occurs, a shard gets one row of it for each run and source.

Two sources are compared over all kept terms of their language, most of which
stand in neither of both or in one only. Their divergence is

    V * f(a0, b0)                                  as if no term stood in either
    + sum over terms of a: f(a(t), b0) - f(a0, b0)     from a's histogram of counts
    + sum over terms of b: f(a0, b(t)) - f(a0, b0)     from b's
    + sum over shared terms: f(a(t), b(t)) - f(a(t), b0) - f(a0, b(t)) + f(a0, b0)

where a0 is the smoothed share of a term that a lacks. The last line is the
pair corrections: they are streamed from the postings of each term and folded
into sums for each pair of sources inside the task, so that pairs of postings
are never rows. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.store import dropped, stored
from riskloom.operators.joins import join_bounded
from riskloom.session import ship_package

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
BLOCK_ENTRIES = 400_000   # postings a task holds before it spills a run
PAIR_SUMS = 500_000       # sums of source pairs a task holds before it hands them on
CHUNK = 1 << 22           # bytes of a text whose words are held at once
# in UTF-8 every byte of a character beyond ASCII is 0x80 or more, so bytes tell terms as code points do
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_RUN = "lang string, term string, source string, n long, docs long"


def _pieces(text: bytes) -> Iterator[tuple[int, int]]:
    """Consecutive pieces of about CHUNK bytes, none ending inside a term."""
    a = 0
    while a < len(text):
        m = _BREAK.search(text, a + CHUNK)
        b = m.start() if m else len(text)
        yield a, b
        a = b


def _run(block: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """The block's postings as a run sorted by language, term and source."""
    rows = [(lang, term, source, n, docs[term]) for (lang, source), (counts, docs) in block.items()
            for term, n in counts.items()]
    rows.sort(key=lambda r: r[:3])
    for i in range(0, len(rows), 50_000):
        part = list(zip(*rows[i:i + 50_000]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[0], pa.string()), pa.array(part[1], pa.binary()).cast(pa.string()),
             pa.array(part[2], pa.string()), pa.array(part[3], pa.int64()), pa.array(part[4], pa.int64())],
            names=["lang", "term", "source", "n", "docs"])


def _runs(entries: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        groups: set[tuple[str, str]] = set()
        held = 0
        for b in batches:
            langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
            for key, text in zip(zip(langs, sources), pc.cast(b.column("text"), pa.binary())):
                groups.add(key)
                counts, docs = block.setdefault(key, (Counter(), Counter()))
                before = len(counts)
                text, distinct = text.as_py().lower(), set()  # bytes.lower() maps A-Z only
                for x, y in _pieces(text):
                    words = _TERM.findall(text, x, y)
                    counts.update(words)
                    distinct.update(words)
                docs.update(distinct)
                held += len(counts) - before
                if held > entries:
                    yield from _run(block)
                    block, held = {}, 0
        yield from _run(block)
        if groups:  # a group is there even without a term
            lang, source = zip(*sorted(groups))
            none = pa.nulls(len(groups), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.nulls(len(groups), pa.string()), pa.array(source, pa.string()),
                 none, none], names=["lang", "term", "source", "n", "docs"])
    return index


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term with ``n`` of ``total`` occurrences among ``terms`` terms, in billionths."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, below = F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * terms)
    return F.when(below > 0, F.lit(1) + F.call_function("div", top, below)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers up to 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): sums over the shared terms of this task, whose rows come sorted by lang and term.

    A pair of sources may come as (a, b) or (b, a), and in several rows.
    """
    number: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}

    def out() -> pa.RecordBatch:
        names = list(number)
        pairs = [(names[k >> 32], names[k & 0xFFFFFFFF], v) for k, v in sums.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x, _, _ in pairs], pa.string()), pa.array([x[1] for x, _, _ in pairs], pa.string()),
             pa.array([y[1] for _, y, _ in pairs], pa.string()), pa.array([v for *_, v in pairs], pa.int64())],
            names=["lang", "a", "b", "value"])

    def add(t: pa.Table) -> None:
        if not len(t):
            return
        langs, sources = t.column("lang").to_pylist(), t.column("source").to_pylist()
        ids = np.fromiter((number.setdefault(g, len(number)) for g in zip(langs, sources)), np.int64, len(t))
        p, none = t.column("p").to_numpy(), t.column("p0").to_numpy()
        new = np.zeros(len(t), bool)
        for c in ("lang", "term"):
            codes = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        term = np.cumsum(new)
        step = 1
        while True:  # rows of one term that stand ``step`` apart
            x = np.flatnonzero(term[step:] == term[:-step]) if step < len(term) else []
            if not len(x):
                return
            y = x + step
            f = _f(p[x], p[y]) - _f(p[x], none[y]) - _f(none[x], p[y]) + _f(none[x], none[y])
            key = np.minimum(ids[x], ids[y]) << 32 | np.maximum(ids[x], ids[y])
            keys, at = np.unique(key, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, f)
            for k, v in zip(keys.tolist(), total.tolist()):
                sums[k] = sums.get(k, 0) + v
            step += 1

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not len(t):
            continue
        # the last term may go on in the next batch
        last = pc.and_(pc.equal(t.column("term"), t.column("term")[-1]), pc.equal(t.column("lang"), t.column("lang")[-1]))
        whole = len(t) - pc.sum(last).as_py()
        add(t.slice(0, whole))
        rest = t.slice(whole)
        if len(sums) > PAIR_SUMS:
            yield out()
            sums.clear()
    if rest is not None:
        add(rest)
    if sums:
        yield out()


def frequencies(docs: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(lang, term, source, n, docs, all_n, all_docs): every term's occurrences and documents in every source.

    ``all_n`` and ``all_docs`` are those in the whole language. Every group also
    has a row with null term. Null lang, source or text count as ''.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    runs = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_runs(block_entries), _RUN)
    of_term = Window.partitionBy("lang", "term")
    # one shuffle: a shard holds all sources of its terms
    return (runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "term")
            .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumn("all_n", F.sum("n").over(of_term)).withColumn("all_docs", F.sum("docs").over(of_term)))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
                      block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Divergence of each source of ``docs`` (text, lang, source) from the others of its language.

    Returns lang, source, part, item, value long, rank int. Part ``pair`` ranks
    every other source of the language by the divergence from it, part ``term``
    the ``top_terms`` terms that the source uses most above the language. Ranks
    go by falling value, then by item in UTF-8 order. A term is kept for a
    language if at least ``min_docs`` of its documents hold it.

    Defined cases: null text, lang or source is ''; rows that repeat a document
    are documents each; a text without terms only makes its group known; a
    language without kept terms gives pairs of value 0; a language of one
    source no pairs; an empty table gives no rows. Texts of any length are read
    whole, in pieces. Other columns are not read.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = stored(frequencies(docs, block_entries), "frequencies")
    kept = every.where(F.col("term").isNotNull() & (F.col("all_docs") >= min_docs)).drop("docs", "all_docs")
    groups = every.where("term is null").select("lang", "source").distinct()
    by_lang = kept.groupBy("lang", "term").agg(F.max("all_n").alias("n")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # as many rows as groups
    stats = (groups.join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left")
             .na.fill(0, ["v", "lang_n", "total"]))
    stats = stored(stats.withColumn("p0", F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(1))), "groups")

    scored = stored(join_bounded(kept, stats, ["lang", "source"])
                    .withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))), "scored")
    above = (scored.withColumn("q", share(F.col("all_n"), F.col("lang_n"), F.col("v"))).where("n > 0 and p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     divergence(F.col("p"), F.col("q")).alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    terms = above.withColumn("rank", rank).where(F.col("rank") <= top_terms)

    a, b = stats.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "v"), \
        stats.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").where("a <> b")
    base = divergence(F.col("a0"), F.col("b0"))
    # terms of one source against a source that lacks them: by the source's distinct counts, not by term
    histogram = scored.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("terms"))
    single = (histogram.join(pairs.drop("v"), ["lang", "a"])
              .groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (divergence(F.col("p"), F.col("b0")) - base))
                                             .alias("value")))
    shared = (scored.select("lang", "term", "source", "p", "p0")
              .repartition(shards, "lang", "term").sortWithinPartitions("lang", "term", "source")
              .mapInArrow(_corrections, "lang string, a string, b string, value long")
              .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    parts = (pairs.select("lang", "a", "b", (F.col("v") * base).alias("value"))
             .unionByName(single).unionByName(turned(single)).unionByName(shared).unionByName(turned(shared)))
    value = parts.groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    value = value.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    found = value.withColumn("rank", rank).unionByName(terms)
    dropped(every)
    return found
