"""Which of many keywords each text contains, in one pass over the texts (F13, G9, J5 with long lists).

All keywords are compiled into one Aho-Corasick automaton, which reads a text
once however many keywords there are, and the plan has the same size for five
keywords as for thousands. A list of more than ``SLICE_CHARS`` characters is
dealt to several automata by hash, each built and sent by itself, so that what
is broadcast and what the driver holds at once stay bounded; every automaton
reads the texts once more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import cut_lineage, ship_package

SLICE_CHARS = 1_000_000    # at most a node for each; about 60 MB a worker
ROWS_HELD = 100_000
_automata: dict[int, object] = {}


def compile_automaton(words: list[str]) -> bytes:
    import ahocorasick
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return pickle.dumps(a)


def _automaton(sent):
    """Unpacked once a worker."""
    key = hash(sent.value)
    if key not in _automata:
        _automata.clear()
        _automata[key] = pickle.loads(sent.value)
    return _automata[key]


def _matches(sent, n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent)

        def out(b: pa.RecordBatch, rows: list[int], words: list[str]) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n_keep)), pa.array(words, pa.string())],
                                              names=[*b.schema.names[:n_keep], "keyword"])

        for b in batches:
            rows: list[int] = []
            words: list[str] = []
            for i, text in enumerate(b.column(n_keep)):
                found = {w for _, w in automaton.iter(text.as_py() or "")}
                words += found
                rows += [i] * len(found)
                if len(rows) > ROWS_HELD:
                    yield out(b, rows, words)
                    rows, words = [], []
            if rows:
                yield out(b, rows, words)
    return run


def keyword_matches(df: DataFrame, keywords: DataFrame, keep: list[str], text_col: str = "post_content",
                    keyword_col: str = "keyword", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(*keep, keyword): a row for each row of ``df`` and each different keyword its text contains.

    Case is ignored as ``lower(text) LIKE '%keyword%'`` does, keywords come back
    lower-cased and are taken literally. NULL texts contain nothing, NULL
    keywords are left out, and the empty keyword is in every text.
    """
    spark = df.sparkSession
    ship_package(spark)
    words = cut_lineage(keywords.select(F.lower(F.col(keyword_col)).alias("keyword")).where("keyword is not null").distinct())
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("keyword", T.StringType())])
    texts = df.select(*keep, F.lower(F.col(text_col)).alias("_text")).where("_text is not null")
    chars, blank = words.agg(F.sum(F.length("keyword")), F.max(F.col("keyword") == "")).first()
    slices = -(-(chars or 0) // slice_chars)
    parts = []
    for i in range(slices):
        own = [r[0] for r in words.where((F.col("keyword") != "") & (F.pmod(F.xxhash64("keyword"), F.lit(slices)) == i)).collect()]
        if own:
            sent = spark.sparkContext.broadcast(compile_automaton(own))
            parts.append(texts.mapInArrow(_matches(sent, len(keep)), schema))
    if blank:
        parts.append(texts.select(*keep, F.lit("").alias("keyword")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def keyword_counts(df: DataFrame, keywords: DataFrame, by: list[str], text_col: str = "post_content",
                   keyword_col: str = "keyword") -> DataFrame:
    """(*by, keyword, hits): how many rows of each group contain each keyword; groups without hits have no row."""
    return (keyword_matches(df, keywords, by, text_col, keyword_col)
            .groupBy(*by, "keyword").agg(F.count(F.lit(1)).cast("bigint").alias("hits")))
