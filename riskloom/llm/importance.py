"""Quality classifier by importance resampling over hashed n-grams.

Two generative models give every hashed word and word pair a probability: one
from the target texts (labelled good), one from all raw texts, whose counts are
scaled to the same total before SMOOTH is added to both. A document's log
importance weight is the sum of its n-grams' log ratios. Gumbel top-k (weight
plus Gumbel noise derived from doc_id, the k largest win) samples k documents
without replacement in proportion to the weights.

The number of hash buckets is a power of two at or above the corpus's number of
distinct n-grams (estimated from its smallest hashes), so it grows with the
corpus and two n-grams seldom share a bucket at any size. Counts are a table;
the weights of up to SLICE buckets at a time are sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.ordering import running_totals
from riskloom.llm.shingles import U, chunks, mix, word_hashes
from riskloom.llm.store import stored
from riskloom.llm.toxicity import LABELS_BROADCAST, held_out
from riskloom.session import ship_package

LEAST = 1 << 14          # buckets of a small corpus
SMOOTH = 16.0            # added to every count, so that n-grams of few texts weigh little
SLICE = 1 << 25          # buckets whose weights one scoring pass broadcasts (a byte each, and the rare weights)
PIECE = 1 << 23          # buckets whose weights come to the driver at once
ODD = 255                # the byte of a weight that is not among the most frequent
SMALLEST = 4096          # smallest hashes from which distinct n-grams are estimated (standard error 1.6 %)
HELD = 1 << 21           # n-grams a task gathers before it hands on their counts
WIDTH = 1 << 16          # least buckets whose counts are handed on together
_PAIR = U(0xC2B2AE3D27D4EB4F)


def _ngrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index, 64-bit hashes of all words and word pairs) of every text."""
    for base, buf, offs in chunks(texts):
        h, at = word_hashes(buf, offs)
        two = mix(h[:-1] * _PAIR + h[1:]) if len(h) > 1 else h[:0]
        for d in range(len(offs) - 1):
            a, b = at[d], at[d + 1]
            yield base + d, np.concatenate([h[a:b], two[a:max(a, b - 1)]])


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = np.zeros(0, U)
    for b in batches:
        for _, g in _ngrams(b.column("text")):
            g >>= U(1)
            if len(keep) == SMALLEST:
                g = g[g < keep[-1]]
            if len(g):
                keep = np.unique(np.concatenate([keep, g]))[:SMALLEST]
    yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int64))], names=["h"])


def buckets_for(docs: DataFrame) -> int:
    """A power of two at or above the number of distinct words and word pairs of ``docs``, at least LEAST."""
    least = [r["h"] for r in docs.select("text").mapInArrow(_least, "h long").distinct().orderBy("h").limit(SMALLEST).collect()]
    n = len(least) if len(least) < SMALLEST else round((SMALLEST - 1) / (least[-1] / 2.0 ** 63))
    return max(LEAST, 1 << (max(1, n) - 1).bit_length())


def _width(buckets: int) -> int:
    """Buckets whose counts are handed on and added together."""
    return max(WIDTH, buckets >> 12)


def _planes(x: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones, and so on: mostly zeros, which the shuffle's compression removes."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _count(buckets: int):
    width = _width(buckets)

    def added(held: list[tuple[np.ndarray, bool]]) -> pa.RecordBatch:
        every = np.concatenate([g for g, _ in held])
        good = np.repeat([x for _, x in held], [len(g) for g, _ in held])
        used, at = np.unique(every, return_inverse=True)
        raw, target = np.bincount(at, minlength=len(used)), np.bincount(at[good], minlength=len(used))
        part = used // width
        ends = [*(np.flatnonzero(np.diff(part)) + 1), len(used)]
        rows, first = [], 0
        for end in ends:
            rows.append((part[first], _planes(np.diff(used[first:end], prepend=part[first] * width)),
                         _planes(raw[first:end]), _planes(target[first:end])))
            first = end
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 3))],
                                          names=["part", "steps", "raw", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            good = b.column("good").to_pylist()
            for i, g in _ngrams(b.column("text")):
                held.append(((g & U(buckets - 1)).astype(np.int64), good[i]))
                size += len(g)
                if size > HELD:
                    yield added(held)
                    held, size = [], 0
        if size:
            yield added(held)
    return run


def _summed(buckets: int):
    width = _width(buckets)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        raw, target = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for steps, r, t in zip(rows.column("steps"), rows.column("raw"), rows.column("target")):
            at = np.cumsum(_numbers(steps))   # each bucket once
            raw[at] += _numbers(r)
            target[at] += _numbers(t)
        used = np.flatnonzero(raw)
        return pa.table({"bucket": used + key[0].as_py() * width, "raw": raw[used], "target": target[used]})
    return run


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-grams of ``rows`` (text, good) in each used bucket, of all and of good texts.

    A task hands on its counts by ranges of buckets, as the steps from one used bucket to the next and the
    counts, in place of a row for each bucket.
    """
    return (rows.mapInArrow(_count(buckets), "part long, steps binary, raw binary, target binary")
            .groupBy("part").applyInArrow(_summed(buckets), "bucket long, raw long, target long"))


def _weigh(sent, first: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, table, odd_at, odd = sent.value
        for b in batches:
            out = np.zeros(len(b))
            for i, g in _ngrams(b.column("text")):
                at = (g & U(buckets - 1)).astype(np.int64) - first
                if len(codes) < buckets:
                    at = at[(at >= 0) & (at < len(codes))]
                code = codes[at]
                weight, rare = table[code], code == ODD
                weight[rare] = odd[np.searchsorted(odd_at, at[rare].astype(np.int32))]
                out[i] = weight.sum(dtype=float)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(out)],
                                             names=["row", "doc_id", "log_weight"])
    return run


def _coded(ratios: DataFrame, first: int, size: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights of ``size`` buckets: a byte for each (0: none), the weights of the bytes, and the rare ones by bucket."""
    codes, table, odd_at, odd = np.zeros(size, np.uint8), np.zeros(ODD + 1, np.float32), [], []
    table[1:len(common) + 1] = common
    for start in range(first, first + size, PIECE):
        part = ratios.where(F.col("bucket").between(start, min(start + PIECE, first + size) - 1)).toArrow()
        at, llr = part.column("bucket").to_numpy() - first, part.column("llr").to_numpy()
        place = np.minimum(np.searchsorted(common, llr), len(common) - 1)
        rare = common[place] != llr
        codes[at] = np.where(rare, ODD, place + 1)
        odd_at.append(at[rare].astype(np.int32))
        odd.append(llr[rare])
    odd_at, odd = np.concatenate(odd_at), np.concatenate(odd)
    order = np.argsort(odd_at)
    return codes, table, odd_at[order], odd[order]


def _weights(docs: DataFrame, ratios: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, log_weight) of every row of ``docs``; one pass over the texts for every SLICE buckets, sums added."""
    spark, parts = docs.sparkSession, None
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    # most buckets hold few n-grams, so that few different weights are most of them
    often = ratios.groupBy("llr").count().orderBy(F.desc("count"), "llr").limit(ODD - 1).toArrow()
    common = np.sort(often.column("llr").to_numpy())
    for first in range(0, buckets, SLICE):
        sent = spark.sparkContext.broadcast(_coded(ratios, first, min(SLICE, buckets), common))
        got = docs.mapInArrow(_weigh(sent, first, buckets),
                              "row long, doc_id long, log_weight double")
        parts = got if parts is None else parts.unionByName(got)
    if buckets > SLICE:
        parts = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("log_weight").alias("log_weight"))
    return parts.drop("row")


def gumbel(doc_id: Column, seed: str) -> Column:
    """Standard Gumbel noise from the digest of seed and doc_id (52 bits)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13),
               16, 10).cast("double")
    return -F.log(-F.log((h + 0.5) / F.lit(float(1 << 52))))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: str = "dsir") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, log_weight, gumbel_key, kept.

    Target texts are those with quality 1 in ``labels`` (doc_id, quality),
    held-out rows excepted; raw texts are all of ``docs``. ``share`` of the rows
    are sampled; without it, the share of quality 1 among the labels learned
    from. Counts go over all rows.

    Defined cases: a null or empty text has weight 0 (log); a null doc_id hashes
    as empty and is no target; a doc_id labelled twice is good if all labels
    say so; ties in the key go to the smaller doc_id; without target texts all
    weights are 0; very long texts are counted and weighed whole; rows that
    repeat are weighed each; other columns are not read, whatever their names;
    an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("good")))
    if share is None:
        share = known.agg(F.avg("good")).first()[0] or 0.0
    if labels.count() <= LABELS_BROADCAST:
        known = F.broadcast(known)
    buckets = buckets_for(docs)
    counts = stored(bucket_counts(docs.join(known, "doc_id", "left")
                                  .select("text", F.coalesce(F.col("good") == 1, F.lit(False)).alias("good")), buckets), "counts")
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    # the raw counts are scaled to the target's total and smoothed alike, so that n-grams
    # of few texts, which are most of them, have ratios near 1 in place of noise
    llr = F.log((F.col("target") + SMOOTH) / (F.col("raw") * F.lit(float(target) / float(raw)) + SMOOTH)) if target else F.lit(0.0)
    rows = _weights(docs, counts.select("bucket", llr.cast("float").alias("llr")), buckets)
    rows = stored(rows.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
                  .withColumn("less", -F.col("gumbel_key")).withColumn("one", F.lit(1)), "weights")
    k = round(share * rows.count())
    return (running_totals(rows, [], ["less", "doc_id"], "one", "rank")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "log_weight", "gumbel_key",
                    (F.col("rank") < k).alias("kept")))
