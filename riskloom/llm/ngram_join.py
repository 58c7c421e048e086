"""N-gram Jaccard join: size-aware heavy-light set-similarity join on word shingles.

Every pair of texts with ``100 * |A n B| >= percent * |A u B|`` is found:

* Copies (equal sets) are collapsed by a 128-bit digest of the set first.
* All shingles are ordered rare first. Frequencies are counted over all
  documents into a table of fixed size (2**20 counters, 4 MB), which is what
  gets broadcast; any such order is right, frequencies only make it cheap.
* A set of n shingles can only link with sets that share
  ``c = ceil(percent * n / 100)`` of them, so two linked sets share ``k``
  members of their first ``n - c + k`` shingles. Small sets enumerate the
  2-subsets of that prefix (k = 2); large sets put their prefix (k = 1) into
  inverted lists that are scanned. Sets just below the boundary enter both, so
  no pair across it is lost. The boundary is the size at which the summed
  cost of subsets and list scans, over the histogram of all sizes, is least.
* Sharing a key makes a candidate, if what stands before the key in both
  orders still leaves enough to share (so that one of the two, the smaller,
  has the key in the yet shorter prefix that partners no smaller need).
  Candidates between sets already connected are not tested. Star rounds test every set against one other of its lists
  (never all pairs of a list), of those that stand for its lists the one most
  alike. After each, the components of all links found are the labels, and lists
  within one label are done. What is left between different components is then
  tested pair by pair. Of each set 256 bits are kept, which
  tell for 256 hash classes whether it has an odd number of members there. Where
  two sets' bits differ, the class holds a member of one set only, so pairs that
  differ in more bits than linked sets have members of one only are no
  candidates: sets that share a passage and little else leave the join there.
  Each test counts the exact intersection of the whole texts' shingles.

Equality of shingles is equality of 64-bit hashes. Shingle lists are never
gathered: a key's rows meet only in partial aggregates and joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.graph import components
from riskloom.llm.shingles import U, mix, shingle_sets
from riskloom.llm.store import dropped, stored
from riskloom.session import ship_package

SKETCH_BITS = 20
BLOCK_BITS = 16
SIZE_BINS = 4096
STAR_ROUNDS = 4
ODD = ("odd0", "odd1", "odd2", "odd3")
VERIFY_BYTES = 4 << 20   # of texts that a task compares at once


def _needed(n, percent: int):
    """Members a set of n must share with any set it links to."""
    return (percent * n + 99) // 100


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            n = np.zeros(len(b), np.int64)
            d = np.zeros((2, len(b)), np.uint64)
            odd = np.zeros((len(b), 64 * len(ODD)), np.uint8)
            for i, s in shingle_sets(b.column("text"), width):
                n[i] = len(s)
                d[:, i] = np.sum(mix(s + U(1))), np.sum(mix(s ^ U(0xA5A5A5A5A5A5A5A5)) * U(3))
                np.add.at(counts, (s & U((1 << SKETCH_BITS) - 1)).view(np.int64), 1)
                odd[i] = np.bincount((mix(s) % U(odd.shape[1])).view(np.int64), minlength=odd.shape[1]) & 1
            none = pa.nulls(len(b), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), pa.array(d[0].view(np.int64)),
                 pa.array(d[1].view(np.int64)), none, pa.nulls(len(b), pa.binary()),
                 *map(pa.array, np.packbits(odd, axis=1).view(np.int64).T)],
                names=["doc_id", "n", "d1", "d2", "block", "counts", *ODD])
        if counts.any():
            parts = counts.reshape(-1, 1 << BLOCK_BITS)
            k = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64())] * 4
                + [pa.array(np.arange(k, dtype=np.int32)), pa.array([p.tobytes() for p in parts])]
                + [pa.nulls(k, pa.int64())] * len(ODD),
                names=["doc_id", "n", "d1", "d2", "block", "counts", *ODD])
    return run


def _sum_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for block, raw in zip(pdf["block"], pdf["counts"]):
            part = np.frombuffer(raw, np.int64)
            total[block] = total[block] + part if block in total else part
    yield pd.DataFrame({"block": list(total), "counts": [v.tobytes() for v in total.values()]},
                       columns=["block", "counts"])


def _frequencies(rows: DataFrame) -> np.ndarray:
    """All counters, added up block by block; 2**SKETCH_BITS of them at any input size."""
    blocks = 1 << (SKETCH_BITS - BLOCK_BITS)
    # two levels, so that no task adds up the counters of all tasks alone
    part = (rows.where("block is not null").select("block", "counts")
            .repartition(blocks * 2, "block", F.xxhash64("counts") % 8)
            .mapInPandas(_sum_blocks, "block int, counts binary"))
    whole = part.repartition(blocks, "block").mapInPandas(_sum_blocks, "block int, counts binary")
    out = np.zeros((blocks, 1 << BLOCK_BITS), np.int64)
    for r in whole.collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), np.iinfo(np.int32).max).astype(np.int32)


def list_length(freq: np.ndarray, percent: int) -> float:
    """Expected length of the lists that a prefix (the rarest shingles) meets, from the counters."""
    c = np.sort(freq[freq > 0]).astype(np.float64)
    if not len(c):
        return 0.0
    share = np.cumsum(c) / c.sum()
    rare = c[: max(1, int(np.searchsorted(share, (100 - percent) / 100)))]
    return float(max(0.0, np.average(rare, weights=rare) - np.median(c)) * (100 - percent) / 100)


def choose_boundary(sizes: dict[int, int], length: float, percent: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, over all sets."""
    best, best_cost = 0, math.inf
    for x in [0, *sorted(s for s in sizes if s < SIZE_BINS)]:
        cost = 0.0
        for n, count in sizes.items():
            p = n - _needed(n, percent) + 1
            if n <= x:
                cost += count * math.comb(min(n, p + 1), 2)
            if n > x or n >= _needed(x, percent) and x:
                cost += count * p * (1 + length)
        if cost < best_cost:
            best, best_cost = x, cost
    return best


def _signatures(width: int, percent: int, boundary: int, freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = freq.value
        low = U((1 << SKETCH_BITS) - 1)
        light = _needed(boundary, percent) if boundary else 0
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            out, held = [], 0
            for i, s in shingle_sets(b.column("text"), width):
                n = len(s)
                if n < 2:
                    continue  # one shingle: only a copy can link with it
                p = n - int(_needed(n, percent)) + 1
                take = min(n, p + 1)
                f = table[s & low]
                pre = s[f <= np.partition(f, take - 1)[take - 1]] if take < n else s
                pre = pre[np.lexsort((pre, table[pre & low]))][:take]
                keys, slack = [], []
                if n <= boundary:
                    x, y = np.triu_indices(len(pre), 1)
                    keys.append(mix(pre[x] * U(0x9FB21C651E98DF25) + pre[y]))
                    slack.append(y - 1)
                if n > boundary or n >= light:
                    keys.append(pre[:p])
                    slack.append(np.arange(min(p, n)))
                out.append((ids[i], n, np.concatenate(keys), np.concatenate(slack)))
                held += len(out[-1][2])
                if held > 200_000:
                    yield _signature_rows(out)
                    out, held = [], 0
            if out:
                yield _signature_rows(out)
    return run


def _signature_rows(rows: list[tuple]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32))
    sigs = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[2] for r in rows]).view(np.int64)))
    slack = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[3] for r in rows]).astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), sigs, slack],
        names=["node", "n", "sigs", "slacks"])


def _linked(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a hub's text comes with every row of its star
        whole = lru_cache(maxsize=16)(
            lambda text: next(shingle_sets(pa.array([text], pa.large_string()), width))[1])
        for pdf in batches:
            ok = np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf["left"], pdf["right"])):
                s, r = whole(x), whole(y)
                both = len(np.intersect1d(s, r, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(s) + len(r) - both)
            yield pdf.loc[ok, ["a", "b"]]
    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones of ``pairs``, written; texts reach a task's Python in batches bounded by bytes."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    conf, name = pairs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name, None)
    conf.set(name, str(VERIFY_BYTES))
    try:
        return stored(pairs.select("a", "b").join(left, "a").join(right, "b")
                      .mapInPandas(_linked(width, percent), "a long, b long"), "links")
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _may(percent: int) -> tuple:
    """Conditions on a candidate: what stands before the key leaves enough to share; the sets' bits allow a link."""
    # two sets of n and m shingles link only if they share ``both`` of them
    both = f"ceil({percent} * (n + m) / {100 + percent})"
    differ = " + ".join(f"coalesce(bit_count({c} ^ their_{c}), 0)" for c in ODD)
    return (F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m) and slack <= n - {both} and others <= m - {both}"),
            F.expr(f"{differ} <= n + m - 2 * {both}"), F.expr(differ))


def _theirs(rows: DataFrame, node: str = "node") -> DataFrame:
    return rows.select(F.col(node).alias("other"), *(F.col(c).alias(f"their_{c}") for c in ODD))


def _star_pairs(act: DataFrame, bits: DataFrame, tested: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """(a, b): for every set the untested one, by the bits most alike, of those that stand for its lists in this turn."""
    may, alike, differ = _may(percent)
    # the smallest set at first, then another one for each list, so that a set meets many of a large group
    order = F.col("node") if turn == 0 else F.xxhash64("node", "sig", F.lit(turn))
    hub = act.groupBy("sig").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.min_by(F.struct("node", "n", "slack", "label"), F.when(F.col("first"), order)).alias("hub")) \
        .where("lo < hi").select("sig", F.col("hub.node").alias("other"), F.col("hub.n").alias("m"),
                                 F.col("hub.slack").alias("others"), F.col("hub.label").alias("theirs"))
    cand = (act.join(hub, "sig").where("label <> theirs").where(may).select("node", "other", "n", "m").distinct()
            .withColumns({"a": F.least("node", "other"), "b": F.greatest("node", "other")}))
    if tested is not None:
        cand = cand.join(tested, ["a", "b"], "left_anti")
    cand = cand.join(bits, "node", "left").join(_theirs(bits), "other", "left").where(alike)
    return (cand.groupBy("node").agg(F.min(F.struct(differ.alias("differ"), "a", "b")).alias("p"))
            .select("p.a", "p.b").distinct())


def _all_pairs(act: DataFrame, bits: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): the untested pairs of sets that are not yet connected."""
    may, alike, _ = _may(percent)
    act = act.join(bits, "node", "left")
    left = act.where("first").select("sig", F.col("node").alias("other"), F.col("n").alias("m"),
                                     F.col("slack").alias("others"), F.col("label").alias("theirs"),
                                     *(F.col(c).alias(f"their_{c}") for c in ODD))
    pairs = (act.join(left, "sig").where("label <> theirs and m <= n").where(may).where(alike)
             .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links, the row's own
    included. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

    Defined cases: a null or empty text (or one of white space only) has no
    shingles and links with nothing; rows that repeat a doc_id are one document
    with the links of all its rows; a null doc_id gives a null component and no
    links; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(docs.mapInArrow(
        _digests(width), "doc_id long, n long, d1 long, d2 long, block int, counts binary, "
        + ", ".join(f"{c} long" for c in ODD)), "digests")
    sets = rows.where("block is null").select("doc_id", "n", "d1", "d2", *ODD)
    nodes = stored(sets.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n")
                   .agg(F.min("doc_id").alias("node"), *(F.max(c).alias(c) for c in ODD)), "nodes")

    freq = _frequencies(rows)
    sizes = {r["s"]: r["c"] for r in nodes.groupBy(F.least("n", F.lit(SIZE_BINS)).cast("int").alias("s"))
             .agg(F.count("*").alias("c")).collect()}
    boundary = choose_boundary(sizes, list_length(freq, percent), percent)
    sent = spark.sparkContext.broadcast(freq)
    # ``slack``: members of the set before the key, which a partner that meets it there does not share
    sigs = stored(docs.where("doc_id is not null")
                  .mapInArrow(_signatures(width, percent, boundary, sent),
                              "node long, n int, sigs array<long>, slacks array<int>")
                  .join(nodes.select("node").distinct(), "node", "left_semi")
                  .select("node", "n", F.inline(F.arrays_zip(F.col("sigs").alias("sig"), F.col("slacks").alias("slack"))))
                  # first: also within the shorter prefix that is enough for partners no smaller
                  .withColumn("first", F.expr(f"slack <= n - ceil({percent} * 2 * n / {100 + percent})")), "signatures")

    shared = (sigs.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("first").alias("first"))
              .where("lo < hi and first").select("sig"))
    active = stored(sigs.join(shared, "sig", "left_semi"), "active")
    dropped(sigs)
    texts = stored(docs.join(active.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
                   .select(F.col("doc_id").alias("node"), "text").distinct(), "texts")

    # repeated ids of other sets: no bits, which rule nothing out
    bits = stored(nodes.join(texts.select("node").distinct(), "node", "left_semi")
                  .groupBy("node").agg(F.count("*").alias("sets"), *(F.max(c).alias(c) for c in ODD))
                  .where("sets = 1").drop("sets"), "bits")
    links = tested = comp = None
    act, turn = active.withColumn("label", F.col("node")), 0
    while turn <= STAR_ROUNDS:
        pairs = _star_pairs(act, bits, tested, turn, percent) if turn < STAR_ROUNDS else _all_pairs(act, bits, tested, percent)
        pairs = stored(pairs, "pairs")
        found = _verified(pairs, texts, width, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if found.isEmpty():
            # the lists' samples are at an end: what is left is tested pair by pair
            turn = max(turn + 1, STAR_ROUNDS)
            continue
        links = found if links is None else links.unionByName(found)
        # sets connected so far have one label, and lists within a label are done
        comp = components(links)
        if turn < STAR_ROUNDS:
            act = (act.join(comp.select(F.col("id").alias("node"), "component"), "node", "left")
                   .withColumn("label", F.coalesce("component", "label")).drop("component"))
            mixed = (act.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("first").alias("first"))
                     .where("lo < hi and first").select("sig"))
            left = stored(act.join(mixed, "sig", "left_semi"), "active")
            dropped(active)
            act = active = left
        turn += 1
    comp = comp if comp is not None else nodes.select(F.col("node").alias("id"), F.col("node").alias("component")).limit(0)
    labels = comp.select(F.col("id").alias("node"), F.col("component").alias("label"))
    by_digest = (nodes.join(labels, "node", "left")
                 .select("d1", "d2", F.col("n").alias("n_of"), F.coalesce("label", "node").alias("component_id")))
    return (sets.join(by_digest, (sets.d1 == by_digest.d1) & (sets.d2 == by_digest.d2)
                      & (sets.n == by_digest.n_of) & sets.doc_id.isNotNull(), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one_per_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies in ``docs``: that of the smallest doc_id, null ids last.

    A document is a doc_id and a text, so that rows of other texts under one id
    are judged each; of rows that repeat the kept doc_id and its text, and of a
    group without ids, one row stays. Rows without words are in no group and stay.
    Columns of ``docs`` are returned as they are, whatever else they are named.
    """
    node = F.xxhash64(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    comp = (ngram_components(docs.select(node.alias("doc_id"), "text"), width, percent).where("n_shingles > 0")
            .select(F.col("doc_id").alias("__node"), "component_id").distinct())
    members = stored(docs.where(words).select(F.col("doc_id").alias("__id"), node.alias("__node")).distinct()
                     .join(comp, "__node"), "members")
    first = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__node")).alias("first"))
    dropped = (members.join(first, "component_id")
               .where(~(F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__node") == F.col("first.__node"))))
               .select("__id", F.col("__node").alias("__dropped")))
    rows = docs.withColumn("__node", node).withColumn("__single", words)
    rows = rows.join(dropped, rows["doc_id"].eqNullSafe(dropped["__id"]) & (rows["__node"] == dropped["__dropped"]), "left_anti")
    # after the copies under other ids are gone, only rows of one id and text are equal here
    return (rows.where(~F.col("__single")).unionByName(rows.where("__single").dropDuplicates(["doc_id", "__node"]))
            .select(*docs.columns))
