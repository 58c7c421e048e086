"""Whitening, packing and the source divergence audit against brute force, the tokenizers library and SQL."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MED
from riskloom.llm import divergence, packing, queries, whitening

LONG = "long words " * 20_000 + "a" * 100_000 + " " + "1 " * 20_000 + "漢字 x" * 3000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three"), (5, "one two three"),
         (6, "it's <|endoftext|> here"), (None, "no id at all"), (8, LONG), (9, "Ünïcödé 漢字 \U0001F600 ok ²³")]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns whose names clash with what operators use inside."""
    return spark.createDataFrame(
        [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k % 3}", 0, "x", 1.5, k)
         for k, (i, t) in enumerate(TEXTS)],
        "doc_id long, text string, lang string, source string, n long, term string, size double, rest int")


# --- whitening -------------------------------------------------------------------

def spread_matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 40), np.logspace(3, -6, 40), np.ones(40), 1 + 1e-7 * np.random.default_rng(1).normal(size=40),
    np.r_[np.full(5, 3.0), np.full(5, 3.0 + 1e-9), np.linspace(0, 1, 30)], np.r_[np.ones(20), 1 + 1e-12 * np.arange(20)],
    np.r_[np.zeros(37), 1e30, 2e30, 4e30], np.zeros(3)])
def test_eigenvectors_have_double_precision(values):
    a = spread_matrix(values)
    found, x = whitening.eigenvectors(a)
    wide, size = x.astype(np.longdouble), max(np.abs(a).max(), 1e-300)
    assert np.allclose(found, np.sort(values)[::-1], rtol=0, atol=1e-14 * max(values.max(), 1e-300))
    assert np.abs(wide.T @ wide - np.eye(len(values))).max() < 1e-15
    assert np.abs(a.astype(np.longdouble) @ wide - wide * found).max() < 2e-15 * size * len(values)


def brute_whitened(x, k):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T.astype(float), bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ vectors / np.sqrt(values), values / np.trace(v)


def test_whitening_by_brute_force(spark):
    df = spark.read.parquet(f"{SF_MED}/embeddings.parquet")
    df = df.unionByName(df.limit(30).withColumn("vec_id", F.col("vec_id") + 10_000))  # copies are fitted once
    src = df.toPandas().sort_values("vec_id", kind="stable")
    src = src[[v is not None and np.isfinite(np.array(v, float)).all() for v in src["embedding"]]]
    x = np.floor(64 * np.stack(src["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, deviation, w, explained = brute_whitened(x, 16)
    got = whitening.whitened(df).toPandas().sort_values(["vec_id", "component"], kind="stable")
    assert got["vec_id"].tolist() == np.repeat(src["vec_id"], 16).tolist()
    assert set(got["n"]) == {n} and got["deviation"].tolist() == np.repeat(deviation, 16).tolist()
    mine = got["whitened"].to_numpy().reshape(-1, 16)
    assert np.allclose(mine * np.sign((mine * w).sum(0)), w, rtol=0, atol=1e-9)
    assert np.allclose(got["explained"], np.tile(explained, len(x)), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [0.0, 0.0]), (6, [1.0, 2.0]),
            (6, [1.0, 2.0]), (7, [3.0, -1.0]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 1.0]), (10, [4.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n long, y string")
    got = whitening.whitened(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == \
        sorted((i or 0, c) for i in (None, 6, 6, 7, 10) for c in (1, 2))
    assert {r["n"] for r in got} == {4} and max(r["identity_error"] for r in got) < 1e-9
    assert sum(r["explained"] for r in got if r["vec_id"] == 7) == pytest.approx(1)
    assert whitening.whitened(df.limit(0)).collect() == []
    assert whitening.whitened(df.where("vec_id = 6")).collect() == []  # one distinct vector has no direction


def test_whitening_keeps_large_sums_exact(spark):
    big = [[2.0 ** 30 + i, float(i * i)] for i in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    x = [[int(c * 64) + 1_000_000 for c in v] for v in big]
    sums = [sum(c) for c in zip(*x)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(df).where("component = 1").collect()}
    assert got == {i: sum((50 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}


# --- packing ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    path = queries.tokenizer_file("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_encoder_equals_library(tokenizer, monkeypatch):
    import pyarrow.parquet as pq
    path, tok = tokenizer
    content = open(path, encoding="utf-8").read()
    ranks = packing.byte_ranks(content)
    assert len(ranks) == 50_256
    texts = [t or "" for t in pq.read_table(f"{SF_MED}/documents.parquet", columns=["text"])["text"].to_pylist()[:300]]
    texts += [t or "" for _, t in TEXTS] + [
        "  x", "a\n\n b  ", "it's don't I'LL we've 's 't", "x¼ 12³ ™ — ‘q’ €5 a b", "\x1c \x85  ", "!!!   \t\n??? x",
        " " * 50 + "a", "ªµº ×÷ ǅ ɏ", "<|endoftext|>"]
    monkeypatch.setattr(packing, "CHUNK", 500)  # also across the parts of long texts
    for enc in (packing.Encoder(content, ranks), packing.Encoder(content)):
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, enc.kind).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_ranks_only_where_they_say_it_all():
    import json
    letters = {c: i for i, c in enumerate(packing.byte_letters().values())}
    spec = lambda merges, more: json.dumps({"model": {"type": "BPE", "vocab": letters | more, "merges": merges}})
    good = spec(["a b", "ab c"], {"ab": 256, "abc": 257})
    assert packing.byte_ranks(good)[b"abc"] == 257
    assert packing.byte_ranks(spec(["a b", "ab c"], {"ab": 257, "abc": 256})) is None       # ids out of order
    assert packing.byte_ranks(spec(["b c", "a b", "ab c"], {"bc": 256, "ab": 257, "abc": 258})) is None  # bc goes first
    assert packing.byte_ranks(spec(["ab c"], {"abc": 256})) is None                         # a part of unknown origin


def test_fullest_by_brute_force():
    from itertools import product
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = np.zeros(40, np.int64)
        counts[rng.integers(1, 39, 4)] = rng.integers(1, 4, 4)
        room = int(rng.integers(1, 39))
        lengths = np.flatnonzero(counts)
        best = max(s for s in (sum(a * b for a, b in zip(lengths, k)) for k in product(*(range(counts[x] + 1) for x in lengths)))
                   if s <= room)
        taken = packing.fullest(counts, room)
        assert sum(a * k for a, k in taken.items()) == best and all(k <= counts[a] for a, k in taken.items())


def check_packed(pieces, lengths, size):
    """Every id once, sequences gapless and full or a power of two."""
    of_doc, of_sequence = {}, {}
    for doc, start, length, sequence, offset in pieces:
        of_doc.setdefault(doc, []).append((start, length))
        of_sequence.setdefault(sequence, []).append((offset, length))
    for parts, wanted in [(of_doc[d], lengths[d]) for d in lengths] + [(p, None) for p in of_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == wanted if wanted is not None else at == size or at & (at - 1) == 0
    assert set(of_doc) == set(lengths)


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_rest(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([8, 64, 1024]))
    counts = np.zeros(size, np.int64)
    for length in rng.integers(1, size, int(rng.integers(1, 60))):
        counts[length] += int(rng.integers(1, rng.choice([2, 50, 2000])))
    plan = packing.Plan(counts, size)
    length = np.repeat(np.arange(size), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    pieces = [row for which, start, n, seq, off, _ in packing.placed(plan.table(), length, rank)
              for row in zip(which.tolist(), start.tolist(), n.tolist(), seq.tolist(), off.tolist())]
    check_packed(pieces, dict(enumerate(length.tolist())), size)


def test_plan_does_not_grow_with_rows():
    counts = np.r_[0, np.random.default_rng(1).integers(0, 3000, 1023)]
    few, many = packing.Plan(counts), packing.Plan(counts * 1_000_000)
    assert len(many.segments) < 2 * len(few.segments) < 20_000


def test_packing_of_documents(spark, tokenizer):
    path, tok = tokenizer
    docs = spark.read.parquet(f"{SF_MED}/documents.parquet").repartition(5)
    ids = {r["doc_id"]: np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
           for r in docs.collect()}
    got = packing.pack(docs, path).collect()
    check_packed([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got],
                 {d: len(v) for d, v in ids.items()}, 1024)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
    # pieces that are not whole windows are mostly whole rests
    assert len(got) < sum(-(-len(v) // 1024) for v in ids.values()) * 1.2


def test_packing_odd_rows(spark, docs, tokenizer):
    path, tok = tokenizer
    got = packing.pack(docs, path).collect()
    lengths = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    assert sum(r["length"] for r in got) == sum(lengths)
    assert sorted(r["doc_tokens"] for r in got if r["start"] == 0) == lengths
    assert sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 5 and r["start"] == 0 for r in got) == 2
    assert packing.pack(docs.limit(0), path).collect() == []


# --- divergence ------------------------------------------------------------------

def test_divergence_equals_sql_in_many_runs(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_MED}/documents.parquet'")
    want = con.execute(queries.SQL["op13_source_divergence"]).fetchall()
    docs = spark.read.parquet(f"{SF_MED}/documents.parquet").repartition(3)
    for entries in (divergence.BLOCK_ENTRIES, 500):  # 500: a run every few texts
        got = divergence.source_divergence(docs, block_entries=entries).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_divergence_odd_rows(spark, docs):
    import duckdb
    assert divergence.source_divergence(docs.limit(0)).collect() == []
    few = divergence.source_divergence(docs)
    groups = {(lang or "", source or "") for lang, source in docs.select("lang", "source").distinct().collect()}
    assert {(r["lang"], r["source"], r["item"], r["value"]) for r in few.collect()} == \
        {(a, s, b, 0) for a, s in groups for c, b in groups if a == c and s != b}
    many = docs
    for _ in range(3):
        many = many.unionByName(many.withColumn("text", F.concat_ws(" ", "text", F.lit("Ünder É x1y"))))
    con = duckdb.connect()
    con.register("documents", many.toPandas())
    got = sorted(map(tuple, divergence.source_divergence(many).collect()))
    assert got == sorted(con.execute(queries.SQL["op13_source_divergence"]).fetchall()) and len(got) > 10


def test_words_across_pieces_stay_whole(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 3)
    text = "Abc déf ghijkl, m".encode()
    words = [w for a, b in divergence._pieces(text) for w in divergence._TERM.findall(text, a, b)]
    assert words == ["Abc".encode(), "déf".encode(), b"ghijkl", b"m"]


def test_bucket_counts_leave_a_task_as_ranges_not_rows(spark, monkeypatch):
    from riskloom.llm import importance
    rows = [(" ".join(f"w{k}x{j}" for j in range(300)), k % 3 == 0) for k in range(40)] + [(None, True), ("", False), ("w0x1 w0x2", False)]
    df = spark.createDataFrame(rows, "text string, good boolean").repartition(3)
    got = {r["bucket"]: (r["raw"], r["target"]) for r in importance.bucket_counts(df, 1 << 20).collect()}
    monkeypatch.setattr(importance, "WIDTH", 1 << 9)
    monkeypatch.setattr(importance, "HELD", 50)
    many = importance.bucket_counts(df, 1 << 20)
    assert {r["bucket"]: (r["raw"], r["target"]) for r in many.collect()} == got
    assert sum(n for n, _ in got.values()) == 40 * 599 + 3 and sum(n for _, n in got.values()) == 14 * 599
    monkeypatch.undo()
    # sixteen ranges of 65,536 buckets from each of three tasks, in place of 24,000 rows
    sent = df.mapInArrow(importance._count(1 << 20), "part long, steps binary, raw binary, target binary")
    assert sent.count() <= 3 * 16
    x = importance.np.array([0, 1, 255, 256, 65535, (1 << 32) - 1])
    import pyarrow as pa
    assert importance._numbers(pa.scalar(importance._planes(x), pa.binary())).tolist() == x.tolist()


def test_weights_are_sent_as_bytes(spark, monkeypatch):
    from riskloom.llm import importance
    np = importance.np
    llr = {7 * k: np.float32(k % 3 if k < 900 else k / 7) for k in range(1000)}
    df = spark.createDataFrame([(b, float(x)) for b, x in llr.items()], "bucket long, llr double").selectExpr("bucket", "float(llr) llr")
    monkeypatch.setattr(importance, "PIECE", 1000)
    codes, table, odd_at, odd = importance._coded(df, 0, 8192, np.array([0, 1, 2], np.float32))
    got = table[codes]
    got[odd_at] = odd
    assert codes.dtype == np.uint8 and len(odd) == 100 and (codes == importance.ODD).sum() == 100
    assert {b: got[b] for b in llr} == llr
    assert not got[[b for b in range(8192) if b not in llr]].any()
