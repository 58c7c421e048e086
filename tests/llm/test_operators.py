"""Operators of riskloom.llm against SQL, brute force, the tokenizers library and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SF_MED
from riskloom.llm import (bpe, embed_dedup, importance, mixing, ngram_join, pii, queries, secrets, spans, store,
                          toxicity, vptree, warc)

SPACE = " \t\n\x0b\x0c\r"
LONG = "long words " * 20_000 + "a" * 100_000 + " " + "1 " * 20_000 + "x@" * 3000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three"), (5, "one two three"),
         (6, "the quick brown fox jumps over the lazy dog again and again"),
         (7, "the quick brown fox jumps over the lazy dog again and again"), (None, "no id here at all"),
         (8, LONG), (9, "Ünïcödé 漢字 \U0001F600 mail a.b@c-d.example.org now +1 (234) 567-8901 ok")]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns whose names clash with what operators use inside."""
    return spark.createDataFrame(
        [(i, t, "en", None if k % 4 == 0 else f"src{k % 3}", 0, "x", 1.5, k) for k, (i, t) in enumerate(TEXTS)],
        "doc_id long, text string, lang string, source string, n_chars long, node string, size double, key int")


@pytest.fixture(scope="module")
def real():
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF_MED}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_MED}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_MED)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


# --- n-gram join -----------------------------------------------------------------

def brute_components(texts: dict, width: int, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(f"[{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_ngram_join_by_brute_force(spark):
    import random
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts, n = {}, 0
    for group in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 6, 9, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts[n := n + 1] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width, percent in ((4, 85), (5, 80), (1, 60)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
               for r in ngram_join.ngram_components(df, width, percent).collect()}
        assert got == brute_components(texts, width, percent)


def test_ngram_join_of_a_shared_passage(spark):
    """Many texts share a passage and rare words and little else; some have near copies, in components of their own."""
    import random
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    texts, n = {}, 0
    for group in range(120):
        own = [f"w{rng.randrange(60)}" for _ in range(rng.choice([2, 5, 40, 300]))]
        for copy in range(1 + group % 3):
            words = list(own)
            if copy and len(own) > 30:
                words[rng.randrange(len(words))] = f"x{n}"
            texts[n := n + 1] = f"{passage} {' '.join(words)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, 4, 85).collect()}
    assert got == brute_components(texts, 4, 85) and len({c for _, c in got.values()}) > 40


def test_connected_sets_are_not_paired_again(spark, monkeypatch):
    """A large group of near copies, each linked with some of the others only: once connected, its sets are not paired."""
    import random
    rng = random.Random(4)
    base = [f"b{k}" for k in range(400)]
    texts = {}
    for n in range(300):
        words = list(base)
        for at in rng.sample(range(len(base)), rng.choice([4, 5, 6])):
            words[at] = f"x{n}.{at}"
        texts[n] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs, keep = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda d, name: pairs.append(keep(d, name)) or pairs[-1] if name == "pairs" else keep(d, name))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, 5, 80).collect()}
    assert got == brute_components(texts, 5, 80)
    assert sum(p.count() for p in pairs) < len(texts) ** 2 / 8  # 31,881 when labels took one step a round


def test_boundary_moves_with_cost():
    sizes = {10: 100, 50: 100, 200: 10}
    assert ngram_join.choose_boundary(sizes, 0.0, 85) <= ngram_join.choose_boundary(sizes, 1e6, 85)
    assert ngram_join.choose_boundary(sizes, 1e6, 85) == 200


def test_ngram_join_odd_rows(spark, docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.ngram_components(docs))),
                 key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(TEXTS)
    assert by[1] == (1, 0, 1) and by[2] == (2, 0, 2) and by[3] == (3, 0, 3) and by[4] == (4, 1, 4)
    assert by[7][2] == 6 and by[None][2] is None
    kept = ngram_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]


# --- mixing ----------------------------------------------------------------------

def test_mix_odd_rows(spark, docs):
    got = rows(mixing.mix_sources(docs))
    assert len(got) == len(TEXTS)
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_source.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    for size, taken, target, stated in by_source.values():
        assert size == stated and abs(taken - target) <= 1 and target <= 2 * size
    assert math.isclose(sum(s[2] for s in by_source.values()), 1.5 * sum(s[0] for s in by_source.values()))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = out.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(s[1] for s in by_source.values())


@pytest.mark.parametrize("ident", [5, None])
def test_mix_takes_exactly_its_words_from_equal_rows(spark, ident):
    """Rows that repeat an id and size, also null ids, at the cut of their source."""
    texts = [" ".join(f"w{k % 3}x{j}" for j in range(10)) for k in range(7)]
    d = spark.createDataFrame([(ident, t, "a") for t in texts] + [(100 + k, "one two three", "b") for k in range(30)],
                              "doc_id long, text string, source string")
    for weights in ((3, 1, 2), (1, 3, 1), (5, 4, 1), (1, 9, 1), (1, 1, 1)):
        want = {r["source"]: r["n"] for r in mixing.mix_sources(d, weights).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
        got = mixing.mixed_documents(d, weights).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
        assert {r["source"]: r["n"] for r in got.collect()} == {k: n for k, n in want.items() if n}


# --- toxicity and quality -----------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = toxicity.toxicity_scores(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    assert ((got["predicted"] == 1) == (got["score"] >= 0.5)).all()
    assert (got["predicted"] == got["toxic"]).mean() > 0.92
    assert got.loc[got["predicted"] == 1, "toxic"].mean() > 0.7
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"])


def test_toxicity_slices_add_up(spark, docs, monkeypatch):
    labelled = docs.select("text", F.lit(1).alias("toxic")).unionByName(docs.select(F.reverse("text").alias("text"), F.lit(0).alias("toxic")))
    model = toxicity.train(labelled, min_count=1)
    d = docs.select("doc_id", "text")
    whole = {str(r) for r in toxicity.evidence(d, model, "doc_id long").select("doc_id", F.round("evidence", 9)).collect()}
    monkeypatch.setattr(toxicity, "MODEL_SLICE", max(1, model.count() // 3))
    parts = {str(r) for r in toxicity.evidence(d, model, "doc_id long").select("doc_id", F.round("evidence", 9)).collect()}
    assert whole == parts


def test_rare_and_unseen_expressions_count(spark, monkeypatch):
    texts = [(k, f"calm lake{k} meadow", 0) for k in range(40)] + [(100, "calm grolk", 1), (101, "calm grolt", 1)]
    labelled = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.train(labelled.select("text", "toxic"))
    d = spark.createDataFrame([(1, "grolk"), (2, "grolx"), (3, "meadow"), (4, "zzz")], "doc_id long, text string")
    got = {r["doc_id"]: r["evidence"] for r in toxicity.evidence(d, model, "doc_id long").collect()}
    assert got[1] > 1 and got[1] > got[2] > 0 > got[3]
    llr = {r["gram"]: r["llr"] for r in model.collect()}
    ctx = toxicity.BEGIN + "gro"
    assert ctx + "l" in llr and math.isclose(llr[ctx + toxicity.OTHER], math.log(0.75 / 2))
    monkeypatch.setattr(toxicity, "MODEL_SLICE", max(1, model.count() // 3))
    parts = {r["doc_id"]: r["evidence"] for r in toxicity.evidence(d, model, "doc_id long").collect()}
    assert all(math.isclose(got[k], parts[k], abs_tol=1e-9) for k in got)


def test_toxicity_and_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(6, 1, 1), (8, 0, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == len(TEXTS)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity_scores(docs, labels.limit(0)).count() == len(TEXTS)
    assert importance.resample(docs, labels, share=0.5).where("kept").count() == round(len(TEXTS) / 2)
    assert importance.resample(docs, labels.limit(0)).count() == len(TEXTS)


def test_resampling_prefers_good_rows(spark):
    labels = spark.read.parquet(f"{SF_MED}/labels.parquet")
    got = importance.resample(spark.read.parquet(f"{SF_MED}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert held.loc[held["quality"] == 1, "kept"].mean() > 0.9
    assert held.loc[held["quality"] == 0, "kept"].mean() < 0.6


def test_resampling_weights_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(0, 30)))) for k in range(80)]
    texts += [(200, None), (None, "alpha beta"), (300, LONG), (300, LONG)]
    d = spark.createDataFrame([(i, t, 1.5, "x") for i, t in texts], "doc_id long, text string, bucket double, llr string")
    labels = spark.createDataFrame([(k, k % 3 // 2) for k in range(80)], "doc_id long, quality int")
    learned = {r["doc_id"] for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()}

    def grams(t):
        w = re.findall("[^\\x20\\x09-\\x0D]+", (t or "").lower())
        return w + list(zip(w, w[1:]))

    raw, target = Counter(), Counter()
    for i, t in texts:
        raw.update(grams(t))
        target.update(grams(t) if i in learned and i % 3 == 2 else [])
    got = importance.resample(d, labels).collect()
    size = importance.buckets_for(d)
    assert size == max(importance.LEAST, 1 << (len(raw) - 1).bit_length())
    scale = sum(target.values()) / sum(raw.values())
    add = importance.SMOOTH
    want = sorted(round(sum(math.log((target[g] + add) / (raw[g] * scale + add)) for g in grams(t)), 4) for _, t in texts)
    assert all(math.isclose(a, b, abs_tol=2e-3, rel_tol=1e-6) for a, b in zip(sorted(r["log_weight"] for r in got), want))
    monkeypatch.setattr(importance, "SLICE", 1 << 12)
    parts = importance.resample(d, labels).collect()
    assert sorted(map(str, ((r["doc_id"], r["kept"], round(r["log_weight"], 6)) for r in parts))) == sorted(
        map(str, ((r["doc_id"], r["kept"], round(r["log_weight"], 6)) for r in got)))
    assert importance.resample(d.limit(0), labels).count() == 0


def test_bucket_number_follows_the_ngrams(spark):
    few = spark.createDataFrame([(k, "same words again") for k in range(50)], "doc_id long, text string")
    many = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(500))) for k in range(60)], "doc_id long, text string")
    assert importance.buckets_for(few) == importance.LEAST and importance.buckets_for(many) in (1 << 15, 1 << 16, 1 << 17)


# --- WARC ------------------------------------------------------------------------

def test_warc_odd_rows(spark):
    pages = spark.createDataFrame(
        [(3, "http://a/x", "same"), (1, "http://a/y", "same"), (2, None, None), (4, "http://b/", ""), (5, "u v\r\n", "WARC/1.1\r\n\r\n"),
         (6, "http://ü/", "é漢" * 50_000), (7, "http://a/z", "other"), (7, "http://a/z", "other"), (None, "http://n/", "same")],
        "page_id long, url string, html string")
    path = store.scratch_path(spark, "warc-test")
    warc.write_warc(pages, path)
    recs = warc.read_warc(spark, path)
    assert recs.where("record_type = 'response' and not digest_ok").count() == 0
    whole = warc.assemble(recs)
    assert whole.where("request is null or size(metadata) <> 1").count() == 0
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows(warc.page_captures(recs))}
    assert got == {(1, 4, "response", None), (3, 4, "revisit", 1), (None, 4, "revisit", 1), (2, 0, "response", None),
                   (4, 0, "revisit", 2), (5, 12, "response", None), (6, 250_000, "response", None), (7, 5, "response", None)}
    assert warc.page_captures(recs).count() == 9
    empty = store.scratch_path(spark, "warc-test")
    warc.write_warc(pages.limit(0), empty)
    assert warc.page_captures(warc.read_warc(spark, empty)).count() == 0


# --- BPE -------------------------------------------------------------------------

def test_bpe_equals_library(spark, docs, real):
    import tokenizers
    path = queries.tokenizer_file()
    lib = tokenizers.Tokenizer.from_file(path)
    texts = dict(list(real.items())[:150]) | {10_000 + k: t for k, (_, t) in enumerate(TEXTS)} | {
        20_000: "<|endoftext|>It's <|startoftext|> İ ΑΣ ﬁ x\x85y\x1c½²३ ́e", 20_001: "".join(map(chr, range(1, 0x180)))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = bpe.decode(bpe.encode(df, path, lexicon_words=500), path).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == decoded
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode(docs, path, with_ids=False).count() == len(TEXTS)
    assert bpe.encode(docs.limit(0), path).count() == 0


# --- vectors ---------------------------------------------------------------------

VECTORS = [(0, [1.0, 0.0]), (1, [0.99, 0.05]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
           (6, [0.0, 2.0]), (7, [0.0, 2.0]), (100, [0.0, 1.9]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0])]


def test_vectors_odd_rows(spark):
    df = spark.createDataFrame([(*v, 1) for v in VECTORS], "vec_id long, embedding array<float>, node int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(embed_dedup.near_duplicate_vectors(df))}
    assert got == {0: (1, 0, True), 1: (1, 0, False), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True),
                   6: (2, 6, True), 7: (2, 6, False), 100: (2, 6, False), 8: (0, 8, True), 9: (0, 9, True), None: (0, None, True)}
    near = [(r["query_id"], r["rank"], r["vec_id"]) for r in rows(
        vptree.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank"))]
    assert near == [(0, 1, 1), (0, 2, 100), (0, 3, 6), (0, 4, 7), (100, 1, 6), (100, 2, 7), (100, 3, 1), (100, 4, 0)]
    assert embed_dedup.near_duplicate_vectors(df.limit(0)).count() == 0
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_cells_cut_into_parts_give_the_same(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 16))
    vecs = [(k, [float(x) for x in base[k % 20] + rng.normal(size=16) * 0.12]) for k in range(300)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    a = {tuple(r) for r in embed_dedup.near_duplicate_vectors(df, cell_rows=2048).collect()}
    b = {tuple(r) for r in embed_dedup.near_duplicate_vectors(df, cell_rows=16, block_dims=4, grid_dims=2).collect()}
    x = np.array([v for _, v in vecs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(1) - 1
    assert a == b and {(r[0], r[1]) for r in a} == set(enumerate(links.tolist()))


def written(spark, tables):
    """Bytes of Spark's own files (shuffles) and of the tables between steps."""
    tops = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), *tables]
    return sum(p.stat().st_size for top in tops for p in Path(top).rglob("*") if p.suffix in (".data", ".parquet"))


@pytest.mark.parametrize("kind, cell_rows", [("float", 256), ("double", 32)])
def test_vectors_are_not_written_again_for_each_neighbour(spark, monkeypatch, kind, cell_rows):
    import numpy as np
    tables, path = [], store.scratch_path
    monkeypatch.setattr(store, "scratch_path", lambda *a: tables.append(p := path(*a)) or p)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 64))
    vecs = [(k, (base[k % 12] + rng.normal(size=64) * 0.17).tolist()) for k in range(240)]
    vecs += [(1000 + k, rng.normal(size=64).tolist()) for k in range(2400)] + [(4000 + k, rng.normal(size=3).tolist()) for k in range(60)]
    vecs += [(5000 + k, vecs[k][1]) for k in range(20)]
    df = spark.createDataFrame(vecs, f"vec_id long, embedding array<{kind}>").repartition(4)
    before = written(spark, [])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(embed_dedup.near_duplicate_vectors(df, cell_rows=cell_rows))}
    size = sum(len(v) for _, v in vecs) * (4 if kind == "float" else 8)
    assert written(spark, [t.removeprefix("file:") for t in tables]) - before < 3 * size
    ids, links = [k for k, _ in vecs], {}
    for dim in (3, 64):
        own = [k for k, (_, v) in enumerate(vecs) if len(v) == dim]
        x = np.array([vecs[k][1] for k in own]).astype(kind).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links |= {ids[own[i]]: {ids[own[j]] for j in np.flatnonzero(r) if j != i} for i, r in enumerate(x @ x.T >= 0.95)}
    least = {k: k for k in ids}
    while (low := {k: min([least[k], *(least[j] for j in links[k])]) for k in ids}) != least:
        least = low
    assert got == {k: (len(links[k]), least[k]) for k in ids} and sum(map(len, links.values())) > 1000


def test_relaxed_search_keeps_recall(spark):
    df = spark.read.parquet(f"{SF_MED}/embeddings.parquet")
    q = df.where("vec_id % 100 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in rows(vptree.nearest(df, q, shard_rows=100))}
    relaxed = {(r["query_id"], r["vec_id"]) for r in rows(vptree.nearest(df, q, factor=1.5, shard_rows=100))}
    assert len(exact & relaxed) >= 0.9 * len(exact)


# --- PII and secrets ---------------------------------------------------------------

def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def listed(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def pii_spans(t: str) -> str:
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return listed(out)


def secret_spans(t: str) -> str:
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                    for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
        rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return listed(out)


TRICKY = ["a@b.c_x@y.z", "x@y x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111-1111 1111 4111111111111112",
          "+1 2 3 4 5 6 7 8 9 +12 +1234567890123456", "token=secret=abcdefgh1 token = secret: abcdefghij API_KEY:'AKIAAKIAAKIAAKIA1'",
          "PassWord == 12345678 apikey=\"x.y/z+w=====\"", "AKIA" * 9, "deadbeef" * 5 + "G" + "0123456789abcdef" * 2, "é😀 a@b.co +49 (0)30 1234567"]


def test_a_task_folds_its_pairs(monkeypatch):
    import numpy as np
    import pandas as pd
    held = []
    fold = embed_dedup._merged
    monkeypatch.setattr(embed_dedup, "_merged", lambda label, x, y: held.append(len(x)) or fold(label, x, y))
    rng = np.random.default_rng(2)
    n = 1500
    vecs = np.ones((n, 8)) + rng.normal(size=(n, 8)) * 1e-3
    vecs[n // 2:, 0] = -3
    pdf = pd.DataFrame({"node": rng.permutation(n).astype("int64"), "mult": 1, "home": True, "part": 0, "vec": [v.astype("<f8") for v in vecs]})
    monkeypatch.setattr(embed_dedup, "matrix", lambda v, dim: np.stack(v.to_numpy()))
    got = embed_dedup._link(0.95, 8)((8, 0, "c", 0, 0), pdf).set_index("node")
    want = {k: pdf["node"][:n // 2].min() if i < n // 2 else pdf["node"][n // 2:].min() for i, k in enumerate(pdf["node"])}
    assert (got["links"] == n // 2 - 1).all() and got["root"].to_dict() == want
    assert len(held) == 3 and max(held) <= 512 * n


@pytest.mark.parametrize("find, brute", [(pii.find_personal_data, pii_spans), (secrets.find_secrets, secret_spans)])
def test_base_spans_by_brute_force(spark, real, find, brute):
    texts = real | {10_000 + k: t for k, t in enumerate(TRICKY)} | {20_000 + k: t for k, (_, t) in enumerate(TEXTS)}
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in texts.items()], "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["base_sha256"] for r in rows(find(df))}
    assert got == {i: hashlib.sha256(brute(t or "").encode()).hexdigest() for i, t in texts.items()}
    assert find(df.limit(0)).count() == 0


def test_revealing_terms(spark):
    names = [f"{a}{b}" for a in ("al", "be", "ce", "du", "er", "fo") for b in ("nor", "pik", "tus", "vex")]
    docs = [(k, f"{names[k]} wrote Zorblax from boss@corp.example today {names[-k - 1]}") for k in range(5)]
    docs += [(10 + k, f"today {names[k]} wrote from home") for k in range(20)]
    docs += [(50, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows(pii.find_personal_data(df))}
    assert all("reveal" in got[k] and "hint" not in got[10 + k] for k in range(5)) and got[10] == "" and got[50] == got[0]
    at = docs[0][1].index("Zorblax")
    assert f"reveal:{at}:{at + 7}" in got[0]
    clean = {r["doc_id"]: r["text"] for r in rows(pii.sanitised(df))}
    assert "Zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == docs[5][1]


def test_revealing_terms_far_from_the_entity(spark):
    far = " ".join(f"common{k}" for k in range(40))
    docs = [(k, f"Zorblax begins {far} alone{k} {far} mail boss@corp.example {far} Zorblax ends") for k in range(5)]
    docs += [(10 + k, f"begins {far} mail {far} ends") for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in rows(pii.find_personal_data(df))}
    for i, text in docs[:5]:
        assert {f"reveal:{m.start()}:{m.end()}" for m in re.finditer("Zorblax", text)} <= set(got[i])
    assert got[10] == [""]
    clean = {r["doc_id"]: r["text"] for r in rows(pii.sanitised(df))}
    assert all("Zorblax" not in clean[k] and "begins" in clean[k] for k in range(5)) and clean[10] == docs[5][1]


def test_few_texts_lower_a_share_without_zeroing_it(spark):
    docs = [(1, "Quillon asks boss@corp.example today"), (2, "Vantor and Mirelle ask at +1 234 567 8901 today"),
            (3, "Vantor again at +1 234 567 8901 today")] + [(10 + k, "they ask and again at home today") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows(pii.find_personal_data(df))}
    # a term of one or two texts is generalised, not removed, whatever the size of the corpus
    assert "reveal" not in got[1] + got[2] + got[3] and "hint:0:7" in got[1]
    assert "hint:0:6" in got[2] and "hint:0:6" in got[3] and got[10] == ""
    found = pii._found(df)
    pairs = pii._pairs(found, pii._texts(found), len(docs))
    share = {r["term"]: (r["share"], r["bits"]) for r in pii.disclosure(pairs, len(docs)).collect()}
    assert 0.5 < share["mirelle"][0] < share["vantor"][0] < 1 and share["quillon"][0] < 1
    assert math.isclose(share["quillon"][1], 1) and math.isclose(share["vantor"][1], -math.log2(2 / 3))
    assert pii.find_personal_data(df.where("doc_id = 1")).first()["n_reveal"] == 0  # the entity of all documents says nothing


def test_an_entity_of_many_documents_marks_nothing_by_chance(spark):
    docs = [(k, f"word{k % 7} and word{k % 11} from office@corp.example") for k in range(60)]
    docs += [(100 + k, f"word{k % 7} and word{k % 11} from home") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["n_reveal"], r["n_hint"]) for r in rows(pii.find_personal_data(df))} == {(0, 0)}


def test_span_helpers_against_loops(spark):
    rng = random.Random(11)
    cases = []
    for k in range(60):
        text = "".join(rng.choice("ab é\U0001F600x") for _ in range(rng.randint(0, 90)))
        found = sorted({(s, min(len(text), s + rng.randint(1, 9))) for s in (rng.randrange(len(text)) for _ in range(
            rng.randint(0, 25)))}) if text else []
        cases.append((k, text, [(s, e, rng.choice(["email", "ip"])) for s, e in found]))
    df = spark.createDataFrame(cases, "id long, text string, spans array<struct<s:int,e:int,kind:string>>")
    by = {"email": "[E]", "ip": ""}
    got = {r["id"]: r for r in df.select(
        "id", spans.joined(F.col("spans")).alias("joined"),
        spans.replaced(F.col("text"), spans.joined(F.col("spans")), by).alias("new"),
        spans.matches(F.col("text"), "a+|x", F.lit(True)).alias("hits")).collect()}
    for k, text, found in cases:
        merged = []
        for s, e, kind in found:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e, kind])
        new, at = "", 0
        for s, e, kind in merged:
            new, at = new + text[at:s] + by[kind], e
        assert [list(x) for x in got[k]["joined"]] == merged and got[k]["new"] == new + text[at:]
        assert [tuple(x) for x in got[k]["hits"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("a+|x", text)]


def test_a_long_text_of_very_many_spans(spark):
    mails = [f"u{k}@corp{k % 50}.example" for k in range(30_000)]
    text = " ".join(f"{m} talks about term{k:06d} in a long list" for k, m in enumerate(mails))
    assert len(text) > 1_500_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    df.count()
    began = time.time()
    base = pii.base_spans(F.col("text"))
    got = df.select(F.size(base).alias("n"), F.length(pii._blanked(F.col("text"), spans.joined(base))).alias("w"),
                    F.size(secrets.base_spans(F.col("text"))).alias("secrets")).first()
    short = df.select("doc_id", F.substring("text", 1, 1_000_000).alias("text"))
    marks = 16_000
    kinds = pii._dealt(spark.range(marks).select(F.lit(1).alias("key"), F.format_string("term%06d", "id").alias("term"),
                                                  F.lit(4).alias("k")))
    places = (short.join(kinds, F.col("doc_id") == F.col("key"))
              .select(F.size(pii._places(F.col("text"), F.col("kinds"))).alias("n")).first()["n"])
    took = time.time() - began
    df.unpersist()
    assert (got["n"], got["w"], got["secrets"], places) == (30_000, len(text), 0, marks)
    assert took < 120, took


def test_ownership_tells_examples_from_credentials(spark):
    live, copied = "aB3dE5fG7hJ9kL1mN2pQ4rS6", "Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2"
    docs = [(1, f"key {live} end", "o1"), (2, f"again {live}", "o1")] + [(10 + k, f"see {copied}", f"o{k}") for k in range(4)]
    got = {r["doc_id"]: (r["spans"], r["n_live"], r["n_example"]) for r in rows(
        secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string, source string")))}
    assert got[1] == (f"blob:4:{4 + len(live)}", 1, 0) and got[2][1] == 1
    assert all(got[10 + k] == ("", 0, 1) for k in range(4))


def test_repositories_and_two_owners_decide(spark):
    wide, shared = "aB3dE5fG7hJ9kL1mN2pQ4rS6", "Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2"
    docs = [(k, f"see {wide}", "o1", f"l{k % 3}") for k in range(12)] + [(100, f"key {shared}", "o1", "l0"), (101, f"my {shared}", "o2", "l0")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: (r["n_blob"], r["n_live"], r["n_example"]) for r in rows(secrets.find_secrets(df))}
    assert all(got[k] == (0, 0, 1) for k in range(12)) and got[100] == got[101] == (1, 1, 0)
    by_lang = {r["doc_id"]: r["n_live"] for r in rows(secrets.find_secrets(df, repo=["lang"]))}
    assert by_lang[0] == 1  # three repositories of one owner


def test_replaced_spans_overlap(spark):
    df = spark.createDataFrame([("0123456789",)], "t string")
    s = "array(named_struct('s',1,'e',4,'kind','card'), named_struct('s',3,'e',6,'kind','phone'), named_struct('s',8,'e',9,'kind','ip'))"
    out = df.select(spans.replaced(F.col("t"), spans.joined(F.expr(s)), {"card": "C", "phone": "P", "ip": "I"})).first()[0]
    assert out == "0C67I9"


def test_filters_judge_rows_not_ids(spark, monkeypatch):
    long = " ".join(f"word{k}" for k in range(30))
    other = " ".join(f"thing{k}" for k in range(30))
    third = " ".join(f"item{k}" for k in range(30))
    df = spark.createDataFrame([(3, long, 0), (5, long, 1), (5, other, 2), (None, long, 3), (None, third, 4), (None, third, 5),
                                (None, None, 6), (7, other + " end", 7), (None, "", 8)], "doc_id long, text string, n int")
    got = {r["n"] for r in ngram_join.keep_one_per_group(df).collect()}
    assert got in ({0, 2, 4, 6, 8}, {0, 2, 5, 6, 8})
    bad = spark.createDataFrame([(k, f"calm lake{k} meadow", 0) for k in range(60)] + [(100 + k, f"vile grolk{k} scum", 1) for k in range(30)],
                                "doc_id long, text string, toxic int")
    odd = spark.createDataFrame([(None, "vile grolk scum"), (None, "calm lake meadow"), (1000, "vile grolk scum"), (1000, "calm lake meadow")],
                                "doc_id long, text string")
    out = toxicity.without_toxic(bad.select("doc_id", "text").unionByName(odd), bad.select("doc_id", "toxic"))
    left = [tuple(r) for r in out.where("doc_id is null or doc_id = 1000").collect()]
    assert sorted(left, key=str) == [(1000, "calm lake meadow"), (None, "calm lake meadow")]


# --- lexicon ---------------------------------------------------------------------

def test_lexicon_holds_few_states():
    import tracemalloc
    import numpy as np
    from riskloom.llm import transducer
    words = sorted({f"{stem:05d}{end}".encode() for stem in range(6000) for end in ("", "ing", "ings", "ment", "ments")})
    offsets, ids = np.arange(len(words) + 1), np.arange(len(words))
    tracemalloc.start()
    block = transducer.compile_lexicon({w: [k] for k, w in enumerate(words)})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert block == transducer.compile_sorted(words, offsets, ids)
    lexicon = transducer.Lexicon(np.frombuffer(block, np.int64))
    assert lexicon.numbers(words).tolist() == list(range(len(words))) and lexicon.numbers([b"00001in", b"x", b""]).tolist() == [-1] * 3
    assert lexicon.sequence(17) == [17] and peak < 15e6


# --- pipeline --------------------------------------------------------------------

def test_pipeline_stages(spark, docs):
    import corpus_pipeline
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = store.stored(stage(spark, d, SF_MED), name)
        assert d.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF_MED).count() == d.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_MED).count() == 0
    whole = corpus_pipeline.run(spark, SF_MED)
    assert set(whole.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and whole.count() > 500
