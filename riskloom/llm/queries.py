"""Registered queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import (bpe, divergence, embed_dedup, importance, mixing, ngram_join, packing, pii, secrets, toxicity,
                          vptree, warc, whitening)
from riskloom.llm.store import scratch_path


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; any other path can be given to ``bpe.encode`` and ``packing.pack``."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_captures(warc.read_warc(spark, path, with_payload=False))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_file(), with_ids=False)


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = _table(spark, sf_dir, "embeddings")
    return vptree.nearest(vecs, vecs.where("vec_id % 100 = 0"), k=10, factor=1.0)


def op8_embedding_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def op9_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"), owner="source")  # no repository column


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_mix_sources, op3_toxicity, op4_warc_transactions, op5_bpe_transducer,
    op6_importance_resampling, op7_vantage_point_trees, op8_embedding_pigeonhole, op9_pii_disclosure,
    op10_secret_ownership, op11_embedding_whitening, op12_min_slack_packing, op13_source_divergence)}

_COMPONENTS = """
reach AS (
  SELECT id, id AS other FROM nodes
  UNION
  SELECT r.id, l.y FROM reach r JOIN (SELECT x, y FROM links UNION SELECT y, x FROM links) l ON l.x = r.other
)"""

_VECTORS = """
v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
    AND len([c for c in embedding if c <> 0]) > 0
)"""

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
),
nodes AS (SELECT DISTINCT doc_id AS id FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_sides AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM both_sides JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)
),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id""",
    "op2_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS n,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source
),
o AS (
  SELECT *, 2 * n AS cap, row_number() OVER o AS r, sum(2 * n) OVER o AS c, sum(w) OVER o AS cw,
    sum(n) OVER () * 1.5::DOUBLE AS share, sum(w) OVER () AS all_w
  FROM s WINDOW o AS (ORDER BY n::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
),
lev AS (
  SELECT arg_min(level, r) AS level FROM (
    SELECT r, (share - (c - cap)) / (all_w - (cw - w)) AS level, cap, w FROM o
  ) WHERE cap >= level * w
),
t AS (SELECT source, n, least((2 * n)::DOUBLE, level * w) AS target FROM s, lev),
b AS (
  SELECT d.doc_id, d.size, t.n AS source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE
  (budget // source_size) * size + greatest(0, least(size, budget % source_size - seen)) END)::BIGINT AS taken FROM b""",
    "op4_warc_transactions": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) for i in range(0, 32)], '')
    AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f""",
    "op7_vantage_point_trees": f"""
WITH {_VECTORS},
d AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    sqrt(list_reduce([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(q.e, v.e)], lambda a, b: a + b)) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d) WHERE rank <= 10""",
    "op8_embedding_pigeonhole": f"""
WITH RECURSIVE {_VECTORS},
nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
),
{_COMPONENTS}
SELECT d.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, c.component_id, d.vec_id = c.component_id AS kept
FROM embeddings d
LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT x AS id FROM links UNION ALL SELECT y FROM links) GROUP BY id) l
  ON l.id = d.vec_id
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = d.vec_id""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
kept AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(total, 0) AS total, lang_n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs USING (lang) LEFT JOIN totals USING (lang, source)
),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * g.v) AS p,
    1 + (1000000000 * (k.all_n + 2)::HUGEINT) // (g.lang_n + 2 * g.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found)
WHERE part = 'pair' OR rank <= 10""",
}
