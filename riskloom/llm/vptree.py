"""Approximate nearest neighbours: a vantage-point tree per shard.

A node holds a vantage point and the median distance ``mu`` of its rows to it;
the half within goes inside, the rest outside. A query at distance d from the
vantage point, whose k-th best distance so far is tau, needs the inside only
if d - mu <= tau and the outside only if mu - d <= tau (triangle inequality).
``factor`` relaxes the test to factor * (d - mu) <= tau: larger prunes more and
may miss neighbours; factor one restores exact search.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.store import stored
from riskloom.llm.vectors import clean_vectors, matrix
from riskloom.session import ship_package

SLACK = 1e-9


def build(ids: np.ndarray, vecs: np.ndarray, leaf_rows: int = 256) -> dict:
    """Tree over the rows: permuted ids and vectors, and node arrays (vantage, mu, from, to, children)."""
    order = np.arange(len(ids))
    nodes: list[list] = []
    todo = [(0, len(ids), None, 0)]
    rng = np.random.default_rng(len(ids))
    while todo:
        a, b, parent, side = todo.pop()
        if parent is not None:
            nodes[parent][4 + side] = len(nodes)
        me = len(nodes)
        nodes.append([-1, 0.0, a, b, -1, -1])
        if b - a <= leaf_rows:
            continue
        # of a few candidates the one that spreads the rows most
        tries = rng.integers(a, b, 5)
        some = order[rng.integers(a, b, 64)]
        spread = [np.var(np.linalg.norm(vecs[some] - vecs[order[t]], axis=1)) for t in tries]
        vantage = order[tries[int(np.argmax(spread))]]
        dist = np.linalg.norm(vecs[order[a:b]] - vecs[vantage], axis=1)
        mid = (b - a) // 2
        perm = np.argpartition(dist, mid)
        order[a:b] = order[a:b][perm]
        nodes[me][0], nodes[me][1] = int(vantage), float(dist[perm[mid]])
        todo += [(a + mid, b, me, 1), (a, a + mid, me, 0)]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    kinds = np.array([(place[n[0]] if n[0] >= 0 else -1, n[2], n[3], n[4], n[5]) for n in nodes], np.int64)
    return {"ids": ids[order], "vecs": vecs[order], "nodes": kinds, "mu": np.array([n[1] for n in nodes])}


def _distance(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of aligned rows, summed component by component."""
    acc = np.zeros(len(q))
    for k in range(q.shape[1]):
        d = q[:, k] - v[:, k]
        acc += d * d
    return np.sqrt(acc)


class Search:
    """The k best of a block of queries, over any number of trees."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, factor: float):
        self.ids, self.vecs, self.k, self.factor = ids, vecs, k, factor
        self.square = (vecs * vecs).sum(1)
        self.dist = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def _leaf(self, who: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        rough = self.square[who][:, None] + (vecs * vecs).sum(1)[None, :] - 2 * (self.vecs[who] @ vecs.T)
        scale = self.square[who][:, None] + (vecs * vecs).sum(1)[None, :]
        tau = self.dist[who, -1]
        with np.errstate(invalid="ignore"):
            ok = (rough - SLACK * scale <= (tau * tau)[:, None]) & (self.ids[who][:, None] != ids[None, :])
        r, c = np.nonzero(ok)
        if not len(r):
            return
        d = _distance(self.vecs[who[r]], vecs[c])
        for i in np.unique(r):
            mine = slice(*np.searchsorted(r, [i, i + 1]))
            q = who[i]
            dist, found = np.append(self.dist[q], d[mine]), np.append(self.found[q], ids[c[mine]])
            best = np.lexsort((found, dist))[:self.k]
            self.dist[q], self.found[q] = dist[best], found[best]

    def tree(self, t: dict) -> None:
        nodes, mu, vecs, ids = t["nodes"], t["mu"], t["vecs"], t["ids"]

        def visit(n: int, who: np.ndarray) -> None:
            if not len(who):
                return
            vantage, a, b, inside, outside = nodes[n]
            if vantage < 0:
                self._leaf(who, ids[a:b], vecs[a:b])
                return
            d = np.linalg.norm(self.vecs[who] - vecs[vantage], axis=1)
            near = d < mu[n]
            visit(inside, who[near])
            visit(outside, who[~near])
            gap = self.factor * np.abs(d - mu[n]) <= self.dist[who, -1] + SLACK * (d + mu[n])
            visit(inside, who[~near & gap])
            visit(outside, who[near & gap])

        visit(0, np.arange(len(self.ids)))


def _plant(leaf_rows: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf["vec_id"].to_numpy(), matrix(pdf["vec"], key[1]), leaf_rows)
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "tree": [pickle.dumps(tree, protocol=5)]})
    return run


def _search(sent, k: int, factor: float):
    def run(batches):
        by_dim = {d: Search(ids, vecs, k, factor) for d, (ids, vecs) in sent.value.items()}
        for pdf in batches:
            for dim, raw in zip(pdf["dim"], pdf["tree"]):
                if dim in by_dim:
                    by_dim[dim].tree(pickle.loads(raw))
        for s in by_dim.values():
            r, c = np.nonzero(np.isfinite(s.dist))
            yield pd.DataFrame({"query_id": s.ids[r], "vec_id": s.found[r, c], "score": s.dist[r, c]})
    return run


def build_index(vectors: DataFrame, shard_rows: int = 16384, leaf_rows: int = 256) -> DataFrame:
    """(shard, dim, tree): rows are dealt evenly to shards of about ``shard_rows``, one tree each."""
    total = vectors.count()
    shards = max(1, -(-total // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)))
    return stored(dealt.groupBy("shard", "dim").applyInPandas(_plant(leaf_rows), "shard long, dim int, tree binary"),
                  "trees")


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = 16384,
            query_rows: int = 32768, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``df`` to each row of ``queries``.

    score is the Euclidean distance in double precision; nearest first, ties to
    the smaller vec_id. A query's own row (rows of its id) is no candidate.
    Every row is in a tree and every tree is searched: queries go out in blocks
    of ``query_rows`` (a block is what is broadcast), and a task carries each
    query's best from tree to tree. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do vectors of another length.
    Queries that repeat an id count once. Fewer candidates than ``k`` give
    fewer rows, an empty table none. Other columns are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    vectors = stored(clean_vectors(df, id_col, vec_col), "vectors")
    trees = build_index(vectors, shard_rows)
    asked = stored(clean_vectors(queries, id_col, vec_col).groupBy("vec_id", "dim").agg(F.min("vec").alias("vec")),
                   "queries")
    n_blocks = max(1, -(-asked.count() // query_rows))
    found = None
    for block in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).toPandas()
        by_dim = {int(d): (g["vec_id"].to_numpy(), matrix(g["vec"], int(d))) for d, g in part.groupby("dim")}
        rows = trees.mapInPandas(_search(spark.sparkContext.broadcast(by_dim), k, factor),
                                 "query_id long, vec_id long, score double")
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
