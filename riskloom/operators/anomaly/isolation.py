"""Isolation forest (M1; Liu, Ting & Zhou 2008) as DataFrame operations that plain SQL can repeat.

* Subsamples: one MD5 per row gives two numbers ``a`` and ``b``; the row's key
  for tree t is ``(a + (t + 1) b) mod (2^31 - 1)`` and a tree's sample is its
  ``max_samples`` smallest keys, at every input size. Keys far above what any
  tree needs are dropped inside the row, before anything is exploded, so about
  ``8 * trees * max_samples`` rows move; a per-tree ``row_number() <=
  max_samples`` (WindowGroupLimit) picks the sample. The result does not depend
  on partitioning.
* Growing: level by level. The split of a node is drawn from the MD5 of (tree,
  node): one of the features that vary in the node, and a threshold between
  their minimum and maximum, which are window aggregates over (tree, node).
  The sample is dealt by tree once; no level shuffles again, and a node holds at
  most ``max_samples`` rows.
* Scoring: the forest (<= trees x (2 max_samples - 1) nodes, a fixed bound) is
  collected and broadcast; ``mapInPandas`` walks every row through every tree
  in NumPy. Path lengths are whole numbers of 10^-9, so their sum is exact.
* Flags: the most anomalous ``contamination`` share, i.e. a path below its exact
  ``contamination`` quantile.

Rows with a null or NaN feature take part: such a value never lies below a
threshold. Rows that repeat an id are separate rows. No rows: no result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.anomaly.scale import FEATURES, exact_quantile
from riskloom.session import cut_lineage, ship_package

EULER = 0.5772156649015329
OVERDRAW = 8.0   # candidates per tree, as a multiple of its sample
KEY_SPACE = 2 ** 31 - 1
UNIT = 1e9       # path lengths are added as whole numbers of 1 / UNIT


def c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def md5_draw(text: Column, part: int) -> Column:
    """52 bits of the MD5 of ``text`` (hex digits 1-13 for part 0, 14-26 for part 1) as a bigint."""
    return F.conv(F.substring(F.md5(text), 13 * part + 1, 13), 16, 10).cast("bigint")


def _samples(df: DataFrame, cols, n: int, m: int, n_trees: int, seed: int, id_col: str) -> DataFrame:
    """(tree, f0, f1, ...): the m rows of every tree."""
    share = min(1.0, OVERDRAW * m / n)
    bound = F.lit(int(share * KEY_SPACE))
    tag = F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed))
    a, b = md5_draw(tag, 0) % KEY_SPACE, md5_draw(tag, 1) % KEY_SPACE
    feats = [f"f{i}" for i in range(len(cols))]
    rows = df.select(F.col(id_col).alias("rid"), a.alias("a"), b.alias("b"),
                     *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f)
                       for c, f in zip(cols, feats)])
    keys = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                       lambda t: F.struct(t.alias("tree"), ((F.col("a") + (t + 1) * F.col("b")) % KEY_SPACE).alias("k")))
    pairs = (rows.select("rid", *feats, F.explode(F.filter(keys, lambda x: x["k"] <= bound)).alias("tk"))
             .select("rid", *feats, "tk.tree", "tk.k"))
    w = Window.partitionBy("tree").orderBy("k", "rid", *feats)
    return pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= m).select("tree", *feats)


def _one_level(rows: DataFrame, feats: list[str], depth: int, seed: int) -> DataFrame:
    """Split every node that still varies: its rows move to children 2 k + 1 and 2 k + 2."""
    w = Window.partitionBy("tree", "node")
    spread = rows.select("*", *[F.min(f).over(w).alias(f"lo_{f}") for f in feats],
                         *[F.max(f).over(w).alias(f"hi_{f}") for f in feats])
    choices = F.filter(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("x"),
                                          F.col(f"lo_{f}").alias("lo"), F.col(f"hi_{f}").alias("hi"))
                                 for i, f in enumerate(feats)]), lambda c: c["hi"] > c["lo"])
    tag = F.concat_ws(":", F.col("tree"), F.col("node"), F.lit(seed))
    drawn = (spread.withColumn("choices", choices)
             .withColumn("u", md5_draw(tag, 0) / F.lit(float(2 ** 52)))
             .withColumn("v", md5_draw(tag, 1) / F.lit(float(2 ** 52)))
             .withColumn("c", F.get("choices", F.floor(F.col("u") * F.size("choices")).cast("int")))
             .withColumn("t", F.col("c.lo") + F.col("v") * (F.col("c.hi") - F.col("c.lo"))))
    split = F.col("c").isNotNull() & ~F.isnan("t")
    here = F.struct("node", F.lit(depth).alias("depth"), F.col("c.feature").alias("feature"), F.col("t").alias("threshold"))
    right = F.when(F.col("c.x") < F.col("t"), 0).otherwise(1)
    return drawn.select("tree", *feats,
                        F.when(split, F.concat("path", F.array(here))).otherwise(F.col("path")).alias("path"),
                        F.when(split, F.col("node") * 2 + 1 + right).otherwise(F.col("node")).alias("node"))


def fit_forest(df: DataFrame, cols=FEATURES, n_trees: int = 100, max_samples: int = 256,
               seed: int = 42, id_col: str = "id") -> pd.DataFrame:
    """Grow the forest on Spark; returns the node table (bounded: trees x (2 max_samples - 1) rows).

    Columns: tree, node (0 is the root, children 2 k + 1 and 2 k + 2), depth,
    feature (-1: leaf), threshold, size (sample rows in the node).
    """
    n = df.count()
    if n == 0:
        empty = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (
            ("tree", "int32"), ("node", "int64"), ("depth", "int32"), ("feature", "int32"),
            ("threshold", "float64"), ("size", "int64"))})
        empty.attrs["max_samples"] = 0
        return empty
    m = min(max_samples, n)
    max_depth = max(1, math.ceil(math.log2(max(m, 2))))
    feats = [f"f{i}" for i in range(len(cols))]
    node = "struct<node:bigint,depth:int,feature:int,threshold:double>"
    grown = _samples(df, cols, n, m, n_trees, seed, id_col).select(
        "*", F.lit(0).cast("bigint").alias("node"), F.array().cast(f"array<{node}>").alias("path"))
    for depth in range(max_depth):
        grown = _one_level(grown, feats, depth, seed)
    leaf = F.struct("node", F.size("path").alias("depth"), F.lit(-1).alias("feature"), F.lit(0.0).alias("threshold"))
    rows = (grown.select("tree", F.explode(F.concat("path", F.array(leaf))).alias("n")).select("tree", "n.*")
            .groupBy("tree", "node", "depth", "feature", "threshold").agg(F.count(F.lit(1)).alias("size"))
            .toPandas())   # bounded by trees * (2 * max_samples - 1)
    rows.attrs["max_samples"] = m
    return rows


def _tree_arrays(forest: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """Per tree: feature, threshold and path length (in 10^-9) by node number."""
    slots = 2 * int(forest["node"].max()) + 3
    empty = np.floor(np.log2(np.arange(slots) + 1)) * UNIT   # a child without sample rows: its depth
    out = []
    for _, t in forest.groupby("tree"):
        node = t["node"].to_numpy()
        feat, thr, length = np.full(slots, -1), np.zeros(slots), empty.astype(np.int64)
        feat[node], thr[node] = t["feature"], t["threshold"]
        length[node] = np.rint((t["depth"].to_numpy() + c_factor(t["size"])) * UNIT).astype(np.int64)
        out.append((feat, thr, length))
    return out


def _path_totals(X: np.ndarray, trees: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    total = np.zeros(len(X), dtype=np.int64)
    for feat, thr, length in trees:
        node = np.zeros(len(X), dtype=np.int64)
        idx = np.flatnonzero(feat[node] >= 0)
        while len(idx):
            k = node[idx]
            node[idx] = 2 * k + np.where(X[idx, feat[k]] < thr[k], 1, 2)
            idx = idx[feat[node[idx]] >= 0]
        total += length[node]
    return total


def score_forest(df: DataFrame, forest: pd.DataFrame, cols=FEATURES, id_col: str = "id") -> DataFrame:
    """(id, iforest_path, iforest_score): the sum over trees of the path length in 10^-9, and
    2^(-E[h(x)] / c(max_samples)); a higher score is more anomalous."""
    spark = df.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(forest)
    n_trees = int(forest["tree"].nunique())
    cn = float(c_factor([forest.attrs.get("max_samples", 256)])[0]) or 1.0

    def score(it):
        trees = _tree_arrays(bc.value)   # once per task
        for pdf in it:
            X = pdf[list(cols)].to_numpy(dtype=float)
            yield pd.DataFrame({id_col: pdf[id_col], "iforest_path": _path_totals(X, trees)})

    paths = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols]) \
        .mapInPandas(score, schema=f"{id_col} {df.schema[id_col].dataType.simpleString()}, iforest_path long")
    return paths.withColumn("iforest_score", F.pow(F.lit(2.0), -F.col("iforest_path") / F.lit(n_trees * UNIT * cn)))


def isolation_flags(df: DataFrame, cols=FEATURES, contamination: float = 0.05, n_trees: int = 100,
                    max_samples: int = 256, seed: int = 42, id_col: str = "id") -> DataFrame:
    """(id, iforest_score, iforest_flag): flag 1 for the top ``contamination`` share of scores (shortest paths)."""
    forest = fit_forest(df, cols, n_trees, max_samples, seed, id_col)
    if forest.empty:   # no rows: nothing to fit, an empty result with the full schema
        return df.select(F.col(id_col),
                         F.lit(None).cast("double").alias("iforest_score"),
                         F.lit(0).alias("iforest_flag"))
    scored = score_forest(df, forest, cols, id_col)
    scored = cut_lineage(scored)
    thr = exact_quantile(scored, "iforest_path", contamination)
    return scored.select(id_col, "iforest_score",
                         (F.col("iforest_path") < F.lit(thr)).cast("int").alias("iforest_flag"))
