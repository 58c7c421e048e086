"""Exact density-based noise flags (M5): the points a DBSCAN run labels -1.

A point is *core* when at least ``min_samples`` points (itself included) lie
within ``eps``; it is *noise* when it is not core and no core point lies within
``eps``. Only the noise flag is produced (cluster ids are never used).

Grid method (Gunawan 2013; Gan & Tao 2015), all as joins and aggregations:

1. Points go to fine cells of side ``eps / sqrt(d)``: any two points of one
   cell are within ``eps``, so a cell holding ``min_samples`` points is all
   core, with no pair ever formed.
2. Points count per fine cell (a pre-aggregated table). Occupied cells are
   paired with the occupied cells near them, through a coarse grid over three
   of their coordinates, so any number of features runs; a point of a sparse
   cell goes with the cells of its cell's pairs: those entirely
   inside its ``eps`` ball add their count, cells entirely outside add
   nothing, and only cells cut by the ball are checked point by point.
3. Non-core points test the same way against core points only.

Box distances carry a relative safety margin, so floating-point rounding only
moves a cell to the exact point-by-point path, never to a wrong answer.

The point table and the core flags are each read by several later joins, so
both are written once to the shared checkpoint folder (``checkpoint()``):
plans stay small and a lost executor does not recompute from the source.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage

_MARGIN = 1e-9
GRID_DIMS = 3           # dimensions of the coarse grid on which occupied cells meet: 27 neighbours at most


def _cells(df: DataFrame, cols, side: float, prefix: str) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(side)).cast("long").alias(f"{prefix}{i}") for i, c in enumerate(cols)]


def _dist(cols_a, cols_b) -> Column:
    s = None
    for a, b in zip(cols_a, cols_b):
        t = (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
        s = t if s is None else s + t
    return F.sqrt(s)


def _box_dists(cols, cell_cols, side: float) -> tuple[Column, Column]:
    """Min and max distance from the point to the closed box of a cell."""
    mn = mx = None
    for c, k in zip(cols, cell_cols):
        lo = F.col(k) * F.lit(side)
        hi = (F.col(k) + 1) * F.lit(side)
        x = F.col(c)
        near = F.greatest(lo - x, F.lit(0.0), x - hi)
        far = F.greatest(F.abs(x - lo), F.abs(x - hi))
        mn = near * near if mn is None else mn + near * near
        mx = far * far if mx is None else mx + far * far
    return F.sqrt(mn), F.sqrt(mx)


def _near_cells(counts: DataFrame, cc: list[str], reach: int, side: float, eps: float) -> DataFrame:
    """(c0.., n0.., cnt): every occupied cell with every occupied cell that a ball around one of its points can reach.

    Cells meet on a coarse grid over at most GRID_DIMS of their coordinates,
    whose cells are ``reach`` wide, and are then compared in all coordinates.
    The work goes by the occupied cells, whatever the number of dimensions.
    """
    grid = [F.floor(F.col(c) / reach).alias(f"g{i}") for i, c in enumerate(cc[:GRID_DIMS])]
    keys = [f"g{i}" for i in range(len(grid))]
    steps = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, o)])
                      for o in itertools.product((-1, 0, 1), repeat=len(keys))])
    own = counts.select(*cc, *grid).withColumn("o", F.explode(steps)).select(
        *cc, *[(F.col(k) + F.col(f"o.{k}")).alias(k) for k in keys])
    other = counts.select(*[F.col(c).alias(f"n{i}") for i, c in enumerate(cc)], "cnt", *grid)
    gaps = [F.greatest(F.abs(F.col(c) - F.col(f"n{i}")) - 1, F.lit(0)) for i, c in enumerate(cc)]
    square = reduce(lambda a, b: a + b, [g * g for g in gaps])
    return (own.join(other, keys).where(square * F.lit(side * side) <= eps * eps * (1 + _MARGIN) ** 2)
            .select(*cc, *[f"n{i}" for i in range(len(cc))], "cnt"))


def density_noise(df: DataFrame, cols, eps: float = 0.5, min_samples: int = 5,
                  id_col: str = "id") -> DataFrame:
    """(id, is_core, dbscan_flag) for every point; ``dbscan_flag`` is 1 for noise."""
    d = len(cols)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    reach = math.ceil(eps / side)
    cc = [f"c{i}" for i in range(d)]
    pts = df.select(F.col(id_col).alias("pid"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    xs = [f"x{i}" for i in range(d)]
    # every later step reads the points several times: materialise them once
    pts = cut_lineage(pts.select("pid", *xs, *_cells(pts, xs, side, "c")))

    counts = pts.groupBy(*cc).agg(F.count(F.lit(1)).alias("cnt"))
    dense = counts.filter(F.col("cnt") >= min_samples).select(*cc)

    sparse_pts = pts.join(dense, cc, "left_anti")
    near = cut_lineage(_near_cells(counts, cc, reach, side, eps))
    nb = sparse_pts.join(near, cc).select("pid", *xs, *[f"n{i}" for i in range(d)], "cnt")
    ncell = [f"n{i}" for i in range(d)]
    bmin, bmax = _box_dists(xs, ncell, side)
    # cells wholly outside the eps-ball (about half of the neighbour grid) are dropped map-side
    nb = nb.withColumn("bmin", bmin).filter(F.col("bmin") <= eps * (1 + _MARGIN)).withColumn("bmax", bmax)
    withc = nb
    full = (withc.filter(F.col("bmax") <= eps * (1 - _MARGIN))
            .groupBy("pid").agg(F.sum("cnt").alias("k_full")))
    # exact early exit: a point whose fully covered cells already hold min_samples is core
    settled = full.filter(F.col("k_full") >= min_samples).select("pid")
    partial = (withc.filter((F.col("bmax") > eps * (1 - _MARGIN)) & (F.col("bmin") <= eps * (1 + _MARGIN)))
               .join(settled, "pid", "left_anti")
               .select("pid", *xs, *ncell))
    others = pts.select(F.col("pid").alias("qid"), *[F.col(x).alias(f"y{i}") for i, x in enumerate(xs)],
                        *[F.col(c).alias(n) for c, n in zip(cc, ncell)])
    ys = [f"y{i}" for i in range(d)]
    k_part = (partial.join(others, ncell).filter(_dist(xs, ys) <= eps)
              .groupBy("pid").agg(F.count(F.lit(1)).alias("k_part")))
    sparse_core = (sparse_pts.select("pid").join(full, "pid", "left").join(k_part, "pid", "left")
                   .filter(F.coalesce("k_full", F.lit(0)) + F.coalesce("k_part", F.lit(0)) >= min_samples)
                   .select("pid", F.lit(True).alias("core_s")))
    flagged = (pts.join(dense.withColumn("core_d", F.lit(True)), cc, "left")
               .join(sparse_core, "pid", "left")
               .withColumn("is_core", F.coalesce("core_d", "core_s", F.lit(False)))
               .drop("core_d", "core_s"))
    flagged = cut_lineage(flagged)

    # border test for non-core points: any core point within eps?
    core_counts = (flagged.filter("is_core").groupBy(*cc).agg(F.count(F.lit(1)).alias("ccnt"))
                   .select(*[F.col(c).alias(n) for c, n in zip(cc, ncell)], "ccnt"))
    nb2 = (flagged.filter(~F.col("is_core")).select("pid", *xs, *cc).join(near.drop("cnt"), cc)
           .select("pid", *xs, *ncell))
    nb2 = nb2.withColumn("bmin", bmin).filter(F.col("bmin") <= eps * (1 + _MARGIN)).withColumn("bmax", bmax)
    w2 = nb2.join(core_counts, ncell)
    near_full = w2.filter(F.col("bmax") <= eps * (1 - _MARGIN)).select("pid").distinct()
    # exact early exit: a fully covered cell with a core point already decides "not noise"
    part2 = (w2.filter((F.col("bmax") > eps * (1 - _MARGIN)) & (F.col("bmin") <= eps * (1 + _MARGIN)))
             .join(near_full, "pid", "left_anti")
             .select("pid", *xs, *ncell))
    core_pts = (flagged.filter("is_core")
                .select(*[F.col(x).alias(f"y{i}") for i, x in enumerate(xs)],
                        *[F.col(c).alias(n) for c, n in zip(cc, ncell)]))
    near_part = part2.join(core_pts, ncell).filter(_dist(xs, ys) <= eps).select("pid")
    bordered = near_full.unionByName(near_part).distinct().withColumn("border", F.lit(True))
    out = flagged.join(bordered, "pid", "left")
    noise = (~F.col("is_core")) & F.col("border").isNull()
    return out.select(F.col("pid").alias(id_col), "is_core", noise.cast("int").alias("dbscan_flag"))
