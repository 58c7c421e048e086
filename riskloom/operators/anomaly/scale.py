"""Min-max scaling (M2, G12) and exact quantiles (G11) that scale out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("amount", "balance", "frequency")


def column_bounds(df: DataFrame, cols=FEATURES) -> dict[str, tuple[float, float]]:
    """Min and max of each column in one aggregation (2 numbers per column reach the driver)."""
    row = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols],
                 *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    return {c: (row[f"mn_{c}"], row[f"mx_{c}"]) for c in cols}


def minmax_scale(df: DataFrame, cols=FEATURES, bounds=None, suffix: str = "") -> DataFrame:
    """M2: ``(x - min) / (max - min)``; a constant column scales to 0 (as scikit-learn does)."""
    b = bounds or column_bounds(df, cols)
    out = df
    for c in cols:
        lo, hi = b[c]
        rng = (hi - lo) if (lo is not None and hi is not None) else None
        if rng is None:
            e = F.lit(None).cast("double")
        elif rng == 0:
            e = F.when(F.col(c).isNotNull(), F.lit(0.0))
        else:
            e = (F.col(c) - F.lit(lo)) / F.lit(rng)
        out = out.withColumn(c + suffix, e)
    return out


def exact_quantiles(df: DataFrame, cols, q: float, accuracy: int = 100_000) -> dict[str, float | None]:
    """Exact linear-interpolated quantiles (NumPy's default) of several columns, without one giant buffer.

    ``percentile`` keeps every value of a group in one aggregation buffer. Here
    one aggregation counts each column and brackets the target rank with
    ``percentile_approx`` (rank error at most ``n / accuracy``), a second counts
    the rows below and up to each bracket, and the distinct values inside the
    brackets are counted and ranked by their running counts, all columns in
    one job. Ties are one row each, however many there are, so at most about
    ``4 n / accuracy`` untied values of a column plus the tied ones' single
    rows are ranked. A bracket that misses its rank is widened.
    """
    cols = list(cols)
    vals = {c: F.col(c).cast("double") for c in cols}
    ok = {c: v.isNotNull() & ~F.isnan(v) for c, v in vals.items()}
    d = {c: 2.0 / accuracy for c in cols}
    # first pass: counts and initial brackets together (a bracket does not depend on n)
    qs = {c: (max(0.0, q - d[c]), min(1.0, q + d[c])) for c in cols}
    br = df.agg(*[F.count_if(ok[c]).alias(f"n_{c}") for c in cols],
                *[F.percentile_approx(F.when(ok[c], vals[c]), list(qs[c]), accuracy).alias(f"b_{c}")
                  for c in cols]).first()
    n = {c: br[f"n_{c}"] for c in cols}
    want = {}
    for c in cols:
        if n[c]:
            pos = q * (n[c] - 1)
            want[c] = (math.floor(pos), math.ceil(pos), pos - math.floor(pos))
    pending = list(want)
    bounds: dict[str, tuple[float, float, int]] = {}
    first_round = True
    while pending:
        if not first_round:
            qs = {c: (max(0.0, q - d[c]), min(1.0, q + d[c])) for c in pending}
            br = df.agg(*[F.percentile_approx(F.when(ok[c], vals[c]), list(qs[c]), accuracy).alias(f"b_{c}")
                          for c in pending]).first()
        first_round = False
        lohi = {}
        for c in pending:
            lo, hi = br[f"b_{c}"]
            lo = float("-inf") if qs[c][0] == 0.0 else lo
            hi = float("inf") if qs[c][1] == 1.0 else hi
            lohi[c] = (lo, hi)
        cnt = df.agg(*[F.count_if(ok[c] & (vals[c] < F.lit(lohi[c][0]))).alias(f"a_{c}") for c in pending],
                     *[F.count_if(ok[c] & (vals[c] <= F.lit(lohi[c][1]))).alias(f"z_{c}") for c in pending]).first()
        still = []
        for c in pending:
            k0, k1, _ = want[c]
            below, upto = cnt[f"a_{c}"], cnt[f"z_{c}"]
            if below <= k0 and upto > k1:
                bounds[c] = (lohi[c][0], lohi[c][1], below)
            else:
                d[c] *= 4
                still.append(c)
        pending = still
    out: dict[str, float | None] = {c: None for c in cols}
    if not bounds:
        return out
    slices = None
    for c, (lo, hi, below) in bounds.items():
        sl = df.select(F.lit(c).alias("col"), vals[c].alias("v"), F.lit(below).alias("below")) \
            .filter(ok[c] & (F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi)))
        slices = sl if slices is None else slices.unionByName(sl)
    counts = slices.groupBy("col", "below", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("col").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("n").over(w) + F.col("below"))
    picks = F.lit(False)
    for c in bounds:
        k0, k1, _ = want[c]
        # a value holds the ranks from upto - n to upto - 1
        for k in (k0, k1):
            picks = picks | ((F.col("col") == c) & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k))
    rows = ranked.filter(picks).collect()   # at most two values per column
    got = {(c, k): r["v"] for c in bounds for k in want[c][:2] for r in rows
           if r["col"] == c and r["upto"] - r["n"] <= k < r["upto"]}
    for c in bounds:
        k0, k1, frac = want[c]
        v0, v1 = got[(c, k0)], got[(c, k1)]
        out[c] = v0 + (v1 - v0) * frac
    return out


def exact_quantile(df: DataFrame, col: str, q: float, accuracy: int = 100_000) -> float | None:
    """Exact quantile of one column (see ``exact_quantiles``)."""
    return exact_quantiles(df, [col], q, accuracy)[col]


def quantiles_frame(df: DataFrame, cols, q: float, digits: int = 6) -> DataFrame:
    """One-row frame ``p{q}_{col}`` of exact quantiles (rounded), computed by ``exact_quantile``."""
    spark = df.sparkSession
    got = exact_quantiles(df, cols, q)
    vals = [got[c] for c in cols]
    names = [f"p{int(round(q * 100))}_{c}" for c in cols]
    row = [None if v is None else round(v, digits) for v in vals]
    return spark.createDataFrame([tuple(row)], ", ".join(f"{n} double" for n in names))
