"""Autoencoder reconstruction-error flags.

Network: d inputs -> ``hidden`` ReLU units -> d sigmoid outputs, MSE loss, Adam.

Training is synchronous mini-batch descent with one schedule at every input
size. A hash deals the rows to the held-out share and the others to ``batches``
mini-batches. A step computes the gradient of every row of its batch at the same
weights in NumPy, inside ``mapInPandas``; a Spark aggregation adds the gradients
up and one row (d*h + h + h*d + d numbers, 17 for d = 3) reaches the driver,
which makes the Adam step. Gradients are added as whole numbers of 2^-32, so the
sums are exact and the weights are the same at any partitioning, row order and
number of executors. A task holds one Arrow batch. Each mini-batch is a table of
its own in the checkpoint folder, so a step reads only its rows, and a lost
executor costs the tasks of one step. ``epochs * batches`` steps are as many
short jobs, whatever the size. The default rate makes steps * rate 2.65, as 50
epochs over 840 rows in batches of 16 at 0.001 do; with many times that the
network learns to reproduce outliers as well.

The loss on the learned and on the held-out rows after each epoch is reported
(``training_history``).

Scoring needs no Python: the trained weights become native column expressions
(ReLU = ``greatest(0, .)``, sigmoid = ``1 / (1 + exp(-.))``), the error is the
mean absolute difference, and the flag is ``error > exact 95th percentile``.
Rows with a null or non-finite feature are neither learned from nor held out;
their error is null or NaN. Features are expected in [0, 1].
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.anomaly.scale import FEATURES, exact_quantile
from riskloom.session import cut_lineage, ship_package

UNIT = 2.0 ** 32   # gradients and losses are added as whole numbers of 1 / UNIT
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7


def _init(d: int, h: int, seed: int):
    rng = np.random.default_rng(seed)
    lim1 = np.sqrt(6.0 / (d + h))
    lim2 = np.sqrt(6.0 / (h + d))
    return [rng.uniform(-lim1, lim1, (d, h)), np.zeros(h), rng.uniform(-lim2, lim2, (h, d)), np.zeros(d)]


def _flat(ws):
    return np.concatenate([w.ravel() for w in ws])


def _unflat(v, d, h):
    a = d * h
    return [v[:a].reshape(d, h), v[a:a + h], v[a + h:a + h + h * d].reshape(h, d), v[a + h + h * d:]]


def _row_gradients(X: np.ndarray, ws) -> tuple[np.ndarray, np.ndarray]:
    """Per row the gradient of its mean squared error (flat, as the weights) and that error."""
    W1, b1, W2, b2 = ws
    z1 = X @ W1 + b1
    a1 = np.maximum(z1, 0.0)
    out = 1.0 / (1.0 + np.exp(-(a1 @ W2 + b2)))
    diff = out - X
    g2 = 2.0 * diff / X.shape[1] * out * (1.0 - out)
    g1 = (g2 @ W2.T) * (z1 > 0)
    n = len(X)
    grads = np.concatenate([(X[:, :, None] * g1[:, None, :]).reshape(n, -1), g1,
                            (a1[:, :, None] * g2[:, None, :]).reshape(n, -1), g2], axis=1)
    return grads, (diff * diff).mean(axis=1)


def _summed(rows: DataFrame, w: np.ndarray, cols, hidden: int) -> tuple[np.ndarray, float, int]:
    """Mean gradient, mean loss and number of rows, added up exactly by Spark."""
    cols, width = list(cols), len(w) + 1

    def partial(it):
        for pdf in it:
            X = pdf[cols].to_numpy(dtype=float)
            if len(X):
                grads, loss = _row_gradients(X, _unflat(w, len(cols), hidden))
                whole = np.rint(np.column_stack([grads, loss]) * UNIT).astype(np.int64).sum(axis=0)
                yield pd.DataFrame({"g": [whole.tolist()], "n": [len(X)]})

    adding = ", ".join(f"sum(cast(g[{i}] as decimal(20,0))) as s{i}" for i in range(width))
    sums = (rows.select(*cols).mapInPandas(partial, schema="g array<long>, n long")
            .agg(F.expr(f"struct(sum(n) as n, {adding}) as sums")).first()["sums"])
    n = sums["n"] or 0
    if n == 0:
        return np.zeros(len(w)), 0.0, 0
    means = np.array([float(sums[f"s{i}"]) for i in range(width)]) / UNIT / n
    return means[:-1], float(means[-1]), n


def train(scaled: DataFrame, cols=FEATURES, hidden: int = 2, epochs: int = 20, batches: int = 4,
          lr: float = 0.033, val_share: float = 0.2, seed: int = 42, id_col: str = "id",
          history: bool = False) -> tuple[np.ndarray, list[tuple[int, float | None, float | None]]]:
    """Weights (flat) and, if ``history``, (epoch, loss, held-out loss) after each epoch.

    Epoch 0 is before the first step. A loss over no rows is None.
    """
    ship_package(scaled.sparkSession)
    cols = list(cols)
    share = int(round(val_share * 100))
    usable = F.lit(True)
    for c in cols:
        usable = usable & F.coalesce(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.lit(False))
    dealt = scaled.filter(usable).select(
        F.when(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(100)) < share, F.lit(-1))
        .otherwise(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(batches)).cast("int")).alias("part"),
        *[F.col(c).cast("double").alias(c) for c in cols])
    # partitions follow the bytes: adaptive execution merges small ones and splits large ones
    parts = {p: cut_lineage(dealt.filter(F.col("part") == p).select(*cols).hint("rebalance"))
             for p in ([-1] if history else []) + list(range(batches))}
    w = _flat(_init(len(cols), hidden, seed))
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    seen = []

    def note(epoch):
        learned = [_summed(parts[p], w, cols, hidden)[1:] for p in range(batches)]
        rows = sum(n for _, n in learned)
        held, held_rows = _summed(parts[-1], w, cols, hidden)[1:]
        seen.append((epoch, sum(x * n for x, n in learned) / rows if rows else None, held if held_rows else None))

    if history:
        note(0)
    for epoch in range(1, epochs + 1):
        for p in range(batches):
            g, _, n = _summed(parts[p], w, cols, hidden)
            if n == 0:
                continue
            t += 1
            m = BETA1 * m + (1 - BETA1) * g
            v = BETA2 * v + (1 - BETA2) * g * g
            w = w - lr * (m / (1 - BETA1 ** t)) / (np.sqrt(v / (1 - BETA2 ** t)) + EPSILON)
        if history:
            note(epoch)
    return w, seen


def training_history(scaled: DataFrame, cols=FEATURES, **train_kw) -> DataFrame:
    """(epoch, loss, held_out_loss): mean squared error after each epoch; one row an epoch and one before."""
    _, seen = train(scaled, cols, history=True, **train_kw)
    return scaled.sparkSession.createDataFrame(seen, "epoch int, loss double, held_out_loss double")


def reconstruction(cols, w: np.ndarray, hidden: int = 2) -> list[Column]:
    """Reconstructed value of every feature as native expressions of the scaled inputs."""
    d = len(cols)
    W1, b1, W2, b2 = _unflat(w, d, hidden)
    hs = []
    for j in range(hidden):
        z = F.lit(float(b1[j]))
        for i, c in enumerate(cols):
            z = z + F.col(c) * F.lit(float(W1[i, j]))
        hs.append(F.greatest(F.lit(0.0), z))
    outs = []
    for k in range(d):
        z = F.lit(float(b2[k]))
        for j in range(hidden):
            z = z + hs[j] * F.lit(float(W2[j, k]))
        outs.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return outs


def mean_abs_error(cols, recon: list[Column]) -> Column:
    """Row-wise mean absolute error over the features."""
    s = None
    for c, r in zip(cols, recon):
        t = F.abs(r - F.col(c))
        s = t if s is None else s + t
    return s / F.lit(len(cols))


def autoencoder_flags(scaled: DataFrame, cols=FEATURES, q: float = 0.95, id_col: str = "id",
                      weights=None, **train_kw) -> DataFrame:
    """(id, ae_error, ae_flag): flag 1 when the error is strictly above its q-quantile.

    ``weights`` (flat: inputs x hidden, hidden, hidden x outputs, outputs) saves the training.
    """
    w = np.asarray(weights, dtype=float) if weights is not None else train(scaled, cols, id_col=id_col, **train_kw)[0]
    err = scaled.select(id_col, mean_abs_error(cols, reconstruction(cols, w, train_kw.get("hidden", 2)))
                        .alias("ae_error"))
    thr = exact_quantile(err, "ae_error", q)
    return err.select(id_col, "ae_error", (F.col("ae_error") > F.lit(thr)).cast("int").alias("ae_flag"))
