"""Embedding whitening: distributed covariance, eigenvectors in float32, corrected in higher precision.

Vectors become whole numbers; every distinct one is fitted once. Sums and the
centred cross products are added up task by task, in Spark; only the d x d
covariance, whose size the rows do not change, comes to the driver. There its
eigenvectors are computed in float32 (fast, about 7 digits) and then corrected
by the iteration of Ogita and Aishima, which consists of matrix products in
higher precision (80-bit ``longdouble`` where the platform has it) and doubles
the digits each time. For eigenvalues too close for that, the iteration only
makes the vectors orthonormal; each such cluster is then solved as a small
eigenproblem of its own in the space that its vectors span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.store import dropped, stored
from riskloom.session import ship_package

SCALE = 64
SHIFT = 1_000_000
LARGEST = 2.0 ** 31   # a task's sums of entries up to this stay exact in 64 bits
COMPONENTS = 16
SLICE = 4096          # rows of a matrix at once
HIGH = np.longdouble
NEAR = 1000           # eigenvalues closer than so many times the present error are a cluster


def _matrices(b: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as a matrix of doubles) for each vector length of the batch.

    Rows that are null or hold a null, non-finite or too large entry are left out.
    """
    vecs = b.column(column)
    ends = vecs.offsets.to_numpy()
    first, lens = ends[:-1].astype(np.int64), np.diff(ends)
    flat = vecs.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    ok = ~vecs.is_null().to_numpy(zero_copy_only=False) & (lens > 0)
    for dim in np.unique(lens[ok]):
        rows = np.flatnonzero(ok & (lens == dim))
        for i in range(0, len(rows), SLICE):
            part = rows[i:i + SLICE]
            m = flat[first[part][:, None] + np.arange(dim)]
            good = (np.abs(m) <= LARGEST).all(1)  # False for NaN
            if good.any():
                yield part[good], m[good]


def whole_numbers(m: np.ndarray) -> np.ndarray:
    """floor(64 c); the shift of one million is added only where it shows, in ``x``."""
    return np.floor(m * SCALE).astype(np.int64)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, m in _matrices(b, "vec"):
            y = whole_numbers(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(y), y.shape[1], np.int32)), pa.array([r.tobytes() for r in y], pa.binary())],
                names=["dim", "y"])


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(dim, matrix) of the whole-number vectors of a batch, in slices."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        for i in range(0, len(rows), SLICE):
            raw = b.column("y").take(pa.array(rows[i:i + SLICE])).to_pylist()
            yield int(dim), np.frombuffer(b"".join(raw), np.int64).reshape(-1, dim)


def _totals(held: dict[int, np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([v.ravel() for v in held.values()], pa.list_(kind))],
        names=["dim", "v"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for dim, y in _unpacked(b):
            held[dim] = held.get(dim, 0) + np.append(y.sum(0), len(y))
    yield _totals(held, pa.int64())


def _spread(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly; whole numbers of any size where 64 bits might not hold it."""
    if n * int(np.abs(y).max(initial=0)) + max(map(abs, sums.tolist())) >= 1 << 62:
        return y.astype(object) * n - sums.astype(object)
    return n * y - sums.astype(np.int64)


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n in double precision."""
    return _spread(y, n, sums).astype(np.float64) / n


def _products(fits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, y in _unpacked(b):
                z = _centred(y, *fits.value[dim][:2])
                held[dim] = held.get(dim, 0) + z.T @ z
        yield _totals(held, pa.float64())
    return run


def _whitened_products(fits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, y in _unpacked(b):
                n, sums, turn, mean = fits.value[dim]
                w = _centred(y, n, sums) @ turn
                w -= mean
                held[dim] = held.get(dim, 0) + (w.T @ w if w.shape[1] else np.zeros(0))
        yield _totals({k: v for k, v in held.items() if v.size}, pa.float64())
    return run


def _whitened_sums(fits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, y in _unpacked(b):
                n, sums, turn = fits.value[dim]
                held[dim] = held.get(dim, 0) + (_centred(y, n, sums) @ turn).sum(0)
        yield _totals({k: v for k, v in held.items() if v.size}, pa.float64())
    return run


def _added(df: DataFrame, run, kind: str) -> dict[int, np.ndarray]:
    """Each task's arrays of (dim, v), added up entry by entry; as many entries as the longest array."""
    total = "decimal(38,0)" if kind == "long" else "double"
    rows = (df.mapInArrow(run, f"dim int, v array<{kind}>").select("dim", F.posexplode("v").alias("at", "v"))
            .groupBy("dim", "at").agg(F.sum(F.col("v").cast(total)).alias("v")).toPandas().sort_values(["dim", "at"]))
    return {int(dim): np.array([int(x) for x in g], object) if kind == "long" else g.to_numpy(np.float64)
            for dim, g in rows.groupby("dim")["v"]}


def _solve_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, gap: float) -> np.ndarray:
    """Turn the vectors of each run of values closer than ``gap`` by a small eigenproblem in their span."""
    order = np.argsort(-values.astype(np.float64), kind="stable")
    x, values = x[:, order], values[order]
    start = 0
    for end in range(1, len(values) + 1):
        if end < len(values) and values[end - 1] - values[end] <= gap:
            continue
        if end - start > 1:
            own = x[:, start:end]
            middle = values[start:end].mean()
            # shifted by the cluster's middle, the differences keep their digits in double
            inner = own.T @ (a @ own) - middle * (own.T @ own)
            inner = ((inner + inner.T) / 2).astype(np.float64)
            x[:, start:end] = own @ np.linalg.eigh(inner)[1][:, ::-1].astype(HIGH)
        start = end
    return x


def eigenvectors(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    Starts from float32. A round corrects all vectors at once by matrix
    products: X + X E, where E removes the rest of the products X'X - I and
    X'AX, entry by entry divided by the gap of the two eigenvalues. Vectors
    whose gap is not well above the present error are only made orthonormal
    that way; such a cluster is solved as an eigenproblem of its own, and again
    when the error has become much smaller.
    """
    d = len(v)
    a = v.astype(HIGH)
    size = float(np.abs(v).sum(1).max()) if d else 0.0
    if not size:
        return np.zeros(d), np.eye(d)
    a = a / HIGH(size)  # float32 holds numbers up to 10^38 only
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    done = np.finfo(np.float64).eps / 4
    solved_at, last = np.inf, np.inf
    for _ in range(rounds):
        # both kept symmetric: then E + E' = R however small a gap, and noise only turns close vectors
        s, r = x.T @ (a @ x), np.eye(d, dtype=HIGH) - x.T @ x
        s, r = (s + s.T) / 2, (r + r.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        error = float(2 * (np.abs(off).sum(1).max() + np.abs(r).sum(1).max()))
        gap = values[None, :] - values[:, None]
        width = max(NEAR * error, np.finfo(np.float64).eps)
        near = np.abs(gap) <= width
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        step = float(np.abs(e).max())
        np.fill_diagonal(near, False)
        if near.any() and error < solved_at / 1000:
            x = _solve_clusters(a, x, values, width)
            solved_at, last = error, np.inf
        elif step <= done or step > last / 2 and float(np.abs(r).max()) <= done:
            break
        else:
            last = step
    for _ in range(3):  # turns of very close vectors by noise leave second-order errors of length
        x = x + x @ (np.eye(d, dtype=HIGH) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values.astype(np.float64), kind="stable")
    x = x[:, order]
    x = x / np.sqrt((x * x).sum(0))
    return (values[order] * HIGH(size)).astype(np.float64), x.astype(np.float64)


def _fit(n: int, sums: np.ndarray, products: np.ndarray, components: int) -> dict:
    d = len(sums)
    v = products.reshape(d, d) / n
    v = (v + v.T) / 2
    values, vectors = eigenvectors(v)
    # what rounding alone can make of a direction without variance is no component
    floor = 8 * d * np.finfo(np.float64).eps * max(values[0], 0.0)
    k = min(components, int((values > floor).sum()))
    return {"values": values[:k], "trace": float(np.trace(v)), "vectors": vectors[:, :k],
            "turn": vectors[:, :k] / np.sqrt(values[:k])}


def _project(fits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, m in _matrices(b, "vec"):
                f = fits.value[m.shape[1]]
                c = f["turn"].shape[1]
                if not c:
                    continue
                for i in range(0, len(rows), SLICE):
                    y = whole_numbers(m[i:i + SLICE])
                    ids = b.column("vec_id").take(pa.array(np.repeat(rows[i:i + SLICE], c)))
                    spread = _spread(y, f["n"], f["sums"])
                    w = spread.astype(np.float64) / f["n"] @ f["turn"]
                    if (spread.astype(np.float64) ** 2).sum(1).max() >= 2.0 ** 62:
                        spread = spread.astype(object)
                    deviation = [v if v < 1 << 63 else None for v in (spread * spread).sum(1).tolist()]
                    deviation = pa.array([v for v in deviation for _ in range(c)], pa.int64())
                    n = len(y)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), n)),
                         pa.array(np.full(n * c, f["n"], np.int64)), deviation, pa.array(w.ravel()),
                         pa.array(np.tile(f["values"] / f["trace"], n)), pa.array(np.full(n * c, f["error"]))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whitened(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
             vec_col: str = "embedding") -> DataFrame:
    """Rows of ``df`` on the leading principal components, each with variance one.

    Every entry c becomes the whole number x = floor(64 c) + 1000000; the fit
    list is each distinct x vector once. Returns for each row and component:
    vec_id, component (from 1, by falling eigenvalue), n (length of the fit
    list), deviation (sum over dimensions of (n x - S)^2, exact; null beyond the
    range of long), whitened, explained (share of the trace) and identity_error
    (largest absolute entry of the whitened fit list's covariance minus the
    identity).

    Defined cases: vectors that are null, empty, hold null or non-finite
    entries, or entries beyond 2^40, are left out; zero vectors are not.
    Vectors of each length are fitted by themselves. Directions without
    variance (up to rounding) are no components: a table of one distinct vector
    gives no rows, nor does an empty one. Null and repeated ids are kept as
    rows. Other columns are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fit = stored(rows.select("vec").where("vec is not null").mapInArrow(_distinct, "dim int, y binary").distinct(), "fit")
    send = spark.sparkContext.broadcast

    totals = _added(fit, _sums, "long")
    first = {d: (int(v[-1]), v[:-1]) for d, v in totals.items()}
    products = _added(fit, _products(send(first)), "double")
    fits = {d: {"n": n, "sums": s} | _fit(n, s, products[d], components) for d, (n, s) in first.items()}
    turn = {d: (f["n"], f["sums"], f["turn"]) for d, f in fits.items()}
    means = _added(fit, _whitened_sums(send(turn)), "double")
    turn = {d: (*t, means[d] / t[0] if d in means else np.zeros(0)) for d, t in turn.items()}
    after = _added(fit, _whitened_products(send(turn)), "double")
    for d, f in fits.items():
        k = f["turn"].shape[1]
        f["error"] = float(np.abs(after[d].reshape(k, k) / f["n"] - np.eye(k)).max()) if k else 0.0
    dropped(fit)
    return rows.where("vec is not null").mapInArrow(
        _project(send(fits)), "vec_id long, component int, n long, deviation long, whitened double, "
                                          "explained double, identity_error double")
