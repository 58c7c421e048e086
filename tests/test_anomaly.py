"""Anomaly detectors: grid density = brute force, exact quantile = NumPy, planted outliers found."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.anomaly.autoencoder import autoencoder_flags
from riskloom.operators.anomaly.density import density_noise
from riskloom.operators.anomaly.isolation import isolation_flags
from riskloom.operators.anomaly.report import anomaly_overview, anomaly_report
from riskloom.operators.anomaly.scale import exact_quantile, minmax_scale

COLS = ("amount", "balance", "frequency")


@pytest.fixture(scope="module")
def planted(spark):
    """1,000 rows N(50, 5) and 50 rows N(70, 5) in three features; truth = 1 for the 50."""
    normal = spark.range(1000).select("id", *[(F.randn(s) * 5 + 50).alias(c) for s, c in zip((1, 2, 3), COLS)],
                                      F.lit(0).alias("truth"))
    odd = spark.range(1000, 1050).select("id", *[(F.randn(s) * 5 + 70).alias(c) for s, c in zip((4, 5, 6), COLS)],
                                         F.lit(1).alias("truth"))
    return normal.unionByName(odd).coalesce(1).cache()


def brute_noise(X, eps, k):
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= k
    border = (near & core[None, :]).any(1)
    return (~core & ~border).astype(int)


@pytest.mark.parametrize("eps,k", [(0.05, 5), (0.1, 10), (0.2, 4), (0.5, 10)])
def test_density_equals_brute_force(spark, planted, eps, k):
    scaled = minmax_scale(planted, COLS)
    pdf = scaled.select("id", *COLS).orderBy("id").toPandas()
    want = brute_noise(pdf[list(COLS)].to_numpy(), eps, k)
    got = density_noise(scaled, COLS, eps, k).orderBy("id").toPandas()
    assert got["id"].tolist() == pdf["id"].tolist()
    assert got["dbscan_flag"].tolist() == want.tolist()


def test_exact_quantile_matches_numpy(spark, planted):
    pdf = planted.toPandas()
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = exact_quantile(planted, "amount", q, accuracy=50)  # tiny accuracy: forces widening
        assert got == pytest.approx(float(np.percentile(pdf["amount"], q * 100)), rel=1e-12)


def test_minmax_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "id long, a double, b double")
    got = [tuple(r) for r in minmax_scale(df, ("a", "b")).orderBy("id").select("a", "b").collect()]
    assert got == [(0.0, 0.0), (0.0, 1.0)]


def test_isolation_forest_finds_planted(spark, planted):
    flags = isolation_flags(planted, COLS, contamination=0.05).join(planted.select("id", "truth"), "id")
    pdf = flags.toPandas()
    assert pdf["iforest_flag"].sum() == pytest.approx(0.05 * len(pdf), abs=2)
    recall = pdf.loc[pdf.truth == 1, "iforest_flag"].mean()
    assert recall >= 0.8
    again = isolation_flags(planted.repartition(3), COLS, contamination=0.05).toPandas()
    assert sorted(again.loc[again.iforest_flag == 1, "id"]) == sorted(pdf.loc[pdf.iforest_flag == 1, "id"])


def test_autoencoder_flags_rate(spark, planted):
    scaled = minmax_scale(planted, COLS)
    pdf = (autoencoder_flags(scaled, COLS)
           .join(planted.select("id", "truth"), "id").toPandas())
    thr = np.percentile(pdf["ae_error"], 95)
    assert (pdf["ae_flag"] == (pdf["ae_error"] > thr).astype(int)).all()
    assert 0.03 <= pdf["ae_flag"].mean() <= 0.06
    assert pdf.loc[pdf.truth == 1, "ae_flag"].mean() >= 0.7   # planted outliers found


def test_report_and_overview(spark):
    df = spark.createDataFrame([(7, 1234.5, -10.0, 2.5, 1), (8, 1.0, 2.0, 3.5, 0)],
                               "id long, amount double, balance double, frequency double, dbscan_flag int")
    rep = [tuple(r) for r in anomaly_report(df, "density").collect()]
    assert rep == [(7, "1234.50 €", "-10.00 €", 2)]   # half-even: 2.5 -> 2
    ov = anomaly_overview(df).collect()
    assert {(r["method"], r["flag"], r["rows"]) for r in ov} == {("density", 1, 1), ("density", 0, 1)}


def test_forest_large_input_path_deals_rows_to_one_tree(spark, planted):
    from riskloom.operators.anomaly.isolation import fit_forest
    forest = fit_forest(planted, COLS, n_trees=4, max_samples=16)   # 1050 >= 4 * 4 * 16
    roots = forest[forest.node == 0]
    assert sorted(roots.tree) == [0, 1, 2, 3]
    assert (roots["size"] == 16).all()
    assert forest.groupby("tree").node.max().max() < 2 ** 5   # depth <= log2(16)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None)
@given(pts=st.lists(st.tuples(*[st.integers(0, 6)] * 3), min_size=1, max_size=60),
       eps=st.sampled_from([0.1, 0.2, 0.3, 0.5]), k=st.integers(1, 6))
def test_density_exact_distance_ties(spark, pts, eps, k):
    """Grid-aligned points (multiples of 0.1, duplicates allowed) put many pairs at exactly eps."""
    rows = [(i, x / 10, y / 10, z / 10) for i, (x, y, z) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, amount double, balance double, frequency double")
    X = np.array([r[1:] for r in rows])
    want = brute_noise(X, eps, k)
    got = density_noise(df, COLS, eps, k).orderBy("id").toPandas()
    assert got["dbscan_flag"].tolist() == want.tolist()


def test_density_in_seven_dimensions_equals_brute_force(spark):
    import numpy as np

    from riskloom.operators.anomaly.density import density_noise
    rng = np.random.default_rng(11)
    cols = [f"f{i}" for i in range(7)]
    for eps, k in ((0.5, 10), (0.25, 4)):
        pts = np.concatenate([rng.normal(0.3, 0.05, (120, 7)), rng.uniform(0, 1, (80, 7)), np.full((15, 7), 0.9)])
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], ["id", *cols])
        got = {r["id"]: (r["is_core"], r["dbscan_flag"]) for r in density_noise(df, cols, eps, k).collect()}
        near = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)) <= eps
        core = near.sum(1) >= k
        assert got == {i: (bool(core[i]), int(not core[i] and not near[i][core].any())) for i in range(len(pts))}
        assert 0 < sum(f for _, f in got.values()) < len(pts)


def test_autoencoder_weights_do_not_depend_on_partitioning(spark, planted):
    from riskloom.operators.anomaly import autoencoder as AE
    scaled = minmax_scale(planted, COLS)
    w, seen = AE.train(scaled, COLS, epochs=3, batches=2, history=True)
    again, _ = AE.train(scaled.repartition(7), COLS, epochs=3, batches=2)
    assert w.tolist() == again.tolist()
    assert [e for e, _, _ in seen] == [0, 1, 2, 3]
    assert seen[-1][1] < seen[0][1] and seen[-1][2] < seen[0][2]


def test_autoencoder_steps_equal_numpy(spark, planted):
    """The same mini-batches on one machine, with the gradient by central differences, give the same weights."""
    from riskloom.operators.anomaly import autoencoder as AE
    scaled = minmax_scale(planted, COLS)
    parts = scaled.select(*COLS, F.when(F.pmod(F.xxhash64("id", F.lit(42)), F.lit(100)) < 20, -1).otherwise(
        F.pmod(F.xxhash64("id", F.lit(43)), F.lit(2))).alias("part")).toPandas()

    def loss(w, X):
        W1, b1, W2, b2 = AE._unflat(w, 3, 2)
        out = 1 / (1 + np.exp(-(np.maximum(X @ W1 + b1, 0) @ W2 + b2)))
        return ((out - X) ** 2).mean()

    w = AE._flat(AE._init(3, 2, 42))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t, p in enumerate([0, 1, 0, 1], 1):
        X = parts.loc[parts.part == p, list(COLS)].to_numpy()
        g = np.array([(loss(w + e, X) - loss(w - e, X)) / 2e-6 for e in np.eye(len(w)) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.033 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-7)
    got, seen = AE.train(scaled, COLS, epochs=2, batches=2, history=True)
    assert np.allclose(got, w, atol=1e-3)
    assert seen[-1][2] == pytest.approx(loss(got, parts.loc[parts.part == -1, list(COLS)].to_numpy()), abs=1e-8)


def test_detectors_with_nulls_and_repeated_ids(spark):
    rows = [(i % 20, float(i), None if i % 7 == 0 else float(i * i % 13), 1.0) for i in range(40)]
    df = spark.createDataFrame(rows + [(99, float("nan"), 1.0, 1.0)], "id long, amount double, balance double, frequency double")
    got = isolation_flags(df, COLS, n_trees=10, max_samples=8)
    assert got.count() == 41 and got.filter("iforest_score IS NULL OR isnan(iforest_score)").count() == 0
    flags = autoencoder_flags(df, COLS, epochs=1)
    assert flags.count() == 41 and flags.filter("ae_error IS NULL").count() >= 5
