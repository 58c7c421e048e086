"""Registered anomaly queries over per-customer features."""

from __future__ import annotations


from pyspark.sql import functions as F

from riskloom.operators.anomaly import autoencoder as AE
from riskloom.operators.anomaly import density as DN
from riskloom.operators.anomaly import isolation as IF
from riskloom.operators.anomaly import report as R
from riskloom.operators.anomaly.scale import FEATURES, minmax_scale, quantiles_frame
from riskloom.plans.registry import query
from riskloom.sources import testdata as T

# The detectors' parameters.
CONTAMINATION = 0.05
SEED = 42
EPS, MIN_SAMPLES = 0.5, 10
FINE_EPS = 0.1            # a radius at which the driver data does have noise points

_SCALED_SQL = """
    SELECT id, {cols} FROM dd_features""".format(cols=", ".join(
    f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) AS {c}"
    for c in FEATURES))


def _dist_sql(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in FEATURES) + ")"


def _density_sql(eps: float, k: int) -> str:
    return f"""
    WITH s AS ({_SCALED_SQL}),
    nb AS (SELECT a.id, count(*) AS k FROM s a JOIN s b ON {_dist_sql('a', 'b')} <= {eps} GROUP BY a.id),
    c AS (SELECT s.id, coalesce(nb.k, 0) >= {k} AS is_core FROM s LEFT JOIN nb USING (id)),
    border AS (SELECT DISTINCT a.id FROM s a JOIN c ca ON a.id = ca.id AND NOT ca.is_core
               JOIN s b ON {_dist_sql('a', 'b')} <= {eps}
               JOIN c cb ON b.id = cb.id AND cb.is_core)
    SELECT c.id, c.is_core,
           CASE WHEN NOT c.is_core AND border.id IS NULL THEN 1 ELSE 0 END AS dbscan_flag
    FROM c LEFT JOIN border USING (id)"""


def _scaled(spark, d):
    return minmax_scale(T.features(spark, d))


def _forest_sql() -> str:
    """M1 in SQL: samples by key, levels grown by min / max per node, every row walked down every tree."""
    def bits(tag, part):
        return f"('0x' || substr(md5({tag}), {13 * part + 1}, 13))::BIGINT"

    x = [f"x{i}" for i in range(len(FEATURES))]
    row_tag, node_tag = f"concat(id, ':{SEED}')", f"concat(tree, ':', node, ':{SEED}')"
    names = ", ".join(x)
    varying = " + ".join(f"CAST(max(x{i}) > min(x{i}) AS INTEGER)" for i in range(len(x)))
    before = {i: " + ".join(["0"] + [f"CAST(hi{j} > lo{j} AS INTEGER)" for j in range(i)]) for i in range(len(x))}
    pick = "CASE " + " ".join(f"WHEN hi{i} > lo{i} AND {before[i]} = nth THEN {i}" for i in range(len(x))) + " ELSE -1 END"

    def of(prefix, by):
        return f"CASE {by} " + " ".join(f"WHEN {i} THEN {prefix}{i}" for i in range(len(x))) + " END"

    levels, depth_limit = [], 8   # 2^8 = the sample of a tree
    for k in range(depth_limit):
        bounds = ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(len(x)))
        levels.append(f"""
    s{k} AS MATERIALIZED (SELECT *, lo + v * (hi - lo) AS threshold FROM (
        SELECT *, {of("lo", "feature")} AS lo, {of("hi", "feature")} AS hi FROM (
            SELECT *, CASE WHEN {k} < depth_limit THEN {pick} ELSE -1 END AS feature FROM (
                SELECT tree, node, {bounds}, count(*) AS size,
                       floor({bits(node_tag, 0)} / 4503599627370496.0::DOUBLE * ({varying})) AS nth,
                       {bits(node_tag, 1)} / 4503599627370496.0::DOUBLE AS v
                FROM g{k} GROUP BY tree, node)))),
    g{k + 1} AS MATERIALIZED (SELECT g.tree, CASE WHEN s.feature < 0 THEN g.node
                 ELSE 2 * g.node + CASE WHEN {of("g.x", "s.feature")} < s.threshold THEN 1 ELSE 2 END END AS node,
                 {", ".join("g." + c for c in x)} FROM g{k} g JOIN s{k} s ON g.tree = s.tree AND g.node = s.node),""")
    splits = " UNION ".join(f"SELECT tree, node, feature, threshold FROM s{k} WHERE feature >= 0" for k in range(depth_limit))
    walks = []
    for k in range(depth_limit):
        walks.append(f"""
    w{k + 1} AS (SELECT w.id, w.tree, {", ".join("w." + c for c in x)}, w.depth + CASE WHEN s.node IS NULL THEN 0 ELSE 1 END AS depth,
               CASE WHEN s.node IS NULL THEN w.node
               ELSE 2 * w.node + CASE WHEN {of("w.x", "s.feature")} < s.threshold THEN 1 ELSE 2 END END AS node
           FROM w{k} w LEFT JOIN splits s ON w.tree = s.tree AND w.node = s.node),""")
    euler = repr(IF.EULER)

    def c(n):
        return (f"CASE WHEN {n} > 2 THEN 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + {euler}::DOUBLE) "
                f"- 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")

    return f"""
    WITH f AS (SELECT id, {", ".join(f"{c0} AS x{i}" for i, c0 in enumerate(FEATURES))} FROM dd_features),
    keyed AS (SELECT *, {bits(row_tag, 0)} % {IF.KEY_SPACE} AS a, {bits(row_tag, 1)} % {IF.KEY_SPACE} AS b FROM f),
    dealt AS (SELECT id, {names}, t.tree, (a + (t.tree + 1) * b) % {IF.KEY_SPACE} AS k
              FROM keyed, (SELECT unnest(range(100)) AS tree) t),
    chosen AS (SELECT * FROM dealt QUALIFY row_number() OVER (PARTITION BY tree ORDER BY k, id, {names}) <= 256),
    depths AS (SELECT greatest(1, ceil(log2(greatest(2, least(256, count(*)))))) AS depth_limit,
                      least(256, count(*)) AS m FROM f),
    g0 AS MATERIALIZED (SELECT tree, 0::BIGINT AS node, {names} FROM chosen),{"".join(levels).replace("< depth_limit", "< (SELECT depth_limit FROM depths)")}
    splits AS MATERIALIZED ({splits}),
    leaves AS MATERIALIZED (SELECT tree, node, count(*)::DOUBLE AS size FROM g{depth_limit} GROUP BY tree, node),
    w0 AS (SELECT id, tree, {names}, 0 AS depth, 0::BIGINT AS node FROM dealt),{"".join(walks)}
    paths AS MATERIALIZED (SELECT w.id, CAST(sum(CAST(round((w.depth + {c("l.size")}) * 1e9) AS BIGINT)) AS BIGINT) AS path
              FROM w{depth_limit} w JOIN leaves l ON w.tree = l.tree AND w.node = l.node GROUP BY w.id),
    norm AS (SELECT {c("m::DOUBLE")} AS cn FROM depths)
    SELECT id, round(pow(2.0, -path::DOUBLE / (100 * 1e9 * cn)), 9) AS iforest_score,
           CAST(path < (SELECT quantile_cont(path::DOUBLE, {CONTAMINATION}) FROM paths) AS INTEGER) AS iforest_flag
    FROM paths, norm"""


# Fixed weights of the autoencoder (3 inputs, 2 hidden units), so that SQL can repeat the scores.
FIXED_WEIGHTS = (0.5, -0.3, 0.8, 0.6, -0.4, 0.9,  0.1, 0.05,  1.2, -0.7, 0.9, -0.8, 1.1, 0.6,  -0.5, -0.2, -0.6)


def _ae_sql() -> str:
    d, h = len(FEATURES), 2
    w = [f"({v!r}::DOUBLE)" for v in FIXED_WEIGHTS]
    hid = [f"greatest(0.0::DOUBLE, {w[d * h + j]}" + "".join(f" + {c} * {w[i * h + j]}" for i, c in enumerate(FEATURES)) + ")"
           for j in range(h)]
    at = d * h + h
    out = ["1.0::DOUBLE / (1.0::DOUBLE + exp(-(" + w[at + h * d + k]
           + "".join(f" + h{j} * {w[at + j * d + k]}" for j in range(h)) + ")))" for k in range(d)]
    err = " + ".join(f"abs({o} - {c})" for o, c in zip(out, FEATURES))
    return f"""
    WITH s AS ({_SCALED_SQL}),
    a AS (SELECT *, {", ".join(f"{e} AS h{j}" for j, e in enumerate(hid))} FROM s),
    e AS (SELECT id, ({err}) / {d} AS err FROM a)
    SELECT id, round(err, 9) AS ae_error,
           CAST(err > (SELECT quantile_cont(err, 0.95) FROM e) AS INTEGER) AS ae_flag FROM e"""


@query("minmax_scale", _SCALED_SQL, ("dd_features",))
def q_minmax_scale(spark, d):
    return _scaled(spark, d)


@query("p95_threshold", "SELECT " + ", ".join(
    f"round(quantile_cont({c}, 0.95), 6) AS p95_{c}" for c in FEATURES) + " FROM dd_features",
       ("dd_features",))
def p95_threshold(spark, d):
    return quantiles_frame(T.features(spark, d), FEATURES, 0.95)


@query("density_noise", _density_sql(EPS, MIN_SAMPLES), ("dd_features",))
def density_noise(spark, d):
    return DN.density_noise(_scaled(spark, d), FEATURES, EPS, MIN_SAMPLES)


@query("density_noise_fine", _density_sql(FINE_EPS, MIN_SAMPLES), ("dd_features",))
def density_noise_fine(spark, d):
    return DN.density_noise(_scaled(spark, d), FEATURES, FINE_EPS, MIN_SAMPLES)


@query("iforest_flags", _forest_sql(), ("dd_features",))
def iforest_flags(spark, d):
    """M1 on raw (unscaled) features, as the reference fits it."""
    return (IF.isolation_flags(T.features(spark, d), FEATURES, CONTAMINATION, seed=SEED)
            .select("id", F.round("iforest_score", 9).alias("iforest_score"), "iforest_flag"))


@query("ae_flags")
def ae_flags(spark, d):
    """M3 + M4 on min-max scaled features."""
    return AE.autoencoder_flags(_scaled(spark, d), FEATURES, seed=SEED)


@query("ae_training")
def ae_training(spark, d):
    """M3: loss on the learned and on the held-out rows after every epoch."""
    return AE.training_history(_scaled(spark, d), FEATURES, seed=SEED)


@query("ae_flags_fixed", _ae_sql(), ("dd_features",))
def ae_flags_fixed(spark, d):
    """P19 + M4 with weights handed in."""
    return (AE.autoencoder_flags(_scaled(spark, d), FEATURES, weights=FIXED_WEIGHTS)
            .select("id", F.round("ae_error", 9).alias("ae_error"), "ae_flag"))


@query("anomaly_report", """
    SELECT f.id AS index, printf('%.2f €', f.amount) AS transaction_amount,
           printf('%.2f €', f.balance) AS account_balance,
           CAST(round_even(f.frequency, 0) AS BIGINT) AS transaction_frequency
    FROM dd_features f JOIN ({dn}) n ON f.id = n.id WHERE n.dbscan_flag = 1""".format(
    dn=_density_sql(FINE_EPS, MIN_SAMPLES)), ("dd_features",))
def anomaly_report(spark, d):
    """M6 for the density method: flagged customers with their raw features formatted."""
    flags = DN.density_noise(_scaled(spark, d), FEATURES, FINE_EPS, MIN_SAMPLES)
    return R.anomaly_report(T.features(spark, d).join(flags, "id"), "density")


def _overview(spark, d, weights=None):
    raw = T.features(spark, d)
    scaled = minmax_scale(raw)
    flags = (IF.isolation_flags(raw, FEATURES, CONTAMINATION, seed=SEED).select("id", "iforest_flag")
             .join(AE.autoencoder_flags(scaled, FEATURES, weights=weights, seed=SEED).select("id", "ae_flag"), "id")
             .join(DN.density_noise(scaled, FEATURES, EPS, MIN_SAMPLES).select("id", "dbscan_flag"), "id"))
    return R.anomaly_overview(raw.join(flags, "id"))


@query("anomaly_overview")
def anomaly_overview(spark, d):
    """M7: all three detectors side by side, summarised per flag value."""
    return _overview(spark, d)


@query("anomaly_overview_fixed", "WITH i AS ({i}), a AS ({a}), n AS ({n})".format(
    i=_forest_sql(), a=_ae_sql(), n=_density_sql(EPS, MIN_SAMPLES)) + " UNION ALL ".join(
    f"""
    SELECT '{method}' AS method, {flag} AS flag, count(*) AS rows, {", ".join(
        f"round(min({c}), 6) AS min_{c}, round(avg({c}), 6) AS avg_{c}, round(max({c}), 6) AS max_{c}" for c in FEATURES)}
    FROM dd_features JOIN {t} USING (id) GROUP BY {flag}"""
    for method, flag, t in (("isolation", "iforest_flag", "i"), ("autoencoder", "ae_flag", "a"),
                            ("density", "dbscan_flag", "n"))), ("dd_features",))
def anomaly_overview_fixed(spark, d):
    """M7 with the autoencoder's weights handed in."""
    return _overview(spark, d, FIXED_WEIGHTS)
