"""Registered screening, scoring, detail-view and network queries (J3, J5, J7, K*, N*, P7-P13, S4, S6, U1-U3, W4-W6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.functions.jurisdiction import jurisdiction_risk
from riskloom.operators import network as N
from riskloom.operators import scoring as K
from riskloom.operators import screening as J
from riskloom.operators import views as V
from riskloom.plans.portfolio_queries import TEST_LISTS, test_label_sql, test_severity_sql
from riskloom.plans.registry import query
from riskloom.session import ensure_checkpoint_dir
from riskloom.sources import files as S
from riskloom.sources import testdata as T

AS_OF = T.AS_OF
_ASOF = "DATE '2001-08-01'"

_LEAK = "SELECT DISTINCT lower(trim(name)) AS name_key FROM dd_leaked WHERE trim(name) <> ''"
_PARTIES = """SELECT company_number, 'officer' AS party_type, 0 AS party_order, pos, name FROM dd_officer
              UNION ALL
              SELECT company_number, 'psc', 1, pos, name FROM dd_psc"""


def _flags_sql() -> str:
    lab, sev = test_label_sql, test_severity_sql
    country = "coalesce(address_country, '')"
    return f"""
    WITH leak AS ({_LEAK}),
    parties AS ({_PARTIES}),
    hits AS (SELECT p.*, row_number() OVER (PARTITION BY p.company_number ORDER BY p.party_type, p.pos, p.name) AS r
             FROM parties p JOIN leak l ON lower(trim(p.name)) = l.name_key),
    hitagg AS (SELECT company_number, count(*) AS n_hits,
                      string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 100) AS hit_names FROM hits GROUP BY 1),
    pscagg AS (SELECT company_number, count(*) AS n_psc,
                      count(*) FILTER (WHERE len(list_filter(natures_of_control,
                                        lambda x: contains(x, '75-to-100-percent'))) > 0) AS n_high
               FROM dd_psc GROUP BY 1),
    filagg AS (SELECT company_number, count(*) AS n_filings,
                      TRY_CAST(arg_min(date, pos) AS DATE) AS newest FROM dd_filing GROUP BY 1),
    base AS (SELECT p.*, coalesce(ps.n_psc, 0) AS n_psc, coalesce(ps.n_high, 0) AS n_high,
                    coalesce(f.n_filings, 0) AS n_filings, f.newest, coalesce(h.n_hits, 0) AS n_hits, h.hit_names,
                    lower(coalesce(p.company_status, '')) AS st,
                    TRY_CAST(p.date_of_creation AS DATE) AS created,
                    {lab(country)} AS jl, {sev(country)} AS js
             FROM dd_profile p LEFT JOIN pscagg ps USING (company_number)
                  LEFT JOIN filagg f USING (company_number) LEFT JOIN hitagg h USING (company_number)),
    offs AS (SELECT *, {lab('nationality')} AS l1, {sev('nationality')} AS s1,
                       {lab('country_of_residence')} AS l2, {sev('country_of_residence')} AS s2
             FROM dd_officer),
    pscs AS (SELECT *, {lab('nationality')} AS l1, {sev('nationality')} AS s1,
                       {lab('country_of_residence')} AS l2, {sev('country_of_residence')} AS s2
             FROM dd_psc)
    SELECT company_number, 'K1' AS rule, 1 AS rule_order, CAST(0 AS BIGINT) AS pos,
           'Company status: ' || upper(left(st, 1)) || substr(st, 2) AS flag,
           'High' AS severity, 'Company Status' AS category, 25 AS points
    FROM base WHERE st IN ('dissolved', 'liquidation', 'receivership', 'administration')
    UNION ALL
    SELECT company_number, 'K2', 1, 0, 'Non-standard status: ' || st, 'Medium', 'Company Status', 10
    FROM base WHERE st NOT IN ('dissolved', 'liquidation', 'receivership', 'administration', 'active', 'open')
    UNION ALL
    SELECT company_number, 'K3', 2, 0, 'Registered address in ' || jl || ': ' || {country}, js,
           'Jurisdiction — Registered Address', CASE WHEN js = 'Critical' THEN 30 ELSE 20 END
    FROM base WHERE jl IS NOT NULL
    UNION ALL
    SELECT company_number, 'K4', 3, pos,
           'Officer ' || coalesce(name, '') || ' — '
             || CASE WHEN l1 IS NOT NULL THEN 'Nationality: ' || nationality || ' (' || l1 || ')'
                     ELSE 'Country Of Residence: ' || country_of_residence || ' (' || l2 || ')' END,
           coalesce(s1, s2), 'Jurisdiction — Officer',
           CASE WHEN coalesce(s1, s2) = 'Critical' THEN 20 ELSE 10 END
    FROM offs WHERE l1 IS NOT NULL OR l2 IS NOT NULL
    UNION ALL
    SELECT company_number, 'K5', 4, pos,
           'PSC ' || coalesce(name, 'Unknown PSC') || ' — '
             || CASE WHEN l1 IS NOT NULL THEN 'Nationality: ' || nationality || ' (' || l1 || ')'
                     ELSE 'Country Of Residence: ' || country_of_residence || ' (' || l2 || ')' END,
           coalesce(s1, s2), 'Jurisdiction — PSC',
           CASE WHEN coalesce(s1, s2) = 'Critical' THEN 20 ELSE 10 END
    FROM pscs WHERE l1 IS NOT NULL OR l2 IS NOT NULL
    UNION ALL
    SELECT company_number, 'K6', 5, 0,
           'No Persons with Significant Control registered — ownership opaque', 'High',
           'Ownership Structure', 20
    FROM base WHERE n_psc = 0
    UNION ALL
    SELECT company_number, 'K7', 6, 0,
           CAST(n_high AS VARCHAR) || ' PSCs each claiming 75–100% control — unusual structure',
           'High', 'Ownership Structure', 15
    FROM base WHERE n_high > 1
    UNION ALL
    SELECT company_number, 'K8', 7, 0,
           'Newly incorporated — ' || CAST(datediff('day', created, {_ASOF}) AS VARCHAR) || ' days old',
           'Medium', 'Company Age', 10
    FROM base WHERE created IS NOT NULL AND datediff('day', created, {_ASOF}) < 180
    UNION ALL
    SELECT company_number, 'K9', 8, 0, 'Annual accounts overdue', 'Medium', 'Filing Compliance', 10
    FROM base WHERE coalesce(accounts_overdue, FALSE)
    UNION ALL
    SELECT company_number, 'K10', 9, 0, 'No filing history found', 'Medium', 'Filing Compliance', 10
    FROM base WHERE n_filings = 0
    UNION ALL
    SELECT company_number, 'K11', 9, 0,
           'No filings in ' || CAST(CAST(floor(datediff('day', newest, {_ASOF}) / 30.0) AS BIGINT) AS VARCHAR)
             || ' months', 'Medium', 'Filing Compliance', 10
    FROM base WHERE n_filings > 0 AND newest IS NOT NULL AND datediff('day', newest, {_ASOF}) / 30.0 > 18
    UNION ALL
    SELECT company_number, 'K12', 10, 0,
           CAST(n_hits AS VARCHAR) || ' name(s) matched in Panama Papers leak: ' || hit_names, 'Critical',
           'Panama Papers', 30
    FROM base WHERE n_hits > 0"""


def _title_sql(x: str) -> str:
    """Capitalise every word split on spaces and hyphens, lower-case the rest (DuckDB)."""
    inner = "list_aggr(list_transform(string_split(w, '-'), lambda v: upper(left(v, 1)) || substr(v, 2)), 'string_agg', '-')"
    return f"list_aggr(list_transform(string_split(lower({x}), ' '), lambda w: {inner}), 'string_agg', ' ')"


_FLAG_VIEWS = ("dd_profile", "dd_officer", "dd_psc", "dd_filing", "dd_leaked")


def _flags(spark, d):
    return K.risk_flags(T.profiles(spark, d), T.officers(spark, d), T.pscs(spark, d),
                        T.filings(spark, d), T.leaked_names(spark, d), AS_OF, TEST_LISTS)


def _scores(spark, d):
    return K.risk_scores(T.profiles(spark, d), _flags(spark, d))


@query("risk_flags", f"SELECT * FROM ({_flags_sql()})", _FLAG_VIEWS)
def risk_flags(spark, d):
    return _flags(spark, d)


_SCORE_SQL = f"""
    SELECT p.company_number, CAST(least(coalesce(a.pts, 0), 100) AS INTEGER) AS score,
           CASE WHEN least(coalesce(a.pts, 0), 100) >= 85 THEN 'CRITICAL'
                WHEN least(coalesce(a.pts, 0), 100) >= 60 THEN 'HIGH'
                WHEN least(coalesce(a.pts, 0), 100) >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
           CAST(coalesce(a.n, 0) AS BIGINT) AS n_flags, CAST(coalesce(a.nc, 0) AS BIGINT) AS n_critical
    FROM dd_profile p LEFT JOIN (
        SELECT company_number, sum(points) AS pts, count(*) AS n,
               count(*) FILTER (WHERE severity = 'Critical') AS nc
        FROM ({_flags_sql()}) GROUP BY 1) a USING (company_number)"""


@query("risk_score", f"""
    SELECT company_number, score, tier,
           CASE WHEN tier IN ('CRITICAL', 'HIGH') THEN 'danger' WHEN tier = 'MEDIUM' THEN 'warning'
                ELSE 'success' END AS color, n_flags, n_critical
    FROM ({_SCORE_SQL})""", _FLAG_VIEWS)
def risk_score(spark, d):
    return _scores(spark, d)


@query("risk_tier", f"""
    SELECT tier, CAST(count(*) AS BIGINT) AS companies, CAST(min(score) AS INTEGER) AS min_score,
           CAST(max(score) AS INTEGER) AS max_score
    FROM ({_SCORE_SQL}) GROUP BY tier""", _FLAG_VIEWS)
def risk_tier(spark, d):
    return (_scores(spark, d).groupBy("tier")
            .agg(F.count(F.lit(1)).cast("bigint").alias("companies"),
                 F.min("score").cast("int").alias("min_score"),
                 F.max("score").cast("int").alias("max_score")))


@query("risk_flags_sorted", f"""
    SELECT company_number,
           CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2
                WHEN 'Low' THEN 3 ELSE 99 END AS severity_rank,
           rule_order, pos, category, flag, severity
    FROM ({_flags_sql()})""", _FLAG_VIEWS)
def risk_flags_sorted(spark, d):
    return K.sorted_flags(_flags(spark, d))


@query("jurisdiction_screen", f"""
    SELECT company_number, country, {test_label_sql('country')} AS risk_label,
           {test_severity_sql('country')} AS severity
    FROM dd_company""", ("dd_company",))
def jurisdiction_screen(spark, d):
    r = jurisdiction_risk(F.col("country"), TEST_LISTS)
    return T.companies(spark, d).select("company_number", "country", r.label.alias("risk_label"),
                                        r.severity.alias("severity"))


@query("leak_name_index", f"SELECT * FROM ({_LEAK})", ("dd_leaked",))
def leak_name_index(spark, d):
    return S.leak_name_index(T.leaked_names(spark, d))


@query("screened_parties", f"""
    SELECT company_number, party_type, party_order, pos, name, lower(trim(name)) AS name_key
    FROM ({_PARTIES})""", ("dd_officer", "dd_psc"))
def screened_parties(spark, d):
    return J.screened_parties(T.officers(spark, d), T.pscs(spark, d))


@query("name_screen", f"""
    SELECT p.company_number, p.party_type, p.pos, p.name, (l.name_key IS NOT NULL) AS leak_hit
    FROM ({_PARTIES}) p LEFT JOIN ({_LEAK}) l ON lower(trim(p.name)) = l.name_key""",
       ("dd_officer", "dd_psc", "dd_leaked"))
def name_screen(spark, d):
    p = J.screened_parties(T.officers(spark, d), T.pscs(spark, d))
    return (J.flag_hits(p, T.leaked_names(spark, d))
            .select("company_number", "party_type", "pos", "name", "leak_hit"))


@query("name_screen_hits", f"""
    SELECT company_number, party_type, pos, name FROM ({_PARTIES}) p
    WHERE lower(trim(name)) IN ({_LEAK})""", ("dd_officer", "dd_psc", "dd_leaked"))
def name_screen_hits(spark, d):
    p = J.screened_parties(T.officers(spark, d), T.pscs(spark, d))
    return J.hits_only(p, T.leaked_names(spark, d)).select("company_number", "party_type", "pos", "name")


@query("name_screen_clear", f"""
    SELECT company_number, party_type, pos, name FROM ({_PARTIES}) p
    WHERE NOT EXISTS (SELECT 1 FROM ({_LEAK}) l WHERE l.name_key = lower(trim(p.name)))""",
       ("dd_officer", "dd_psc", "dd_leaked"))
def name_screen_clear(spark, d):
    p = J.screened_parties(T.officers(spark, d), T.pscs(spark, d))
    return J.clear_only(p, T.leaked_names(spark, d)).select("company_number", "party_type", "pos", "name")


@query("profile_view", f"""
    SELECT company_number, company_name,
           {_title_sql("replace(coalesce(company_status, 'N/A'), '_', ' ')")} AS status,
           CASE WHEN lower(company_status) = 'active' THEN 'success' ELSE 'danger' END AS status_class,
           coalesce(date_of_creation, 'N/A') AS incorporated, coalesce(type, 'N/A') AS company_type,
           coalesce(jurisdiction, 'N/A') AS jurisdiction, coalesce(nullif(sic_code, ''), 'N/A') AS sic_codes,
           coalesce(nullif(concat_ws(', ', nullif(address_line_1, ''), nullif(address_line_2, ''),
                    nullif(locality, ''), nullif(postal_code, ''), nullif(address_country, '')), ''), 'N/A')
             AS registered_address,
           {test_label_sql('address_country')} AS address_risk,
           coalesce(accounts_next_due, 'N/A') AS accounts_due,
           CASE WHEN coalesce(accounts_overdue, FALSE) THEN 'YES' ELSE 'No' END AS accounts_overdue
    FROM dd_profile""", ("dd_profile",))
def profile_view(spark, d):
    return V.profile_view(T.profiles(spark, d), TEST_LISTS)




@query("officer_view", f"""
    SELECT o.company_number, o.pos, coalesce(o.name, 'N/A') AS name,
           {_title_sql("replace(coalesce(o.officer_role, 'N/A'), '-', ' ')")} AS role,
           coalesce(o.appointed_on, 'N/A') AS appointed,
           CASE WHEN o.resigned_on IS NOT NULL AND o.resigned_on <> '' THEN 'Resigned' ELSE 'Active' END
             AS status,
           coalesce(o.nationality, 'N/A') AS nationality,
           coalesce(o.country_of_residence, 'N/A') AS country_of_residence,
           coalesce({test_label_sql("coalesce(o.nationality, 'N/A')")},
                    {test_label_sql("coalesce(o.country_of_residence, 'N/A')")}, 'Clear') AS jurisdiction_flag,
           CASE WHEN l.name_key IS NOT NULL THEN 'YES' ELSE 'No' END AS leak_hit
    FROM dd_officer o LEFT JOIN ({_LEAK}) l ON lower(trim(o.name)) = l.name_key""",
       ("dd_officer", "dd_leaked"))
def officer_view(spark, d):
    return V.officer_view(T.officers(spark, d), T.leaked_names(spark, d), TEST_LISTS)


@query("psc_view", f"""
    SELECT p.company_number, p.pos, coalesce(p.name, 'N/A') AS name,
           array_to_string(p.natures_of_control, ', ') AS natures_of_control,
           coalesce(p.country_of_residence, p.nationality, 'N/A') AS country,
           CAST(p.dob_month AS VARCHAR) || '/' || CAST(p.dob_year AS VARCHAR) AS date_of_birth,
           {test_label_sql("coalesce(p.country_of_residence, p.nationality, 'N/A')")} AS jurisdiction_flag,
           CASE WHEN l.name_key IS NOT NULL THEN 'YES' ELSE 'No' END AS leak_hit
    FROM dd_psc p LEFT JOIN ({_LEAK}) l ON lower(trim(p.name)) = l.name_key""",
       ("dd_psc", "dd_leaked"))
def psc_view(spark, d):
    return V.psc_view(T.pscs(spark, d), T.leaked_names(spark, d), TEST_LISTS)


@query("party_counts", f"""
    SELECT p.company_number,
           CAST(coalesce(o.n, 0) AS BIGINT) AS n_officers, CAST(coalesce(s.n, 0) AS BIGINT) AS n_pscs,
           CAST(coalesce(f.n, 0) AS BIGINT) AS n_filings, CAST(coalesce(h.n, 0) AS BIGINT) AS n_leak_hits
    FROM dd_profile p
    LEFT JOIN (SELECT company_number, count(*) AS n FROM dd_officer GROUP BY 1) o USING (company_number)
    LEFT JOIN (SELECT company_number, count(*) AS n FROM dd_psc GROUP BY 1) s USING (company_number)
    LEFT JOIN (SELECT company_number, count(*) AS n FROM dd_filing GROUP BY 1) f USING (company_number)
    LEFT JOIN (SELECT x.company_number, count(*) AS n FROM ({_PARTIES}) x
               JOIN ({_LEAK}) l ON lower(trim(x.name)) = l.name_key GROUP BY 1) h USING (company_number)""",
       ("dd_profile", "dd_officer", "dd_psc", "dd_filing", "dd_leaked"))
def party_counts(spark, d):
    return V.party_counts(T.profiles(spark, d), T.officers(spark, d), T.pscs(spark, d),
                          T.filings(spark, d), T.leaked_names(spark, d))


@query("filings_top15", """
    SELECT company_number, CAST(rank AS INTEGER) AS rank, date, type, description, category FROM (
      SELECT *, row_number() OVER (PARTITION BY company_number ORDER BY pos NULLS LAST, date DESC NULLS LAST) AS rank
      FROM dd_filing) WHERE rank <= 15""", ("dd_filing",))
def filings_top15(spark, d):
    return V.filings_top(T.filings(spark, d), 15)


@query("ownership_edges", f"""
    SELECT * FROM (WITH e AS (SELECT DISTINCT company_number, coalesce(name, 'Unknown') AS party FROM dd_officer
               UNION SELECT DISTINCT company_number, coalesce(name, 'Unknown PSC') FROM dd_psc)
    SELECT e.company_number, p.company_name AS source, e.party AS target
    FROM e JOIN dd_profile p USING (company_number)
    WHERE e.company_number IN (SELECT e2.company_number FROM e e2 JOIN dd_profile p2 USING (company_number)
                               WHERE e2.party <> p2.company_name))""", ("dd_profile", "dd_officer", "dd_psc"))
def ownership_edges(spark, d):
    return N.ownership_edges(T.profiles(spark, d), T.officers(spark, d), T.pscs(spark, d))


_NODES_SQL = f"""
    WITH leak AS ({_LEAK}),
    hits AS (SELECT DISTINCT p.company_number, lower(trim(p.name)) AS name_key
             FROM ({_PARTIES}) p JOIN leak l ON lower(trim(p.name)) = l.name_key),
    rows_ AS (
      SELECT pr.company_number, pr.company_name AS name, 0 AS ord, CAST(0 AS BIGINT) AS pos,
             'company' AS node_type, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS noc,
             h.name_key IS NOT NULL AS leak_hit
      FROM dd_profile pr LEFT JOIN hits h
        ON h.company_number = pr.company_number AND h.name_key = lower(pr.company_name)
      UNION ALL
      SELECT o.company_number, coalesce(o.name, 'Unknown'), 1, o.pos, 'officer',
             coalesce(o.officer_role, ''), NULL, l.name_key IS NOT NULL
      FROM dd_officer o LEFT JOIN leak l ON lower(trim(coalesce(o.name, 'Unknown'))) = l.name_key
      UNION ALL
      SELECT p.company_number, coalesce(p.name, 'Unknown PSC'), 2, p.pos, 'psc', NULL,
             array_to_string(coalesce(p.natures_of_control, []), ', '), l.name_key IS NOT NULL
      FROM dd_psc p LEFT JOIN leak l ON lower(trim(coalesce(p.name, 'Unknown PSC'))) = l.name_key),
    nodes AS (
      SELECT company_number, name,
             arg_max(node_type, ord * 1000000000000 + pos) AS node_type,
             arg_max(role, ord * 1000000000000 + pos) FILTER (WHERE role IS NOT NULL) AS role,
             arg_max(noc, ord * 1000000000000 + pos) FILTER (WHERE noc IS NOT NULL) AS noc,
             arg_max(leak_hit, ord * 1000000000000 + pos) AS leak_hit
      FROM rows_ GROUP BY company_number, name),
    big AS (SELECT company_number FROM nodes GROUP BY company_number HAVING count(*) >= 2)
    SELECT company_number, name, node_type, role, noc, leak_hit,
           CASE WHEN leak_hit THEN 'leak' WHEN node_type = 'company' THEN 'company'
                WHEN node_type = 'officer' THEN 'officer' ELSE 'psc' END AS node_class,
           CASE WHEN node_type = 'company' THEN 24 WHEN leak_hit THEN 20 ELSE 16 END AS node_size,
           CASE WHEN node_type = 'company' THEN 'square' WHEN leak_hit THEN 'star' ELSE 'circle' END AS symbol,
           name || ' | Type: ' || node_type
             || CASE WHEN role <> '' THEN ' | Role: ' || role ELSE '' END
             || CASE WHEN noc <> '' THEN ' | Control: ' || noc ELSE '' END
             || CASE WHEN leak_hit THEN ' | LEAK HIT' ELSE '' END AS label
    FROM nodes WHERE company_number IN (SELECT company_number FROM big)"""


@query("ownership_nodes", _NODES_SQL, ("dd_profile", "dd_officer", "dd_psc", "dd_leaked"))
def ownership_nodes(spark, d):
    return N.ownership_nodes(T.profiles(spark, d), T.officers(spark, d), T.pscs(spark, d),
                             T.leaked_names(spark, d))


@query("nested_company_docs", """
    SELECT company_number, name, officer_role, appointed_on, resigned_on, nationality,
           country_of_residence FROM dd_officer""", ("dd_officer",))
def nested_company_docs(spark, d):
    """Officers landed as nested JSON pages (<= 50 positions per page), read back flat."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landed/{uuid.uuid4().hex}/officers"
    o = T.officers(spark, d)
    item_cols = [f.name for f in S.OFFICER_ITEM.fields]
    pages = (o.groupBy(F.col("company_number").cast("string").alias("company_number"),
                       F.floor(F.col("pos") / 50).alias("page"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", *item_cols))).alias("items"))
             .select("company_number",
                     F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in item_cols]))
                     .alias("items")))
    pages.write.mode("overwrite").json(base)
    flat = S.explode_items(S.read_nested(spark, base, S.OFFICER_ITEM))
    return flat.select(F.col("company_number").cast("bigint").alias("company_number"), *item_cols)
