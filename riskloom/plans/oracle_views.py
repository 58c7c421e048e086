"""DuckDB SQL for the domain tables of ``riskloom.sources.testdata``.

Written independently of the Spark code so the oracle check compares two
implementations. ``with_views(sql, names)`` prefixes a query with the CTEs it
needs (dependencies resolved).
"""

from __future__ import annotations

AS_OF_SQL = "DATE '2001-08-01'"

_STATUS = """CASE c.c_mktsegment WHEN 'FURNITURE' THEN 'dissolved'
             WHEN 'MACHINERY' THEN 'voluntary-arrangement'
             WHEN 'HOUSEHOLD' THEN 'open' ELSE 'active' END"""
_OVERDUE = """CASE WHEN c.c_acctbal < 0 THEN TRUE WHEN c.c_acctbal < 100 THEN NULL
             ELSE FALSE END"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "dd_company": (f"""
        SELECT c.c_custkey AS company_number, c.c_name AS company_name,
               {_STATUS} AS company_status, n.n_name AS country,
               {_OVERDUE} AS accounts_overdue
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""", ()),
    "dd_kyc": ("""
        SELECT o_orderkey AS id, o_custkey AS company_number,
               CASE WHEN floor(o_totalprice/5000) >= 85 THEN 'CRITICAL'
                    WHEN floor(o_totalprice/5000) >= 60 THEN 'HIGH'
                    WHEN floor(o_totalprice/5000) >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
               CAST(floor(o_totalprice/5000) AS INTEGER) AS risk_score,
               CASE o_orderpriority WHEN '1-URGENT' THEN TRUE
                    WHEN '4-NOT SPECIFIED' THEN NULL ELSE FALSE END AS leak_hit,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'in-review'
                    ELSE 'pending' END AS status
        FROM orders""", ()),
    "dd_txn": ("""
        SELECT o_custkey AS company_id,
               CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
               CAST(o_orderdate AS DATE) AS transaction_date,
               l_returnflag AS transaction_type, s_name AS sender_account,
               'ACCT-' || CAST(l_partkey AS VARCHAR) AS recipient_account,
               l_extendedprice AS transaction_amount,
               round(l_discount * 10, 2) AS financial_risk
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN supplier ON l_suppkey = s_suppkey""", ()),
    "dd_risk": ("""
        SELECT o_custkey AS company_id, CAST(o_orderdate AS DATE) AS transaction_date,
               o_totalprice / 500000 AS risk_score
        FROM orders""", ()),
    "dd_officer": ("""
        SELECT company_number, pos, name,
               CASE flag WHEN 'A' THEN 'director' WHEN 'N' THEN 'secretary'
                    ELSE 'llp-designated-member' END AS officer_role,
               CAST(first_date AS VARCHAR) AS appointed_on,
               CASE WHEN min_ls = 'F' THEN CAST(last_ship AS VARCHAR) END AS resigned_on,
               nationality, country_of_residence
        FROM dd_party1""", ("dd_party1",)),
    "dd_psc": ("""
        SELECT company_number, pos, name, nationality, country_of_residence,
               CASE WHEN s_acctbal > 9000 THEN ['ownership-of-shares-75-to-100-percent']
                    WHEN s_acctbal < 1000 THEN ['ownership-of-shares-25-to-50-percent',
                                                'significant-influence-or-control']
                    ELSE ['voting-rights-25-to-50-percent'] END AS natures_of_control,
               CAST(month(first_date) AS INTEGER) AS dob_month,
               CAST(year(first_date) - 45 AS INTEGER) AS dob_year
        FROM dd_party2""", ("dd_party2",)),
    "dd_filing": ("""
        SELECT o_custkey AS company_number, o_orderkey AS pos,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
               o_orderpriority AS type, 'order ' || CAST(o_orderkey AS VARCHAR) AS description,
               lower(substring(o_orderpriority, 3, 100)) AS category
        FROM orders""", ()),
    "dd_leaked": ("""
        SELECT '  ' || upper(s_name) || ' ' AS name FROM supplier WHERE s_acctbal < 0""", ()),
    "dd_profile": (f"""
        SELECT c.c_custkey AS company_number, c.c_name AS company_name,
               {_STATUS} AS company_status,
               CASE WHEN c.c_acctbal BETWEEN 0 AND 100 THEN 'not-a-date'
                    ELSE CAST(CAST({AS_OF_SQL} - CAST(CAST(floor(abs(c.c_acctbal) * 7) AS INTEGER) % 3650 AS INTEGER) AS DATE) AS VARCHAR)
               END AS date_of_creation,
               'ltd' AS type, 'england-wales' AS jurisdiction,
               CAST(10000 + c.c_nationkey * 100 AS VARCHAR) AS sic_code,
               c.c_name || ' House' AS address_line_1, '' AS address_line_2,
               'City ' || CAST(c.c_nationkey AS VARCHAR) AS locality,
               'PC' || CAST(c.c_custkey AS VARCHAR) AS postal_code,
               n.n_name AS address_country,
               {_OVERDUE} AS accounts_overdue,
               CAST(CAST({AS_OF_SQL} + 30 AS DATE) AS VARCHAR) AS accounts_next_due
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""", ()),
    "dd_post": ("""
        SELECT doc_id AS post_id, source AS platform, text AS post_content FROM documents""", ()),
    "dd_names": ("""
        SELECT item_id AS company_id, text AS company_name FROM benchmark""", ()),
    "dd_features": ("""
        SELECT c.c_custkey AS id, CAST(a.amount AS DOUBLE) AS amount, c.c_acctbal AS balance,
               CAST(a.frequency AS DOUBLE) AS frequency
        FROM customer c JOIN (
            SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount,
                   count(*) AS frequency
            FROM orders GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey""", ()),
}

for _kind, _lines in (("1", "l_quantity < 25"), ("2", "l_quantity >= 25")):
    VIEWS[f"dd_party{_kind}"] = (f"""
        SELECT o_custkey AS company_number, s_suppkey, s_name AS name, s_acctbal,
               sn.n_name AS nationality, cn.n_name AS country_of_residence,
               min(o_orderkey) AS pos, min(CAST(o_orderdate AS DATE)) AS first_date,
               min(l_returnflag) AS flag, min(l_linestatus) AS min_ls,
               max(CAST(l_shipdate AS DATE)) AS last_ship
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN supplier ON l_suppkey = s_suppkey
             JOIN customer ON o_custkey = c_custkey
             JOIN nation sn ON s_nationkey = sn.n_nationkey
             JOIN nation cn ON c_nationkey = cn.n_nationkey
        WHERE {_lines}
        GROUP BY o_custkey, s_suppkey, s_name, s_acctbal, sn.n_name, cn.n_name""", ())


def with_views(sql: str, names: tuple[str, ...] | list[str]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][0]}\n)" for n in order)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        # merge the query's own CTEs into one WITH list
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"
