"""Command line for the batch jobs over landed files.

    python -m riskloom.cli due-diligence --profiles P --officers O --pscs S --filings F \\
        --leaked L1 [L2 ...] --out DIR [--as-of YYYY-MM-DD]
    python -m riskloom.cli portfolio --companies C --kyc K --out DIR

Portfolio inputs are Parquet folders, or header CSV files when the path ends
in ``.csv`` (columns as in ``sources/files.py`` / ``streaming/kyc_refresh.py``).

Profiles are JSON lines (one company each); officers, PSCs and filings are
JSON lines ``{"company_number": ..., "items": [...]}`` (pages of any size);
leaked-name files are CSVs with an ``n.name`` column (unreadable ones are
skipped with a warning). Results are Parquet folders under ``--out``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from pyspark.sql import types as T

from riskloom.jobs import due_diligence_job, portfolio_reports_job
from riskloom.sources import files as S
from riskloom.streaming.kyc_refresh import KYC_SCHEMA

COMPANIES_DB = T.StructType([
    T.StructField("company_number", T.StringType()), T.StructField("company_name", T.StringType()),
    T.StructField("company_status", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("accounts_overdue", T.BooleanType()),
])
# company numbers are text: prefixes (SC, NI) and leading zeros belong to them
KYC_DB = KYC_SCHEMA


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskloom")
    sub = p.add_subparsers(dest="cmd", required=True)
    dd = sub.add_parser("due-diligence", help="flags, scores, leak hits and the ownership graph")
    for name in ("profiles", "officers", "pscs", "filings", "out"):
        dd.add_argument(f"--{name}", required=True)
    dd.add_argument("--leaked", nargs="+", default=[])
    dd.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today())
    pf = sub.add_parser("portfolio", help="latest review per company and the portfolio reports")
    for name in ("companies", "kyc", "out"):
        pf.add_argument(f"--{name}", required=True)
    return p


def _table(spark: SparkSession, path: str, schema):
    if path.endswith(".csv"):
        return S.read_csv(spark, path, schema)
    return spark.read.parquet(path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("riskloom").getOrCreate()
    if args.cmd == "portfolio":
        out = portfolio_reports_job(spark, _table(spark, args.companies, COMPANIES_DB),
                                    _table(spark, args.kyc, KYC_DB), args.out)
        print(json.dumps(out))
        return out
    profiles = spark.read.schema(S.PROFILE_JSON).json(args.profiles)
    officers = S.explode_items(S.read_nested(spark, args.officers, S.OFFICER_ITEM))
    pscs = S.explode_items(S.read_nested(spark, args.pscs, S.PSC_ITEM))
    filings = S.explode_items(S.read_nested(spark, args.filings, S.FILING_ITEM))
    leaked = S.read_name_column(spark, args.leaked)
    out = due_diligence_job(spark, profiles, officers, pscs, filings, leaked, args.out, args.as_of)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
