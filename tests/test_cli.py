"""The command line runs the due-diligence job on landed JSON and CSV files."""

from __future__ import annotations

import json
import os
import tempfile

from riskloom.cli import main


def test_due_diligence_from_landed_files(spark):
    d = tempfile.mkdtemp(prefix="riskloom-cli-", dir="/tmp")

    def write(name, rows):
        with open(os.path.join(d, name), "w") as f:
            for r in rows:
                f.write(json.dumps(r) + "\n")

    write("profiles.json", [
        {"company_number": "001", "company_name": "Acme", "company_status": "active",
         "date_of_creation": "2010-01-01", "registered_office_address": {"country": "Iran"},
         "accounts": {"overdue": True}},
        {"company_number": "002", "company_name": "Beta", "company_status": "dissolved"},
    ])
    write("officers.json", [{"company_number": "001", "items": [
        {"name": "Jane Roe", "officer_role": "director", "nationality": "British"}]}])
    write("pscs.json", [{"company_number": "001", "items": [
        {"name": "JANE ROE", "natures_of_control": ["ownership-of-shares-75-to-100-percent"]}]}])
    write("filings.json", [{"company_number": "001", "items": [{"date": "2023-06-01", "type": "AA"}]}])
    with open(os.path.join(d, "leaks.csv"), "w") as f:
        f.write("n.name\n jane roe \n")
    out = main(["due-diligence", "--profiles", f"{d}/profiles.json", "--officers", f"{d}/officers.json",
                "--pscs", f"{d}/pscs.json", "--filings", f"{d}/filings.json",
                "--leaked", f"{d}/leaks.csv", "--out", f"{d}/out", "--as-of", "2024-01-01"], spark)
    scores = {r["company_number"]: r for r in spark.read.parquet(out["scores"]).collect()}
    # 001: Iran address (black list) 30 + overdue 10 + two leak hits (officer and PSC) 30 = 70
    assert (scores["001"]["score"], scores["001"]["tier"]) == (70, "HIGH")
    # 002: dissolved 25 + no PSC 20 + no filings 10 = 55
    assert (scores["002"]["score"], scores["002"]["tier"]) == (55, "MEDIUM")
    hits = spark.read.parquet(out["leak_hits"]).count()
    assert hits == 2


def test_portfolio_from_csv(spark):
    d = tempfile.mkdtemp(prefix="riskloom-cli-", dir="/tmp")
    with open(os.path.join(d, "companies.csv"), "w") as f:
        f.write("company_number,company_name,company_status,country,accounts_overdue\n"
                "00012345,Acme,active,Iran,true\nSC123456,Beta,dissolved,France,false\nNI000777,Gamma,active,,\n")
    with open(os.path.join(d, "kyc.csv"), "w") as f:
        f.write("id,company_number,risk_tier,risk_score,leak_hit,status\n"
                "10,00012345,LOW,10,false,old\n11,00012345,HIGH,70,true,new\n12,SC123456,MEDIUM,40,,ok\n")
    out = main(["portfolio", "--companies", f"{d}/companies.csv", "--kyc", f"{d}/kyc.csv",
                "--out", f"{d}/out"], spark)
    rows = {r["company_number"]: r for r in spark.read.parquet(out["portfolio"]).collect()}
    assert (rows["00012345"]["risk_tier"], rows["00012345"]["risk_score"], rows["00012345"]["leak_hit"]) == ("HIGH", 70, "YES")
    assert (rows["NI000777"]["risk_score"], rows["NI000777"]["leak_hit"]) == (0, "No")
    comp = spark.read.parquet(out["compliance"]).first()
    assert (comp["overdue"], comp["on_track"]) == (1, 1)
    tiers = {r["risk_tier"]: r["companies"] for r in spark.read.parquet(out["tiers"]).collect()}
    assert tiers == {"HIGH": 1, "MEDIUM": 1}
    fatf = [r["company_name"] for r in spark.read.parquet(out["jurisdictions"]).collect()]
    assert fatf == ["Acme"]
