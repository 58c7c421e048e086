"""Per-company detail views derived alongside the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.jurisdiction import DEFAULT_LISTS, jurisdiction_risk
from riskloom.functions.text import join_nonempty, python_title, yes_no
from riskloom.operators.screening import flag_hits, screened_parties

# Defaults and labels of the detail views.
NA = "N/A"
RESIGNED, ACTIVE = "Resigned", "Active"
CLEAR = "Clear"
ACTIVE_STATUS = "active"
STATUS_GOOD, STATUS_BAD = "success", "danger"


def _na(c):
    return F.coalesce(c, F.lit(NA))


def profile_view(profiles: DataFrame, lists=DEFAULT_LISTS) -> DataFrame:
    """Company profile panel: titled status, joined address with its screening label."""
    a = F.col("registered_office_address")
    addr = join_nonempty(", ", a.address_line_1, a.address_line_2, a.locality, a.postal_code,
                         a.country)
    status = python_title(F.regexp_replace(_na(F.col("company_status")), "_", " "))
    jx = jurisdiction_risk(F.coalesce(a.country, F.lit("")), lists)
    return profiles.select(
        "company_number", "company_name",
        status.alias("status"),
        F.when(F.lower(status) == ACTIVE_STATUS, STATUS_GOOD).otherwise(STATUS_BAD).alias("status_class"),
        _na(F.col("date_of_creation")).alias("incorporated"),
        _na(F.col("type")).alias("company_type"),
        _na(F.col("jurisdiction")).alias("jurisdiction"),
        F.coalesce(F.nullif(F.array_join(F.col("sic_codes"), ", "), F.lit("")), F.lit(NA)).alias("sic_codes"),
        F.coalesce(F.nullif(addr, F.lit("")), F.lit(NA)).alias("registered_address"),
        jx.label.alias("address_risk"),
        _na(F.col("accounts.next_due")).alias("accounts_due"),
        yes_no(F.col("accounts.overdue")).alias("accounts_overdue"))


def officer_view(officers: DataFrame, leaked: DataFrame, lists=DEFAULT_LISTS) -> DataFrame:
    """Officer rows: role titled, Active/Resigned, first screened field label, leak hit."""
    nat, cor = _na(F.col("nationality")), _na(F.col("country_of_residence"))
    label = F.coalesce(jurisdiction_risk(nat, lists).label, jurisdiction_risk(cor, lists).label)
    hits = flag_hits(officers, leaked)
    resigned = F.col("resigned_on")
    return hits.select(
        "company_number", "pos",
        _na(F.col("name")).alias("name"),
        python_title(F.regexp_replace(_na(F.col("officer_role")), "-", " ")).alias("role"),
        _na(F.col("appointed_on")).alias("appointed"),
        F.when(resigned.isNotNull() & (resigned != ""), RESIGNED).otherwise(ACTIVE).alias("status"),
        nat.alias("nationality"), cor.alias("country_of_residence"),
        F.coalesce(label, F.lit(CLEAR)).alias("jurisdiction_flag"),
        yes_no(F.col("leak_hit")).alias("leak_hit"))


def psc_view(pscs: DataFrame, leaked: DataFrame, lists=DEFAULT_LISTS) -> DataFrame:
    """PSC rows: residence-else-nationality country and its label, ``month/year`` birth, hit."""
    country = F.coalesce(F.col("country_of_residence"), F.col("nationality"), F.lit(NA))
    dob = F.col("date_of_birth")
    dob_s = F.when(dob.isNotNull(), F.concat(F.coalesce(dob.month.cast("string"), F.lit("")), F.lit("/"),
                                             F.coalesce(dob.year.cast("string"), F.lit("")))).otherwise(NA)
    hits = flag_hits(pscs, leaked)
    return hits.select(
        "company_number", "pos", _na(F.col("name")).alias("name"),
        F.array_join(F.coalesce(F.col("natures_of_control"), F.array().cast("array<string>")), ", ")
         .alias("natures_of_control"),
        country.alias("country"), dob_s.alias("date_of_birth"),
        jurisdiction_risk(country, lists).label.alias("jurisdiction_flag"),
        yes_no(F.col("leak_hit")).alias("leak_hit"))


def filings_top(filings: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` filings per company in the order the feed delivers them (``pos``).

    ``row_number() <= n`` plans as a WindowGroupLimit: at most n rows per
    company leave each map task, whatever the company's size.
    """
    # equal positions (a page that was landed twice) are settled by the newest date
    w = Window.partitionBy("company_number").orderBy(F.col("pos").asc_nulls_last(), F.col("date").desc_nulls_last())
    return (filings.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n)
            .select("company_number", F.col("rank").cast("int").alias("rank"),
                    _na(F.col("date")).alias("date"), _na(F.col("type")).alias("type"),
                    _na(F.col("description")).alias("description"),
                    _na(F.col("category")).alias("category")))


def party_counts(profiles: DataFrame, officers: DataFrame, pscs: DataFrame, filings: DataFrame,
                 leaked: DataFrame) -> DataFrame:
    """Per company the number of officers, PSCs, filings and leak hits (0 when none).

    Each count is a partial aggregation joined 1:1 to the company list.
    """
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("company_number").agg(F.count(F.lit(1)).alias(name))

    hits = flag_hits(screened_parties(officers, pscs), leaked).filter("leak_hit")
    out = profiles.select("company_number")
    for df, name in ((officers, "n_officers"), (pscs, "n_pscs"), (filings, "n_filings"), (hits, "n_leak_hits")):
        out = out.join(count(df, name), "company_number", "left")
    return out.select("company_number", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                          for c in ("n_officers", "n_pscs", "n_filings", "n_leak_hits")])
