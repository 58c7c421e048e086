"""Secret scans with corpus-wide ownership frequency.

Pattern spans (assign, access, hex) and, beyond them, long mixed tokens are
candidates. Each candidate value's hash is counted over the whole corpus by
distinct repositories and distinct owners. A value that many owners have, or
that stands in many repositories of few owners, is a copied example; any other
live-looking value (random, no placeholder) is taken for a credential, also if
two owners share it, as a missed credential costs more than a marked copy.
Mixed tokens that are such credentials become spans of kind ``blob``; pattern
spans stay whatever their ownership.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.spans import count_kind, listed, matches, named
from riskloom.llm.store import stored

ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]++)""")
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
BLOB = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+"
KINDS = ("assign", "access", "hex", "blob")
EXAMPLE_OWNERS = 3     # owners from which on a value is a copied example
EXAMPLE_REPOS = 10     # repositories of an owner from which on a value is a copied example
MIN_ENTROPY = 3.0      # bits a character
PLACEHOLDER = r"(?i)example|sample|change_?me|your|dummy|placeholder|x{4,}|0{6,}|1234567"


def entropy(v: Column) -> Column:
    """Bits a character of a string's own character frequencies."""
    n = F.length(v).cast("double")
    return F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0.0), lambda a, c: a + F.when(
        c == "", F.lit(0.0)).otherwise((lambda k: -k / n * F.log2(k / n))(
            (F.length(v) - F.length(F.replace(v, c, F.lit("")))).cast("double"))))


def live_looking(v: Column) -> Column:
    return ~v.rlike(PLACEHOLDER) & (entropy(v) >= MIN_ENTROPY)


def base_spans(text: Column) -> Column:
    """Sorted array of struct(s, k, e, kind, m); m is the secret value."""
    assign = F.filter(matches(text, ASSIGN, text.rlike(r"(?i)passw|secret|token|api_?key"), 1),
                      lambda x: F.length(x["m"]) >= 8)
    access = matches(text, ACCESS, text.contains("AKIA"))
    hexes = matches(text, HEX, text.rlike(r"[0-9a-f]{32}"))
    return F.array_sort(F.concat(*[named(v, kind, k) for k, (kind, v) in enumerate(
        (("assign", assign), ("access", access), ("hex", hexes)))]))


def _blobs(text: Column, base: Column) -> Column:
    found = matches(text, BLOB, text.rlike(r"[A-Za-z0-9+/_=-]{24}"))
    mixed = F.filter(found, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]")
                     & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return named(mixed, "blob", 3)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repos, verdict) of every value: example, live or other.

    ``candidates`` has hash, live (boolean), owner, repo. Counted over distinct
    (hash, owner, repo) rows, so that a value that stands in a third of all
    documents is aggregated before it moves. Null owners are one owner. ``repos``
    are those of the owner with the most: from EXAMPLE_REPOS on, as from
    EXAMPLE_OWNERS owners on, the value is an example. With less, one or two
    owners alike, it is live if it looks so.
    """
    own = candidates.groupBy("hash", "owner", "repo").agg(F.max("live").alias("live"))
    owners = own.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("live").alias("live"))
    return (owners.groupBy("hash").agg(F.count("*").alias("owners"), F.max("repos").alias("repos"),
                                       F.max("live").alias("live"))
            .withColumn("verdict", F.when((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS), "example")
                        .when(F.col("live"), "live").otherwise("other")))


def find_secrets(docs: DataFrame, owner: str = "source", repo: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, owner and repo columns).

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_blob,
    n_live and n_example (candidates of the row by their ownership). ``spans``
    lists kind:start:end (code points, end exclusive) by start, then kind. A
    repository is the combination of ``repo`` columns within its owner; without
    them each document (doc_id, or the text where that is null) is one.

    Defined cases: a null or empty text has no spans (digest of the empty
    string); rows that repeat a doc_id or a text are answered each; null owners
    count as one owner; an empty table gives no rows. Other columns are not
    read.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (repo or [])]
    document = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(F.col("text").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                       (F.concat_ws("\n", *parts) if parts else document).alias("repo"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("blobs", _blobs(F.col("text"), F.col("base")))
    hashed = F.transform(F.concat("base", "blobs"), lambda x: F.struct(
        x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"),
        F.sha2(x["m"], 256).alias("hash"), live_looking(x["m"]).alias("live")))
    rows = stored(rows.select("doc_id", "owner", "repo", F.when(F.size(F.concat("base", "blobs")) > 0, F.md5("text"))
                              .alias("key"), hashed.alias("found")), "secrets")
    seen = rows.where("key is not null").select("owner", "repo", F.explode("found").alias("f")).select(
        "owner", "repo", "f.hash", "f.live")
    verdicts = ownership(seen).select("hash", "verdict")
    # once for equal texts: which of its candidates are what
    texts = (rows.where("key is not null").groupBy("key").agg(F.first("found").alias("found"))
             .select("key", F.explode("found").alias("f")).select("key", "f.*"))
    judged = stored(texts.join(verdicts, "hash").groupBy("key").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") == "blob") & (F.col("verdict") == "live"),
                                           F.struct("s", "k", "e", "kind")))).alias("more"),
        F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"),
        F.count(F.when(F.col("verdict") == "example", 1)).alias("n_example")), "judged")
    slim = F.transform(F.filter("found", lambda x: x["kind"] != "blob"), lambda x: F.struct(
        x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    out = rows.withColumn("base", slim).join(judged, "key", "left")
    out = out.withColumn("all", F.array_sort(F.concat("base", F.coalesce(
        "more", F.array().cast(judged.schema["more"].dataType)))))
    return out.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"),
        count_kind(F.col("all"), "blob").alias("n_blob"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))
