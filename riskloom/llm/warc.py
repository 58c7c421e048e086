"""WARC archives: write pages as records, read archives back, assemble transactions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.store import stored
from riskloom.session import ship_package

# fixed values of the WARC format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = ("record_id string, record_type string, concurrent_to array<string>, refers_to string, "
           "target_uri string, date string, content_type string, payload_digest string, digest_ok boolean, "
           "payload_bytes long, fields map<string,string>, payload binary")
_CAPTURES = ("response", "revisit", "resource")


def base32_sha1(text: Column) -> Column:
    """Upper-case base-32 SHA-1 of a string's UTF-8 bytes (32 digits of five bits)."""
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(
        F.substring(F.sha1(text.cast("binary")), i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    digits = F.transform(F.flatten(F.transform(five, lambda v: F.array(
        *[F.shiftright(v, 15 - 5 * k).bitwiseAND(F.lit(31)) for k in range(4)]))),
        lambda d: F.substring(F.lit(BASE32), d + 1, F.lit(1)))
    return F.concat_ws("", digits)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\n")]
    for name, value in headers:  # a null header is left out
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block]
    return F.concat(*lines)


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
               records_per_file: int = 3000) -> None:
    """Write a request, a response or revisit, and a metadata record for every row of ``pages``.

    ``pages`` has page_id (long), url and html; the payload is html in UTF-8
    (null: empty). Of rows with equal payloads of at least
    ``min_revisit_bytes``, that with the smallest page_id (null last, then
    smallest url) is the response, others are revisits that refer to it. Rows
    that repeat the smallest page_id and url are responses too. Record ids
    derive from page_id, url and digest, so a rerun writes the same. Request
    and metadata name the capture's record as concurrent. Files are
    gzip-compressed and hold at most ``records_per_file`` records.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")) \
        .withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = (rows.groupBy("sha", "bytes")
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id",
                                 F.coalesce("url", F.lit("")).alias("at"))).alias("first")))
    rows = rows.join(first, ["sha", "bytes"])
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # a header value holds no line breaks
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    ident = lambda kind, p, u: _urn(F.lit(kind), p, u, F.col("sha"))
    first_page = F.coalesce(F.col("first.page_id").cast("string"), F.lit(""))
    own, original = (ident("capture", page, F.coalesce("url", F.lit(""))),
                     ident("capture", first_page, F.col("first.at")))
    revisit = (own != original) & (F.col("bytes") >= min_revisit_bytes)
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    ang = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    host = F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)
    common = [("WARC-Target-URI", F.when(url != "", url)), ("WARC-Date", F.lit(date))]
    capture = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        [("WARC-Record-ID", ang(own)), *common, ("WARC-Payload-Digest", digest),
         ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.when(revisit, ang(original))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, "html")))
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", ang(ident("request", page, F.coalesce("url", F.lit(""))))), ("WARC-Concurrent-To", ang(own)),
         *common, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", ang(ident("metadata", page, F.coalesce("url", F.lit(""))))), ("WARC-Concurrent-To", ang(own)),
         *common, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), page, F.lit("\r\n")))
    (rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        name = None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and name:
                headers[name][-1] += " " + text.strip()  # a folded line
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            headers.setdefault(name, []).append(value.strip())
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record ends early")
        yield headers, block


def _parse(with_payload: bool):
    def row(headers: dict[str, list[str]], block: bytes) -> tuple:
        one = lambda name: headers.get(name, [None])[0]
        bare = lambda v: v.strip("<>") if v else None
        kind, ctype = (one("warc-type") or "").lower(), one("content-type")
        fields, body = {}, block
        if (ctype or "").startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
        elif (ctype or "").startswith("application/warc-fields"):
            for line in block.decode("utf-8", "replace").splitlines():
                k, sep, v = line.partition(":")
                if sep:
                    fields[k.strip().lower()] = v.strip()
        stated = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
        if kind == "revisit":
            digest, ok, size, body = stated, None, None, None
        else:
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            ok, size = (digest == stated if stated else None), len(body)
        return (bare(one("warc-record-id")), kind, [bare(v) for v in headers.get("warc-concurrent-to", [])],
                bare(one("warc-refers-to")), one("warc-target-uri"), one("warc-date"), ctype, digest, ok, size,
                fields, body if with_payload and kind in _CAPTURES else None)

    names = [c.strip().split(" ")[0] for c in RECORDS.replace("map<string,string>", "map").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                raw = io.BytesIO(content)
                stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
                out, held = [], 0
                for headers, block in records(stream):
                    out.append(row(headers, block))
                    held += len(block) if with_payload else 200
                    if held > 8_000_000:
                        yield _frame(out, names)
                        out, held = [], 0
                if out:
                    yield _frame(out, names)
    return run


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    pdf["payload_bytes"] = pdf["payload_bytes"].astype("Int64")
    pdf["digest_ok"] = pdf["digest_ok"].astype("boolean")
    return pdf


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the WARC files under ``path`` (plain or gzip, one or many members).

    ``payload_digest`` and ``payload_bytes`` are computed from the payload;
    ``digest_ok`` compares with the stated digest. A revisit has the stated
    digest and no size. Without ``with_payload`` payloads are not returned.
    """
    ship_package(spark)
    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInPandas(_parse(with_payload), RECORDS))


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture (response, revisit, resource): its record, request and metadata.

    Requests and metadata meet their capture through concurrent-to identifiers
    in either direction. Columns: those of ``recs``, ``request`` (struct, that
    with the smallest id if there are several) and ``metadata`` (array of
    structs). Records without a capture give no row; a capture without request
    or metadata has null there. Captures that repeat a record id stay apart.
    """
    captures = recs.where(F.col("record_type").isin(*_CAPTURES))
    others = recs.where(F.col("record_type").isin("request", "metadata")).select(
        "record_type", "concurrent_to",
        F.struct("record_id", "target_uri", "date", F.map_entries("fields").alias("fields")).alias("rec"))
    forward = others.select(F.explode("concurrent_to").alias("cid"), "record_type", "rec")
    named = captures.select(F.col("record_id").alias("cid"), F.explode("concurrent_to").alias("to"))
    backward = named.join(others, F.col("to") == F.col("rec.record_id")).select("cid", "record_type", "rec")
    attached = (forward.unionByName(backward).groupBy("cid")
                .agg(F.min(F.when(F.col("record_type") == "request", F.struct("rec.record_id", "rec.target_uri", "rec.date")))
                     .alias("request"),
                     F.collect_set(F.when(F.col("record_type") == "metadata", F.col("rec"))).alias("metadata")))
    return captures.join(attached, captures["record_id"] == attached["cid"], "left").drop("cid")


def page_captures(recs: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to.

    page_id comes from the metadata record. A revisit's size and ``refers_to``
    (page_id) come from the response whose record id it refers to; they are
    null if that is not in the archives.
    """
    # the archives are parsed once; the joins read the slim records
    recs = stored(recs.drop("payload"), "records")
    rows = stored(assemble(recs).select(
        "record_id", "record_type", "refers_to", "payload_digest", "payload_bytes",
        F.expr("nullif(element_at(map_from_entries(metadata[0].fields), 'page-id'), '')").cast("long").alias("page_id")),
        "captures")
    own = rows.where("record_type <> 'revisit'")
    first = (own.where("record_type = 'response'").groupBy(F.col("record_id").alias("of"))
             .agg(F.first("page_id").alias("of_page"), F.first("payload_bytes").alias("of_bytes")))
    revisits = rows.where("record_type = 'revisit'")
    return (own.select("page_id", "payload_bytes", "payload_digest", "record_type",
                       F.lit(None).cast("long").alias("refers_to"))
            .unionByName(revisits.join(first, revisits["refers_to"] == first["of"], "left")
                         .select("page_id", F.col("of_bytes").alias("payload_bytes"), "payload_digest", "record_type",
                                 F.col("of_page").alias("refers_to"))))
