"""Derivatives of WARC response records: linked metadata and plain-text conversion records.

A response is identified by a urn:uuid made from the digest of its url and
payload, so reruns and other tables agree on it; ``responses`` gives the response
records themselves, whose WARC-Record-ID that is. For each response two records
are built, both with WARC-Refers-To naming it, its target URI, its date and its
payload digest:

* ``metadata`` (application/warc-fields): the source's headers - target, length,
  digest, nothing that the table doesn't have - and title, language and number of
  links of its page.
* ``conversion`` (text/plain): the page as text. Comments, scripts, styles and
  templates are dropped, block ends become line ends, other tags are dropped,
  character references are decoded, white space is collapsed.

All named and numeric character references are decoded, in text and title, as
html.unescape decodes them; one for a no-break space gives a space.

``record`` holds the whole record as bytes: version line, headers, an empty
line, the block, two empty lines. Native expressions but for the references,
which an Arrow function decodes: no shuffle at all, one pass over the table, two
rows out for each in.

Line ends in a url are written as %0D and %0A in records, so that a header stays
one line; the column target_uri has the url as it is.

Defined cases: null html is an empty payload; a null url gives an empty target;
pages of any length are converted whole;
repeated rows give repeated records with equal ids; null page_ids are kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as markup
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What html.unescape takes for a character reference.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<head\b.*?</head\s*>"
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|main|aside|blockquote|pre|title|form)\b[^>]*>"
DATE = "2024-01-01T00:00:00Z"


def urn(value: Column) -> Column:
    """A name-based urn:uuid (version 8) from the SHA-256 of ``value``."""
    h = F.sha2(value, 256)
    cuts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def unescape(text: str) -> str:
    return REFERENCE.sub(lambda m: markup.unescape(m[0]).replace("\xa0", " "), text) if "&" in text else text


def decoded(text: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unescape(t) for t in column.to_pylist()], pa.string())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}  # not as text
    return F.arrow_udf(run, "string")(text)


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, DROPPED, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = decoded(text)
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _line(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _octets(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Two records for each row of ``pages`` (page_id, url, html)."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    base = pages.select("page_id", url.alias("target_uri"), html.alias("html")).select(
        "page_id",
        "target_uri",
        urn(F.concat(F.col("target_uri"), F.lit("\n"), F.col("html"))).alias("refers_to"),
        digest(F.col("html")).alias("source_digest"),
        F.concat(
            F.lit("source-target-uri: "), _line(F.col("target_uri")),
            F.lit("\r\nsource-content-length: "), _octets(F.col("html")),
            F.lit("\r\nsource-payload-digest: "), digest(F.col("html")),
            F.lit("\r\ntitle: "), F.trim(F.regexp_replace(decoded(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1)), r"[ \t\r\n]+", " ")),
            F.lit("\r\nlanguage: "), F.regexp_extract("html", r"(?i)<html[^>]*\blang=\"([A-Za-z-]*)\"", 1),
            F.lit("\r\noutlinks: "), F.regexp_count("html", F.lit(r"(?i)<a[^>]*\bhref=")).cast("string"), F.lit("\r\n"),
        ).alias("fields"),
        plain_text(F.col("html")).alias("text"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("mime"), F.col("fields").alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("mime"), F.col("text").alias("block")),
    )
    rows = base.select("page_id", "target_uri", "refers_to", "source_digest", F.explode(kinds).alias("k")).select(
        "page_id", F.col("k.type").alias("warc_type"), "target_uri", "refers_to", "source_digest", F.col("k.mime").alias("content_type"), F.col("k.block").alias("block")
    )
    rows = rows.withColumn("payload_digest", F.when(F.col("warc_type") == "conversion", digest(F.col("block"))))
    rows = rows.withColumn("record_id", urn(F.concat_ws("\n", "refers_to", "warc_type", "block"))).withColumn("block_digest", digest(F.col("block")))
    return rows.withColumn("record", _record(date))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The response record of each row of ``pages``, which its derivatives refer to. The
    table has no HTTP headers, so that the block is the payload and its type is text/html."""
    base = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("target_uri"), F.coalesce(F.col("html"), F.lit("")).alias("block"))
    none = F.lit(None).cast("string")
    rows = base.select(
        "page_id", F.lit("response").alias("warc_type"), "target_uri", none.alias("refers_to"), none.alias("source_digest"), F.lit("text/html").alias("content_type"), "block",
        digest(F.col("block")).alias("payload_digest"), urn(F.concat("target_uri", F.lit("\n"), "block")).alias("record_id"), digest(F.col("block")).alias("block_digest"),
    )
    return rows.withColumn("record", _record(date))


def _record(date: str) -> Column:
    """The whole record as bytes; a header whose value is null is left out."""

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("warc_type"), header("WARC-Record-ID", F.col("record_id")), F.lit(f"\r\nWARC-Date: {date}"),
        header("WARC-Target-URI", _line(F.col("target_uri"))), header("WARC-Refers-To", F.col("refers_to")), header("WARC-Source-Payload-Digest", F.col("source_digest")),
        header("WARC-Payload-Digest", F.col("payload_digest")), header("WARC-Block-Digest", F.col("block_digest")), header("Content-Type", F.col("content_type")),
        header("Content-Length", _octets(F.col("block"))), F.lit("\r\n\r\n"),
    )
    return F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary")
