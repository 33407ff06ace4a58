"""WARC derivatives: a metadata and a plain-text conversion record for every response.

responses() frames pages as response records: identifier, target, HTTP header block, payload and its digest.
derivatives() makes of each a metadata record (title, language, out-links, as warc-fields) and a conversion record (the
page's text); both name the response in refers_to, repeat its target, date, headers and payload digest, and carry
their own identifier, length and block digest. write_warc() serialises records to WARC files, a gzip member per record.

Everything is a projection of one row: no exchange. Identifiers come from the record's kind, page_id and url, so reruns
agree. Digests are SHA-1 in base 32, lengths are bytes of UTF-8.

Null html is an empty payload, whose text and fields are empty; a null url is an empty target; repeated pages give
repeated records. An empty table gives an empty result. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

CRAWL_DATE = "2024-01-31T00:00:00Z"

#: The named character references that are decoded, &amp; last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"))
#: Elements dropped with what they hold, and elements that begin and end lines.
DROPPED = ("script", "style", "template", "noscript", "title")
_BLOCKS = r"(?i)</?(?:p|br|div|h[1-6]|li|ul|ol|dl|dt|dd|nav|article|section|footer|header|main|aside|table|tr|td|th|blockquote|pre|form|hr|body|html)\b[^>]*>"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(block: Column) -> Column:
    """"sha1:" and the digest in base 32: four times forty bits, eight characters each."""
    digest = F.sha1(block)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.concat(F.lit("sha1:"), *[F.translate(p, *_BASE32) for p in parts])


def record_id(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts]))


def named(text: Column) -> Column:
    """Common named character references as characters, &amp; last."""
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _numeric(text: Column, pattern: str, base: int) -> Column:
    def sign(ref: Column) -> Column:
        code = F.conv(F.regexp_extract(ref, pattern, 1), base, 16)
        return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")

    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
    return F.aggregate(codes, text, lambda acc, ref: F.replace(acc, ref, sign(ref)))


def decoded(df: DataFrame, column: str) -> DataFrame:
    """df with the character references in column as characters: numeric ones first, each kind once, then named ones.

    A step per projection, so that a long text expression is evaluated once and not once per mention.
    """
    text = F.col(column)
    for pattern, base in ((r"&#(\d{1,6});", 10), (r"&#[xX]([0-9a-fA-F]{1,5});", 16)):
        df = df.withColumn(column, F.when(text.contains("&#"), _numeric(text, pattern, base)).otherwise(text))
    return df.withColumn(column, named(text))


def squeezed(text: Column) -> Column:
    """Blanks squeezed to one, lines trimmed, empty lines dropped."""
    text = F.regexp_replace(text, r"[ \t\r\f\x0B\xA0]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def without_tags(html: Column) -> Column:
    """html without comments, dropped elements and tags; elements that begin or end lines leave a line break."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in DROPPED:
        text = F.regexp_replace(text, rf"(?is)<{name}\b.*?</{name}\s*>", "")
    return F.regexp_replace(F.regexp_replace(text, _BLOCKS, "\n"), r"<[^>]*>", "")


def responses(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """page_id, record_id, target_uri, date, http_headers, payload and payload_digest of every page."""
    payload, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    charset = F.coalesce(F.nullif(F.lower(F.regexp_extract(payload, r"(?i)<meta[^>]*charset=[\"']?([A-Za-z0-9_-]+)", 1)), F.lit("")), F.lit("utf-8"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset="), charset, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
        sha1_base32(payload).alias("payload_digest"),
    )


def derivatives(sources: DataFrame) -> DataFrame:
    """Two records per response; see the module's docstring. block is the record's content."""
    html = F.col("payload")
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    lang = F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z0-9-]+)", 1)
    links = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*\bhref=[\"']([^\"'<>\s]*)[\"']"), 1)
    own = sources.withColumns({"title": title, "lang": lang, "links": links, "words": without_tags(html)}).drop("payload")
    own = decoded(decoded(own, "words"), "title")
    shown = F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), named(x), F.lit(" L a/@href\r\n"))), "")
    fields = F.concat(F.lit("title: "), F.regexp_replace(squeezed(F.col("title")), "\n", " "), F.lit("\r\nlanguage: "), "lang", F.lit("\r\n"), shown)
    own = own.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload_digest", fields.alias("fields"), squeezed(F.col("words")).alias("words"))
    kinds = F.explode(
        F.array(
            F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.col("fields").alias("block")),
            F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("words").alias("block")),
        )
    ).alias("r")
    made = own.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers", "payload_digest", kinds).select("*", "r.*").drop("r")
    return made.withColumns(
        {
            "record_id": record_id(F.col("record_type"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri")),
            "content_length": F.octet_length("block").cast("long"),
            "block_digest": sha1_base32(F.col("block")),
        }
    )


def _field(value: Column) -> Column:
    """A header value on one line: line breaks in urls would end it."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def record_head(records: DataFrame) -> Column:
    """The WARC header of a derivative."""
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(">")),
        F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_to"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _field(F.col("target_uri"))),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Refers-To-Payload-Digest: "), F.col("payload_digest")),
        F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("Content-Type: "), F.col("content_type")),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


@dataclass
class _Written(WriterCommitMessage):
    file: str


class _Files(DataSourceArrowWriter):
    """Every task writes a file of its own under a name no other attempt has; what isn't committed is removed."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = FileSystem.from_uri(self.folder)
        store.create_dir(folder)
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for record in batch.column(0):
                    out.write(gzip.compress(record.as_py(), mtime=0))
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = FileSystem.from_uri(self.folder)
        kept = {Path(m.file).name for m in messages if m}
        for info in store.get_file_info(FileSelector(folder, allow_not_found=True)):
            if info.base_name.endswith(".warc.gz") and info.base_name not in kept:
                store.delete_file(info.path)  # of attempts that were lost

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = FileSystem.from_uri(self.folder)
        for m in messages:
            if m:
                store.delete_file(m.file)


class WarcFiles(DataSource):
    """Sink of whole records (one binary column), as gzip members in files of a new folder."""

    @classmethod
    def name(cls) -> str:
        return "warc_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Files(self.options["path"])


def write_warc(records: DataFrame, path: str) -> None:
    """records as WARC files in the new folder path (a URI or an absolute path that all executors reach)."""
    spark = records.sparkSession
    spark.dataSource.register(WarcFiles)
    folder = path if "://" in path else "file://" + path
    whole = F.concat(F.encode(record_head(records), "UTF-8"), F.encode("block", "UTF-8"), F.lit(b"\r\n\r\n"))
    records.select(whole.alias("record")).write.format("warc_files").mode("append").save(folder)


def _oracle() -> str:
    def base32(block: str) -> str:
        parts = " || ".join(f"translate(to_base(('0x' || substr(sha1({block}), {at}, 10))::BIGINT, 32, 8), '{_BASE32[0]}', '{_BASE32[1]}')" for at in (1, 11, 21, 31))
        return f"'sha1:' || {parts}"

    def uuid(*parts: str) -> str:
        d = f"md5(concat_ws('|', {', '.join(parts)}))"
        return "'urn:uuid:' || " + " || '-' || ".join(f"substr({d}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

    def plain(text: str) -> str:
        for name, sign in ENTITIES:
            text = f"replace({text}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
        return text

    def squeeze(text: str) -> str:
        return rf"regexp_replace(regexp_replace(regexp_replace({text}, '[ \t\r\f\x0B\xA0]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"

    text = "regexp_replace(payload, '(?s)<!--.*?-->', '', 'g')"
    for name in DROPPED:
        text = rf"regexp_replace({text}, '(?is)<{name}\b.*?</{name}\s*>', '', 'g')"
    text = squeeze(plain(f"regexp_replace(regexp_replace({text}, '{_BLOCKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"))
    title = rf"replace({squeeze(plain(r'regexp_extract(payload, $q$(?is)<title[^>]*>(.*?)</title\s*>$q$, 1)'))}, chr(10), ' ')"
    link = plain("x")
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
s AS (SELECT page_id, {uuid("'response'", "coalesce(page_id::VARCHAR, '')", "target_uri")} AS refers_to, target_uri, '{CRAWL_DATE}' AS date,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=' ||
    coalesce(nullif(lower(regexp_extract(payload, $q$(?i)<meta[^>]*charset=["']?([A-Za-z0-9_-]+)$q$, 1)), ''), 'utf-8') || chr(13) || chr(10) ||
    'Content-Length: ' || strlen(payload) || chr(13) || chr(10) || chr(13) || chr(10) AS http_headers,
  {base32("payload")} AS payload_digest,
  'title: ' || {title} || chr(13) || chr(10) || 'language: ' || regexp_extract(payload, $q$(?i)<html[^>]*\blang=["']?([A-Za-z0-9-]+)$q$, 1) || chr(13) || chr(10) ||
    array_to_string(list_transform(regexp_extract_all(payload, $q$(?i)<a\b[^>]*\bhref=["']([^"'<>\s]*)["']$q$, 1), lambda x: 'outlink: ' || {link} || ' L a/@href' || chr(13) || chr(10)), '') AS fields,
  {text} AS words FROM p),
r AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, fields AS block FROM s
      UNION ALL SELECT *, 'conversion', 'text/plain', words FROM s)
SELECT page_id, refers_to, target_uri, date, http_headers, payload_digest, record_type, content_type, block,
  {uuid("record_type", "coalesce(page_id::VARCHAR, '')", "target_uri")} AS record_id, strlen(block)::BIGINT AS content_length, {base32("block")} AS block_digest
FROM r
"""


ORACLE = _oracle()
