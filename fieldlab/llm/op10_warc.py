"""WARC derivative builder.

A response record gives two linked records: metadata (application/warc-fields) and a conversion to plain
text. Both keep the response's id as WARC-Refers-To, its target URI and date, and its payload digest as
source digest; metadata also keeps the source's HTTP headers. Digests are sha256 of the whole block in hex,
and record ids are urn:uuids derived from the source's key, URI, payload and kind, so a run that is repeated
gives the same records.

Records are built by column expressions, but for the text of a page, which is made in batches: patterns take markup
out, the standard library decodes character references (no-break spaces become spaces). Scripts, styles and comments without an end go to the end of the page;
quoted attributes may hold >. Reading streams files by Content-Length (gzip members too), and its rows are
sources of derivatives; writing goes through the text sink, one WARC file per partition.

Null html is an empty payload, null url an empty URI; tabs and line breaks in a URL are left out, as browsers do.
Repeated pages give repeated records with the same ids, which are written once. Extra columns aren't returned.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldlab.llm.common import table
from fieldlab.sources import netcdf

VERSION = "WARC/1.1"
#: Date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
GZIP = b"\x1f\x8b"
#: Bytes read or inflated at once, and about those of a batch of records.
CHUNK, BATCH = 1 << 16, 8 << 20

#: The rest of a tag; after an odd quote, up to the next >.
TAG_END = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
# What the conversion does to html, in order; ++ and *+ only keep it from going back.
CONVERSION = [
    (r"(?is)<!--.*?(?:-->|\Z)|<script\b[^>]*>.*?(?:</script\s*>|\Z)|<style\b[^>]*>.*?(?:</style\s*>|\Z)|<head\b[^>]*>.*?</head\s*>", " "),
    (r"[\t\r\n\f]+ *[ \t\r\n\f]*| [ \t\r\n\f]+", " "),
    (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b" + TAG_END, "\n"),
    (r"<[A-Za-z/!?]" + TAG_END, ""),
]
STEPS = [(re.compile(pattern), to) for pattern, to in CONVERSION]


def converted(html: str) -> str:
    """Text of a page: a line for each block, references decoded, no-break spaces as spaces."""
    for pattern, to in STEPS:
        html = pattern.sub(to, html)
    lines = "\n".join(x for line in html.split("\n") if (x := line.strip(" ")))
    return (unescape(lines) if "&" in lines else lines).replace("\xa0", " ").strip(" \n")


@F.pandas_udf(T.StringType())
def plain_text(html: pd.Series) -> pd.Series:
    return html.map(converted)


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-"), at(13, 4), F.lit("-"), at(17, 4), F.lit("-"), at(21, 12), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as response records: key, record_id, target_uri, date, http_headers, payload, payload_digest, block_digest."""
    body = F.coalesce(F.col(html), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    uri = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\t\r\n]", "")
    rows = pages.select(F.col(key).alias("key"), uri.alias("target_uri"), body.alias("payload"), headers.alias("http_headers"))
    rows = rows.withColumn("payload_digest", digest(F.col("payload")))
    rows = rows.withColumn("record_id", urn(F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest"), F.lit("response")))
    return rows.select("key", "record_id", "target_uri", F.lit(NO_DATE).alias("date"), "http_headers", "payload", "payload_digest", digest(F.concat("http_headers", F.lit("\r\n"), "payload")).alias("block_digest"))


def derivatives(sources: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response record."""
    text = plain_text(F.col("payload"))
    fields = F.concat(F.lit("source-digest: "), F.col("payload_digest"), F.lit("\r\nsource-block-digest: "), F.col("block_digest"), F.lit("\r\nsource-length: "), F.octet_length("payload").cast("string"), F.lit("\r\nsource-http: "), F.replace(F.btrim(F.col("http_headers"), F.lit("\r\n")), F.lit("\r\n"), F.lit("\r\n ")), F.lit("\r\n"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")),
    )
    rows = sources.select("key", "record_id", "target_uri", "date", "payload_digest", F.explode(kinds).alias("_made")).select("*", "_made.*")
    return rows.select("key", "record_type", urn(F.col("record_id"), F.col("record_type")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "content_type", F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"), F.col("payload_digest").alias("source_digest"), "block")


def record_text(records: DataFrame) -> Column:
    """A derivative as it stands in a WARC file."""
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: "), "record_id", F.lit("\r\nWARC-Refers-To: "), "refers_to", F.lit("\r\nWARC-Target-URI: "), "target_uri", F.lit("\r\nWARC-Date: "), "date",
        F.lit("\r\nWARC-Block-Digest: "), "block_digest", F.lit("\r\nWARC-Source-Payload-Digest: "), "source_digest", F.lit("\r\nContent-Type: "), "content_type", F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), "block", F.lit("\r\n\r\n"),
    )


def write_warc(records: DataFrame, path: str, compression: str | None = None) -> None:
    """Derivatives as WARC files, one per partition; a record that is repeated is written once."""
    records = records.dropDuplicates(["record_id"])
    writer = records.select(record_text(records).alias("value")).write.option("lineSep", "\r\n\r\n")
    (writer.option("compression", compression) if compression else writer).text(path)


class Stream:
    """The bytes of a file, as far as they are needed; members of a gzip file one after the other."""

    def __init__(self, file):
        self.parts, self.have = self.chunks(file), bytearray()

    @staticmethod
    def chunks(file) -> Iterator[bytes]:
        data = file.read(max(2, CHUNK))
        if data[:2] != GZIP:
            while data:
                yield data
                data = file.read(CHUNK)
            return
        member = zlib.decompressobj(31)
        while data or (data := file.read(CHUNK)):
            if member.eof:
                data += file.read(1) if len(data) < 2 else b""
                if data[:2] != GZIP:  # padding
                    return
                member = zlib.decompressobj(31)
            yield member.decompress(data, CHUNK)
            data = member.unused_data if member.eof else member.unconsumed_tail

    def fill(self, n: int) -> bool:
        while len(self.have) < n:
            part = next(self.parts, None)
            if part is None:
                return False
            self.have += part
        return True

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(memoryview(self.have)[:n])
        del self.have[:n]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What stands before a mark, which goes too; None if there is none."""
        seen = 0
        while (at := self.have.find(mark, max(0, seen - len(mark) + 1))) < 0:
            seen = len(self.have)
            if not self.fill(seen + 1):
                return None
        return self.take(at + len(mark))[:at]


def parsed(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file; blank lines between records are skipped."""
    stream = Stream(file)
    while True:
        while stream.fill(2) and stream.have[:2] == b"\r\n":
            del stream.have[:2]
        if not stream.fill(5) or stream.have[:5] != b"WARC/" or (head := stream.until(b"\r\n\r\n")) is None:
            return
        headers = fields_of(head)
        yield headers, stream.take(int(headers.get("content-length", 0)))


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields below the first line, names in lower case; a line that begins with white space goes on with the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def unchunked(body: bytes) -> bytes:
    """A body without the lengths of chunked transfer; as it is if it hasn't got them."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body
        n = int(size, 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def content(head: bytes, body: bytes) -> str:
    """A response's body as text: without chunks, gzip or deflate coding, by its charset (UTF-8 if none is known)."""
    fields = fields_of(head)
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for coding in reversed(fields.get("content-encoding", "").lower().split(",")):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding.strip(), ()):
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:  # stored without the coding that it names
                continue
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


NAMES = ["record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest", "source_digest", "http_headers", "payload"]
FIELDS = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-block-digest", "warc-source-payload-digest"]
SCHEMA = ", ".join(f"{n} string" for n in NAMES)


def batches(file) -> Iterator[pa.RecordBatch]:
    """The records of a file, in batches of about BATCH bytes."""
    rows, size = [], 0
    for h, block in parsed(file):
        head, cut, body = block.partition(b"\r\n\r\n") if h.get("warc-type") == "response" else (b"", b"", block)
        own = {"warc-block-digest": sha256(block).hexdigest(), "warc-payload-digest": sha256(body).hexdigest()}
        h = {k: f"sha256:{v}" for k, v in own.items()} | h  # of the bytes, whatever their encoding
        rows.append([*(h.get(x) for x in FIELDS), (head + cut[:2]).decode("utf-8", "replace"), content(head, body)])
        size += len(block)
        if size >= BATCH:
            yield batch_of(rows)
            rows, size = [], 0
    if rows:
        yield batch_of(rows)


def batch_of(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], NAMES)


@dataclass
class File(InputPartition):
    path: str


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        return [File(path) for path, _ in netcdf.files_of(self.path)]

    def read(self, part: File):
        system, inner = netcdf.located(part.path)
        with system.open_input_file(inner) as file:
            yield from batches(file)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: key, record_type, record_id, refers_to, target_uri, date, http_headers, payload, payload_digest, block_digest, source_digest.

    The key is the record's id. Digests are as the file has them, or made where it has none, of the bytes as they stand
    there; the payload of a response is decoded. Responses can go to derivatives as they are. A task streams a file and
    holds a batch of records at a time, so files may be of any size, and a record as large as a Spark string. Files are
    not cut: a record may itself hold a WARC file, so no pattern tells safely where a record begins. A file without
    records gives none, a record that the file's end cuts gives what is there. Files in a store that only Spark can
    open are read whole.
    """
    try:
        netcdf.located(path)
    except (OSError, ValueError):

        def run(given):
            for batch in given:
                for whole in batch.column("content"):
                    yield from batches(io.BytesIO(whole.as_py()))

        rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
    else:
        spark.dataSource.register(Warc)
        rows = spark.read.format("warc").load(path)
    return rows.select(F.col("record_id").alias("key"), "record_type", "record_id", "refers_to", "target_uri", "date", "http_headers", "payload", "payload_digest", "block_digest", "source_digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derivatives(responses(table(spark, sf_dir, "pages")))
    return out.select(F.col("key").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest")


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    for pattern, to in [*CONVERSION, (r" *\n[ \n]*", "\n")]:
        text = f"regexp_replace({text}, {q(pattern.replace('++', '+').replace('*+', '*').replace(chr(92) + 'Z', chr(92) + 'z'))}, {q(to)}, 'g')"
    for name, to in REFERENCES:
        text = f"replace({text}, {q(name)}, {q(to)})"
    cut = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"
    return f"""
WITH pages_ AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\\t\\r\\n]', '', 'g') AS target_uri, coalesce(html, '') AS payload FROM pages),
source AS (SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(payload)) AS head,
  md5(coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || target_uri || chr(10) || 'sha256:' || sha256(payload) || chr(10) || 'response') AS h FROM pages_),
response AS (SELECT *, {cut('h')} AS refers_to, 'sha256:' || sha256(payload) AS source_digest,
  'sha256:' || sha256(head || chr(13) || chr(10) || chr(13) || chr(10) || payload) AS source_block FROM source),
made AS (
  SELECT page_id, target_uri, refers_to, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-digest: ' || source_digest || chr(13) || chr(10) || 'source-block-digest: ' || source_block || chr(13) || chr(10) || 'source-length: ' || octet_length(encode(payload)) || chr(13) || chr(10)
    || 'source-http: ' || replace(head, chr(13) || chr(10), chr(13) || chr(10) || ' ') || chr(13) || chr(10) AS block FROM response
  UNION ALL
  SELECT page_id, target_uri, refers_to, source_digest, 'conversion', 'text/plain; charset=utf-8', trim({text}, ' ' || chr(10)) FROM response),
named AS (SELECT *, md5(refers_to || chr(10) || record_type) AS h FROM made)
SELECT page_id, record_type, {cut('h')} AS record_id, refers_to, target_uri, content_type, CAST(octet_length(encode(block)) AS BIGINT) AS content_length,
  'sha256:' || sha256(block) AS block_digest, source_digest FROM named
"""


# The references that the SQL decodes; other ones don't occur in the test tables.
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
ORACLE = oracle()
