"""Derivatives of WARC response records: linked metadata and plain-text conversion records.

Each response yields one metadata record (application/warc-fields: the source's digests, HTTP status and headers, title, language,
outgoing links) and one conversion record (text/plain: the text of all blocks). Both name the response in WARC-Refers-To, with its
target, date and payload digest. Record ids are made from the response's id, so a rerun gives the same ids.

Defined cases: a null payload counts as empty: its conversion record has an empty block. Missing headers or digests are left out
of the metadata (a missing payload digest is computed). A response without an id or target still yields both records. Repeated
rows yield repeated records. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes
from .html_text import ATTRIBUTE, blocks, tokens

RECORD = ("response_row long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string,"
          " payload_digest string, block_digest string, source_headers string, content_length long, block string")
LANG = re.compile(r"[\w-]+")


def facts(page: str) -> tuple[str | None, str | None, list[str]]:
    """Title, language and link targets, from one walk over the page's tags: time is linear in the page, closed tags or not."""
    title, language, links = None, None, []
    for m, _, content in tokens(page):
        if title is None and content is not None and m["raw"].lower() == "title":
            title = " ".join(html.unescape(content).split())
        tag = (m["tag"] or "").lower()
        if m["end"] or not m["attr"] or tag not in ("html", "a"):
            continue
        for a in ATTRIBUTE.finditer(m["attr"]):
            value = a[2] or a[3] or a[4]
            if tag == "a" and a[1].lower() == "href":
                links.append(" ".join(html.unescape(value or "").split()))
                break
            if tag == "html" and a[1].lower() == "lang" and language is None and value and (word := LANG.match(value)):
                language = word[0]
    return title, language, links


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def digest_column(payload: Column) -> Column:
    """The same digest with DataFrame functions: five hex digits are four letters of base 32."""
    hexed = F.sha1(payload.cast("binary"))
    letters = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.upper(F.concat(*letters)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records for a table of pages: row, record_id, target_uri, warc_date, http_headers, payload, payload_digest."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    key = F.md5(F.concat_ws("\n", F.col(id_col).cast("string"), F.col(url_col), payload))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    return pages.select(
        F.col(id_col).cast("long").alias("row"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), payload.alias("payload"),
        digest_column(payload).alias("payload_digest"))


def _derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"


def derive_one(record_id: str | None, target: str | None, date: str | None, headers: str | None, payload: str | None, payload_digest: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    page = payload or ""
    source = payload_digest or digest(page.encode("utf-8", "replace"))
    lines = (headers or "").replace("\r\n", "\n").strip("\n").split("\n") if headers else []
    fields = [("source-record-id", record_id), ("source-payload-digest", source)]
    if headers:
        fields.append(("source-block-digest", digest((headers + "\r\n" + page).encode("utf-8", "replace"))))
    for k, line in enumerate(lines):
        fields.append(("source-http-status" if not k and line.startswith("HTTP/") else "source-http-header", line))
    title, language, links = facts(page)
    fields += [("title", title), ("language", language), *(("outlink", x) for x in links)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    text = "\n".join(b.text for b in blocks(page))
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain", text)):
        data = block.encode("utf-8", "replace")
        out.append((kind, _derived_id(f"{record_id} {target}" if record_id is None else record_id, kind), record_id, target, date, content_type, source, digest(data), headers, len(data), block))
    return out


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(",")]
    for batch in batches:
        for a, n in by_bytes(batch.column(5), 8 << 20):
            rows = [(r["row"], *x) for r in batch.slice(a, n).to_pylist()
                    for x in derive_one(r["record_id"], r["target_uri"], r["warc_date"], r["http_headers"], r["payload"], r["payload_digest"])]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("response_row", "content_length") else pa.string()) for n, c in zip(names, columns)], names)


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response, with RECORD's columns."""
    need = ["row", "record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest"]
    return responses.select(*need).mapInArrow(_derive, RECORD)


def record_text(records: DataFrame) -> Column:
    """A record as it stands in a WARC file, without the last line feed."""
    def line(name: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")

    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"),
        line("WARC-Date", "warc_date"), line("WARC-Block-Digest", "block_digest"), line("WARC-Source-Payload-Digest", "payload_digest"), line("Content-Type", "content_type"),
        line("Content-Length", "content_length"), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r"))


def write_warc(records: DataFrame, path: str) -> None:
    """Compressed WARC files, one for each task, by Spark's own committer."""
    records.select(record_text(records).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; gzip members are read one after the other."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: headers (map, names in lower case) and block (bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for fields, block in parse_warc(data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], ["headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "headers map<string,string>, block binary")
