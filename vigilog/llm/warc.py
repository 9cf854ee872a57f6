"""WARC archives: written from pages, read back, and assembled to one nested row per capture.

Writing: every page becomes a transaction of three records, a request, a response
and its metadata, tied together by WARC-Concurrent-To. Of pages with equal
payloads the one with the smallest id is the response; the others are revisits, which
name it in WARC-Refers-To and hold no payload. Records are built by column
expressions and written by Spark's text writer, whose line end is the end of a
record, to gzip files on any file system that Spark reaches. Record ids are hashes of what
a record is about, so a task that runs again writes the same ids.

Reading: every file is streamed record by record by the lengths in its headers
(gzip in one or many members, or plain), so record marks inside payloads do no harm. A file of more
than 2 GB is beyond the reader; the writer starts a new one after about FILE_BYTES of payloads.
What stands between records is skipped up to the next version line. A block that ends early is kept and marked.

Assembly: responses, revisits and resources are anchors. A record that names an anchor in
WARC-Concurrent-To, or is named by one, belongs to it (of several to the one with the smallest id); a record
that is tied to those alone that belong somewhere follows them, in waves until no tie is left. A
record that reaches no anchor is a row of its own, without a response. A record that stands in the archives
twice is there twice in its list, or, an anchor, a row twice. Revisits are then
joined to the captures that they refer to, for the facts of the whole payload.

Null html is an empty payload, null urls have no target, null ids sort last and refer to nothing.
Rows with equal id, url and payload are one capture that counts its copies and are answered as
many times. Rows with one id and different payloads or urls are captures of their own. Line breaks in urls are written
percent-encoded. An empty table gives empty results. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm.common import saved, small_batches
from vigilog.session import shared_folder

#: The version line, the profile of revisits, and the least payload that is told by a revisit.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 0
#: Payload bytes of a file, about.
FILE_BYTES = 32 << 20
#: Date of captures whose table has none.
DATE = "1970-01-01T00:00:00Z"
ANCHORS = ("response", "revisit", "resource")

_END = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of bytes in upper-case base 32: each ten hexadecimal digits are eight of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in range(1, 41, 10)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _BASE32)


def _record_id(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), digest, F.coalesce(url, F.lit("-"))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; those whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(_END)) for name, value in pairs]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in lines])


def _record(kind: Column, record_id: Column, url: Column, date: str, block: Column, content: str, *more: tuple[str, Column]) -> Column:
    head = _headers(("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", url), *more,
                    ("Content-Type", content), ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit(VERSION + _END), head, F.lit(_END), block)


def _keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    target = F.replace(F.replace(F.col(f"`{url}`").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), target.alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))


def decisions(keyed: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """Saved `of_id`, `of_digest`, `first_id`, `first_url` of pages that revisit an earlier payload; saved captures that stand there more than once; mean bytes."""
    narrow = saved(keyed.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-pages")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    first = narrow.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    later = narrow.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    later = saved(later.select(F.col("page_id").alias("of_id"), F.col("digest").alias("of_digest"), "first_id", "first_url").distinct(), "warc-revisits")
    again = narrow.groupBy("page_id", "url", "digest").agg(F.count("*").alias("copies")).where("copies > 1")
    again = saved(again.select(F.col("page_id").alias("in_id"), F.col("url").alias("in_url"), F.col("digest").alias("in_digest"), "copies"), "warc-copies")
    return later, again, int(narrow.agg(F.avg("bytes")).first()[0] or 0)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Archives of all pages in the new folder `path`."""
    keyed = _keyed(pages, page_id, url, html)
    later, again, mean = decisions(keyed, min_bytes)
    rows = keyed.withColumn("copies", F.lit(1).cast("long"))
    if not again.isEmpty():
        same = F.col("page_id").eqNullSafe(F.col("in_id")) & F.col("url").eqNullSafe(F.col("in_url")) & (F.col("digest") == F.col("in_digest"))
        once = keyed.join(again, same).select(*keyed.columns, "copies").dropDuplicates(["page_id", "url", "digest"])
        rows = keyed.join(again, same, "left_anti").select(*keyed.columns, F.lit(1).cast("long").alias("copies")).unionAll(once)
    # By id and digest, so that a frequent payload does not meet in one task.
    rows = rows.join(later, F.col("page_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    revisit = F.col("of_digest").isNotNull()
    number, own, target, key = F.col("copies").cast("string"), F.col("page_id"), F.col("url"), F.col("digest")
    anchor, size = _record_id("response", own, target, key), F.octet_length("payload").cast("string")
    host = F.regexp_extract(F.coalesce(target, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1)
    asked = F.regexp_replace(F.regexp_replace(F.coalesce(target, F.lit("")), r"^[^:/?#]+://[^/?#]*|#.*$", ""), r"^(?!/)", "/")
    request = F.concat(F.lit("GET "), asked, F.lit(" HTTP/1.1" + _END), _headers(("Host", host)), F.lit(_END))
    answer = F.concat(F.lit("HTTP/1.1 200 OK" + _END), _headers(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)), F.lit(_END))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    tie = ("WARC-Concurrent-To", anchor)
    records = F.array(
        _record(F.lit("request"), _record_id("request", own, target, key), target, date, request, "application/http; msgtype=request", tie),
        _record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), anchor, target, date, F.concat(answer, body), "application/http; msgtype=response",
                ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
                ("WARC-Refers-To", F.when(revisit, _record_id("response", F.col("first_id"), F.col("first_url"), key))),
                ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_url")))),
        _record(F.lit("metadata"), _record_id("metadata", own, target, key), target, date,
                _headers(("pageId", own.cast("string")), ("copies", number)), "application/warc-fields", tie))
    per_file = 3 * max(1, FILE_BYTES // max(1, mean))
    rows.select(F.explode(records).alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parsed(stream: BinaryIO) -> Iterator[tuple[dict[str, list[str]], bytes, bool]]:
    """Headers (names in lower case), block and whether it ends early, of each record in a stream."""
    line = stream.readline()
    while line:
        if not line.startswith(b"WARC/"):
            line = stream.readline()
            continue
        headers: dict[str, list[str]] = {}
        last = None
        while (line := stream.readline()).strip(b"\r\n"):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and last is not None:  # a folded line
                headers[last][-1] += " " + text.strip()
            elif ":" in text:
                name, value = text.split(":", 1)
                last = name.strip().lower()
                headers.setdefault(last, []).append(value.strip())
        size = headers.get("content-length", ["x"])[0]
        if size.isdigit():
            block = stream.read(int(size))
            yield headers, block, len(block) < int(size)
        line = stream.readline()


def _plain(content: bytes) -> BinaryIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def fields(text: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in text.decode("utf-8", "replace").splitlines() if ":" in line)
    return {a.strip(): b.strip() for a, b in pairs}


RECORD = ("record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, declared_digest string, "
          "content_type string, http_status int, http_fields map<string,string>, fields map<string,string>, payload_bytes long, payload_digest string, "
          "truncated boolean, file string")


def _row(headers: dict[str, list[str]], block: bytes, short: bool, file: str, payloads: bool) -> tuple:
    one = lambda name: headers.get(name, [None])[0]
    kind, content = (one("warc-type") or "").lower(), one("content-type") or ""
    status, http, payload, own = None, {}, block, {}
    if content.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        first, _, rest = head.partition(b"\r\n")
        words = first.split()
        status = int(words[1]) if len(words) > 1 and words[0].startswith(b"HTTP/") and words[1].isdigit() and len(words[1]) < 6 else None
        http = fields(rest)
    elif content.startswith("application/warc-fields"):
        own = fields(block)
    row = (one("warc-record-id"), kind, one("warc-date"), one("warc-target-uri"), headers.get("warc-concurrent-to", []), one("warc-refers-to"),
           one("warc-payload-digest"), content or None, status, http, own, len(payload),
           base64.b32encode(hashlib.sha1(payload).digest()).decode(), short, file)
    return (*row, payload) if payloads else row


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under `path`; with `payloads` also their payloads as bytes."""
    small_batches(spark)
    schema = RECORD + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                held, size = [], 0
                for headers, block, short in parsed(_plain(content)):
                    held.append(_row(headers, block, short, file, payloads))
                    size += len(block)
                    if len(held) == 3000 or size > FILE_BYTES:
                        yield pd.DataFrame(held, columns=names).astype({"http_status": "Int32"})
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names).astype({"http_status": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def belongs(rows: DataFrame) -> DataFrame:
    """`member` and `anchor` ids of the records that reach an anchor; `rows` are saved records."""
    anchor = F.col("type").isin(*ANCHORS)
    ties = rows.select("record_id", anchor.alias("fixed"), F.explode("concurrent_to").alias("to"))
    anchors = rows.where(anchor).select(F.col("record_id").alias("anchor")).distinct()
    # As nearly all archives have it: the record names its anchor.
    found = ties.where("not fixed").join(anchors, F.col("to") == F.col("anchor")).groupBy(F.col("record_id").alias("member")).agg(F.min("anchor").alias("anchor"))
    found = saved(found, "warc-ties")
    left = rows.where(~anchor).select(F.col("record_id").alias("u")).distinct().join(found, F.col("u") == F.col("member"), "left_anti")
    left = saved(left, "warc-loose")
    if left.isEmpty():
        return found
    both = ties.select(F.col("record_id").alias("a"), F.col("to").alias("b"))
    both = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = saved(both.join(left, F.col("a") == F.col("u"), "left_semi"), "warc-ties")
    front = found.select("member", "anchor").unionAll(anchors.select(F.col("anchor").alias("member"), "anchor"))
    while True:
        # The next wave: loose records tied to one of the last.
        wave = edges.join(front, F.col("b") == F.col("member")).groupBy(F.col("a").alias("member")).agg(F.min("anchor").alias("anchor"))
        front = saved(wave, "warc-wave")
        if front.isEmpty():
            return found
        found = found.unionAll(front)
        edges = saved(edges.join(front, F.col("a") == F.col("member"), "left_anti"), "warc-ties")


def captures(rows: DataFrame) -> DataFrame:
    """One nested row per capture: `capture_id`, `response` (the anchor's record), `requests` and `metadata` (lists of records by id)."""
    names = [c for c in rows.columns if c not in ("payload", "concurrent_to")]
    whole = [c for c in rows.columns if c != "concurrent_to"]
    anchor = F.col("type").isin(*ANCHORS)
    tied = belongs(rows)
    parts = rows.where(~anchor).join(tied, F.col("record_id") == F.col("member"), "left")
    parts = parts.select(F.coalesce("anchor", "record_id").alias("capture_id"), "type", F.struct(*names).alias("part"))
    lists = parts.groupBy("capture_id").agg(
        F.collect_list(F.when(F.col("type") == "request", F.col("part"))).alias("requests"),
        F.collect_list(F.when(F.col("type") != "request", F.col("part"))).alias("metadata"))
    by_id = lambda c: F.array_sort(c, lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0))
    lists = lists.select("capture_id", by_id(F.col("requests")).alias("requests"), by_id(F.col("metadata")).alias("metadata"))
    anchors = rows.where(anchor).select(F.col("record_id").alias("anchor_id"), F.struct(*whole).alias("response"))
    out = anchors.join(lists, F.col("anchor_id") == F.col("capture_id"), "full")
    none = F.array().cast(lists.schema["requests"].dataType)
    return out.select(F.coalesce("anchor_id", "capture_id").alias("capture_id"), "response",
                      F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def resolved(assembled: DataFrame) -> DataFrame:
    """Saved captures with `original`: the id, payload facts and metadata of the capture that a revisit refers to; null for others."""
    revisits = assembled.where(F.col("response.type") == "revisit")
    wanted = revisits.select(F.col("response.refers_to").alias("wanted")).where("wanted is not null").distinct()
    facts = F.struct("capture_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
                     F.col("metadata.fields").alias("fields"))
    # Few against all: each is wanted once here, however many revisits refer to it. A frequent one is split by Spark in the join that follows.
    originals = assembled.where(F.col("response").isNotNull()).select(F.col("capture_id").alias("original_id"), facts.alias("original"))
    originals = originals.join(wanted, F.col("original_id") == F.col("wanted"), "left_semi").groupBy("original_id").agg(F.first("original").alias("original"))
    originals = saved(originals, "warc-originals")
    refers = F.when(F.col("response.type") == "revisit", F.col("response.refers_to"))
    return assembled.withColumn("refers", refers).join(originals, F.col("refers") == F.col("original_id"), "left").drop("refers", "original_id")


def _field(metadata: Column, name: str) -> Column:
    """The first value of a named field in a list of metadata fields."""
    found = F.filter(F.transform(metadata, lambda m: F.element_at(m, F.lit(name))), lambda v: v.isNotNull())
    return F.get(found, F.lit(0)).cast("long")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages written to archives, read back and assembled: `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`, `capture_id`, per page."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, page_id, url, html, min_bytes)
    rows = saved(records(spark, path, payloads=False), "warc-records")
    full = resolved(saved(captures(rows), "warc-captures"))
    own, first = F.col("metadata.fields"), F.col("original.fields")
    revisit = F.col("response.type") == "revisit"
    out = full.select(
        _field(own, "pageId").alias("page_id"),
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original.payload_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(revisit, _field(first, "pageId")).alias("refers_to"), "capture_id",
        F.coalesce(_field(own, "copies"), F.lit(1)).alias("copies"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")
