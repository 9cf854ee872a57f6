"""Archives written, read and assembled: exact round trips, ties of all shapes, damaged files."""

import base64
import gzip
import hashlib
import io

from pyspark.sql import functions as F

from vigilog.llm import warc
from vigilog.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, payload string, digest string, copies long, type string, anchor string"
SPOOF = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, "http://a.example/x?y#z", "<p>one</p>"), (2, "http://b.example", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://c.example/", None),
    (5, "http://c.example/", ""), (6, "no scheme", SPOOF * 3), (7, "http://d.example/\r\nWARC-Type: metadata", "é \U0001f642 \x00 \r\n\r\n" * 5),
    (8, "http://e.example/", "x" * 2_000_000), (9, "http://e.example/", "y"), (9, "http://e.example/", "y"), (10, "http://f.example/", "y"),
    (None, "http://g.example/", "y"), (None, None, "only here"), (11, "http://h.example/", "z"), (11, "http://i.example/", "z"), (11, "http://h.example/", "w"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 7, "c", "d") for r in rows], SCHEMA)


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        n, lead = len(body), first.get(html or "")
        again = n >= least and i != lead
        out.append((i, n, base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=str)


def answers(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert answers(QUERIES["op13_warc_transactions"](spark, sf)) == brute(rows)


def test_odd_rows(spark):
    assert answers(warc.round_trip(pages(spark, ROWS))) == brute(ROWS)
    assert answers(warc.round_trip(pages(spark, ROWS), min_bytes=5)) == brute(ROWS, 5)
    assert answers(warc.round_trip(pages(spark, []))) == []
    alone = [(None, "u", "same"), (None, None, "same")]
    assert [r[3:] for r in answers(warc.round_trip(pages(spark, alone)))] == [("response", None)] * 2


def test_archives_hold_whole_payloads(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(pages(spark, ROWS), path)
    rows = warc.records(spark, path)
    ids = [r[0] for r in rows.select("record_id").collect()]
    assert len(ids) == len(set(ids)) == 3 * (len(ROWS) - 1)
    full = warc.captures(rows.cache())
    assert full.where("size(requests) <> 1 or size(metadata) <> 1 or response is null").isEmpty()
    got = full.where("response.type = 'response'").select(
        F.element_at(F.col("metadata")[0]["fields"], "pageId").cast("long").alias("i"), "response.*").collect()
    bodies = {(i, (html or "").encode()) for i, _, html in ROWS}
    assert {(r["i"], bytes(r["payload"])) for r in got} <= bodies
    assert {bytes(r["payload"]) for r in got} == {b for _, b in bodies}
    for r in got:
        assert r["declared_digest"] == "sha1:" + r["payload_digest"] and int(r["http_fields"]["Content-Length"]) == r["payload_bytes"] and r["http_status"] == 200
        assert not r["truncated"]
    again = full.where("response.type = 'revisit'").select("response.*").collect()
    assert all(r["payload_bytes"] == 0 and r["refers_to"] in {x["record_id"] for x in got} for r in again) and again
    asked = {r[0] for r in full.select(F.col("requests")[0]["target_uri"]).collect()}
    assert "http://d.example/%0D%0AWARC-Type: metadata" in asked


def record(kind, own, ties=(), block=b"", extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{own}>\r\n" + "".join(f"WARC-Concurrent-To: <{t}>\r\n" for t in ties) + extra
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_streams_of_other_writers(spark, tmp_path):
    a, b = record("response", "a", block=SPOOF.encode()), record("metadata", "b", ["a", "x"], b"k: v", "content-type: application/warc-fields\r\nX-Long: one\r\n two\r\n")
    for data in (a + b, b"\r\n\r\n" + a + b"noise\r\n" + b):
        got = list(warc.parsed(io.BytesIO(data)))
        assert [g[0]["warc-record-id"] for g in got] == [["<a>"], ["<b>"]] and got[0][1] == SPOOF.encode() and got[1][0]["x-long"] == ["one two"]
    cut = list(warc.parsed(io.BytesIO((a + b)[:-8])))
    assert [g[2] for g in cut] == [False, True] and cut[1][1] == b""
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    (tmp_path / "w" / "two.warc").write_bytes(record("warcinfo", "i") + record("request", "r", ["a"]) + b"WARC/1.0\r\nContent-Length: huge\r\n\r\n")
    rows = warc.records(spark, str(tmp_path / "w")).cache()
    assert {(r["record_id"], r["type"], bytes(r["payload"])) for r in rows.collect()} == {
        ("<a>", "response", SPOOF.encode()), ("<b>", "metadata", b"k: v"), ("<i>", "warcinfo", b""), ("<r>", "request", b"")}
    got = {r["capture_id"]: r for r in warc.captures(rows).collect()}
    assert set(got) == {"<a>", "<i>"} and got["<i>"]["response"] is None
    assert [m["fields"] for m in got["<a>"]["metadata"]] == [{"k": "v"}] and [q["record_id"] for q in got["<a>"]["requests"]] == ["<r>"]


def test_ties_of_all_shapes(spark, tmp_path):
    (tmp_path / "w").mkdir()
    parts = [
        record("response", "a1", ["q1"]), record("request", "q1"), record("metadata", "m1", ["q1"]), record("metadata", "m2", ["m1"]), record("metadata", "m3", ["m2"]),
        record("response", "a2"), record("resource", "a3", ["a2"]), record("request", "q2", ["a3", "a2"]),
        record("request", "q9", ["m9"]), record("metadata", "m9", ["q9"]), record("metadata", "m8", ["nowhere"]), record("metadata", "m8", ["nowhere"]),
    ]
    (tmp_path / "w" / "x.warc").write_bytes(b"".join(parts))
    rows = warc.records(spark, str(tmp_path / "w"), payloads=False).cache()
    got = {r["capture_id"]: ([x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]], r["response"] is not None)
           for r in warc.captures(rows).collect()}
    assert got == {"<a1>": (["<q1>"], ["<m1>", "<m2>", "<m3>"], True), "<a2>": (["<q2>"], [], True), "<a3>": ([], [], True),
                   "<q9>": (["<q9>"], [], False), "<m9>": ([], ["<m9>"], False), "<m8>": ([], ["<m8>", "<m8>"], False)}
