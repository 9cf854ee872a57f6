"""Ordered operators, traces, replay, custody and streams against brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilog.operators import custody, graph, ordered, replay, scoring


def test_ordered_operators_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), s, rnd.choice([None, None, s])) for s in rnd.sample(range(1, 400), 200)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint")
    indexed = {(r.k, r.seq): r.n for r in ordered.row_index(df, ["k"], ordered.seq_bucket(F.col("seq"), 16), ["seq"], "n").collect()}
    carried = {(r.k, r.seq): r.c for r in ordered.carry_last(df, ["k"], "seq", F.col("v"), "c", width=16).collect()}
    before = {(r.k, r.seq): r.c for r in ordered.previous_row(df, ["k"], "seq", F.col("seq"), "c", width=16).collect()}
    for key in "abc":
        mine = sorted(r for r in rows if r[0] == key)
        last = prev = None
        for n, (k, seq, v) in enumerate(mine, 1):
            last = v if v is not None else last
            assert indexed[k, seq] == n and carried[k, seq] == last and before[k, seq] == prev
            prev = seq


def test_layers_with_and_without_cycles(spark):
    nodes = spark.createDataFrame([("s", x) for x in "abcdef"], "session_id string, id string")
    edges = spark.createDataFrame([("s", *e) for e in ["ab", "bc", "ac", "de", "ed", "cf"]], "session_id string, src string, dst string")
    assert {r.id: r.layer for r in graph.layers(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0, "f": 3}


def test_replay(spark):
    patch = lambda old, new: "@@ -1,1 +1,1 @@\n-" + old + "\n+" + new
    rows = [("s", "p", 1, "body", "a\nb", False), ("s", "p", 2, "patch", patch("b", "c"), False), ("s", "p", 3, "patch", patch("zz", "y"), False),
            ("s", "p", 4, "patch", patch("a", "x"), False), ("s", "p", 5, "body", "new", False), ("s", "q", 1, "patch", patch("k", "l"), False)]
    df = spark.createDataFrame(rows, "session_id string, path string, seq bigint, kind string, content string, redacted boolean")
    out = {(r.path, r.seq): (r.content, r.confidence) for r in replay.reconstruct(df).collect()}
    assert out["p", 1] == ("a\nb", "exact") and out["p", 2] == ("a\nc", "replayed") and out["p", 3] == ("a\nc", "partial")
    assert out["p", 4][1] == "partial" and out["p", 5] == ("new", "exact") and out["q", 1][1] == "unavailable"
    base = spark.createDataFrame([("s", "q", "k")], "session_id string, path string, content string")
    assert {(r.path, r.seq): r.content for r in replay.reconstruct(df, base).collect()}["q", 1] == "l"
    assert tuple(spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd")], "o string, n string").select(replay.line_diffstat("o", "n").alias("d")).first().d) == (2, 1)


def test_tamper_ladder(spark):
    columns = ["seq", "x"]
    rows = custody.with_row_hash(spark.range(1, 11).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("x")), columns, "hash")
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("prev_hash"))
    chain = rows.join(before, "seq", "left").fillna({"prev_hash": "sha256:" + "0" * 64}).cache()
    check = lambda df: custody.first_break(custody.chain_breaks(df, custody.sha256_text(custody.canonical_json(columns)))).collect()
    assert check(chain) == []
    assert tuple(check(chain.withColumn("x", F.when(F.col("seq") == 4, "!").otherwise(F.col("x"))))[0]) == (4, "content-tampered")
    assert tuple(check(chain.filter("seq <> 6"))[0]) == (7, "bad-sequence")
    assert tuple(check(chain.withColumn("prev_hash", F.when(F.col("seq") == 3, "no").otherwise(F.col("prev_hash"))))[0]) == (3, "broken-link")


def test_policies(spark):
    from vigilog.sources.files import policies
    docs = [("ok", '{"version":1,"expected":[{"id":"a","reason":"r","hosts":["h"]}]}'), ("v", '{"version":2,"expected":[]}'), ("dup", '{"version":1,"expected":[{"id":"a","reason":"r","hosts":["h"]},{"id":"a","reason":"r","hosts":["h"]}]}'),
            ("key", '{"version":1,"expected":[],"x":1}'), ("none", '{"version":1,"expected":[{"id":"a","reason":"r"}]}'), ("json", "{"), ("field", '{"version":1,"expected":[{"id":"a","reason":"r","hosts":["h"],"z":1}]}')]
    out = {r.name: r.error for r in policies(spark.createDataFrame(docs, "name string, value string")).collect()}
    assert out["ok"] is None and all(out[n] for n in ("v", "dup", "key", "none", "json", "field"))


def test_stream_scoring_equals_batch(spark, sf, tmp_path):
    from vigilog.plans.activity_queries import Activity
    from vigilog.streaming.live import live_combos
    a = Activity(spark, sf)
    folder = str(tmp_path / "events")
    for part in range(2):  # two arrivals, split by position
        a.events.filter((F.col("seq") > 8) if part else (F.col("seq") <= 8)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(a.events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    q = live_combos(stream).writeStream.format("memory").queryName("fired").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = ["session_id", "combo", "severity", "antecedent_seq", "consequent_seq"]
    assert sorted(spark.table("fired").select(*key).collect()) == sorted(a.combos.select(*key).collect())


def test_live_pairs_expire(spark, tmp_path):
    from vigilog.streaming.live import live_pairs
    rows = [("s", "t", "i", "before", 0.0, 1), ("s", "t", "i", "before", 10.0, 2), ("s", "t", "i", "after", 20.0, 3), ("s", "t", "i", "after", 5000.0, 4)]
    schema = "session_id string, tool_name string, input string, stage string, at double, pos bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "c"))
    q = live_pairs(spark.readStream.schema(schema).parquet(str(tmp_path / "c"))).writeStream.format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.after_pos, r.before_pos) for r in spark.table("pairs").collect()) == [(3, 1), (4, None)]


def test_live_lines_and_tables(spark, tmp_path):
    from vigilog.sources import tables
    from vigilog.streaming.live import write_live
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"hook_event_name":"PreToolUse","session_id":"s","tool_name":"Bash","tool_input":{"command":"ls"}}\n\nnot json\n[1]\n')
    q = write_live(spark.readStream.text(str(tmp_path / "in")), "2024-01-01T00:00:00.000Z", str(tmp_path / "e"), str(tmp_path / "r"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1 and spark.read.parquet(str(tmp_path / "r")).count() == 2
    tables.append_events(spark.read.parquet(str(tmp_path / "e")), str(tmp_path / "t"))
    assert tables.read_events(spark, str(tmp_path / "t")).first().target == "ls"


def test_unknown_ruleset_is_an_error():
    with pytest.raises(ValueError):
        scoring.check_rulesets(["r9"])


def test_first_facts_are_kept_for_good_and_late_ones_count(spark, tmp_path):
    from vigilog.streaming.live import first_facts
    folder = f"{tmp_path}/facts"
    batches = [[("a", "x", "2024-01-05 00:00:00")], [("a", "x", "2024-01-09 00:00:00"), ("b", "x", "2024-01-09 00:00:00")],
               [("a", "x", "2024-01-20 00:00:00"), ("c", "y", "2024-01-01 00:00:00")], [("c", "y", "2024-01-01 00:00:00"), ("a", "x", "2024-01-01 00:00:00")]]
    schema = "session_id string, event_type string, at timestamp"
    out = []
    for rows in batches:
        df = spark.createDataFrame(rows, "session_id string, event_type string, at string").selectExpr("session_id", "event_type", "cast(at as timestamp) at")
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = first_facts(spark.readStream.schema(schema).parquet(folder), ["session_id", "event_type"])
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
        q.awaitTermination()
        out = sorted((r["session_id"], r["event_type"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == [("a", "x"), ("b", "x"), ("c", "y")]
