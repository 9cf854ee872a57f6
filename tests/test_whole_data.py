"""No caps, no lost rows: long inputs, arrival orders, round trips and nested values."""

import json
import random
from collections import deque

import pandas as pd
from pyspark.sql import functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions import hashing
from vigilog.functions.predicates import rm_is_catastrophic
from vigilog.functions.redaction import redact_text
from vigilog.operators import graph, report, search
from vigilog.sources import files, hooks, tables


def test_long_commands_and_secrets_are_seen_whole(spark):
    long = "rm -rf " + "x " * 10_001
    rows = [(long + "/etc",), ("rm -rf x /etc",), (long + "y",), ("rm x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(rm_is_catastrophic(F.col("c"))).collect()]
    assert got == [True, True, False, False]
    secret = "s" * 9000
    df = spark.createDataFrame([(f"curl -u me:{secret} https://x",), (f"https://me:{secret}@h/p",), (f"Authorization: Bearer {secret}",)], "t string")
    assert all("ss" not in r["redacted"] for r in redact_text(df, "t").collect())


def test_payload_texts_are_redacted_and_kept_whole(spark):
    command = "echo " + "z" * 700 + " && cat .env"
    body = {"hook_event_name": "PreToolUse", "session_id": "s", "tool_name": "Bash", "tool_input": {"command": command, "description": "use DB_PASSWORD=hunter2secret now"}}
    out = hooks.normalise(hooks.first_vendor(hooks.good(hooks.parse(spark.createDataFrame([(json.dumps(body),)], "value string")))), "2024-01-01T00:00:00.000Z")
    row = out.first()
    assert "hunter2secret" not in row["detail"] and row["redaction_count"] == 1 and row["target"] == command
    assert len(hooks.displayed(out).first()["target"]) == V.MAX_TARGET + 1


def test_canonical_json_leaves_null_fields_out(spark):
    cases = {'{"a":1,"b":null}': '{"a":1}', '{"a":null,"b":null}': "{}", '{"a":[null,{"x":null}],"s":"k\\":null,"}': '{"a":[null,{}],"s":"k\\":null,"}', '{"a\\"b":null,"c":{"d":null,"e":"\\\\"}}': '{"c":{"e":"\\\\"}}'}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select(hashing.without_nulls(F.to_json(F.parse_json("v"))).alias("j"))
    assert [r["j"] for r in df.collect()] == list(cases.values())


def fifo(rows, ttl):
    out, waiting = [], {}
    for s, t, i, stage, at, pos in sorted(rows, key=lambda r: r[5]):
        q = waiting.setdefault((s, t, i), deque())
        while q and q[0][1] < at - ttl:
            q.popleft()
        if stage == "before":
            q.append((pos, at))
        else:
            out.append((s, pos, q.popleft()[0] if q else None))
    return sorted(out, key=str)


def test_keyless_pairs_match_a_queue(spark):
    rnd, at, rows = random.Random(8), 0.0, []
    for pos in range(1, 600):
        at += rnd.choice([1.0, 60.0, 900.0, 2500.0])
        rows.append((rnd.choice("ab"), "t", rnd.choice("xy"), rnd.choice(["before", "before", "after"]), at, pos))
    df = spark.createDataFrame(rows, "session_id string, tool_name string, input string, stage string, at double, pos bigint")
    got = hooks.pair_without_ids(df.repartition(5)).select("session_id", "after_pos", "before_pos").collect()
    assert sorted(map(tuple, got), key=str) == fifo(rows, V.PENDING_TTL_SECONDS)


def test_stream_state_does_not_depend_on_arrow_batches():
    from vigilog.streaming import live

    class State:
        exists = False

        def update(self, value):
            self.value = value

    rows = pd.DataFrame([("before", 1.0, 1), ("after", 2.0, 2), ("before", 3.0, 3), ("after", 4.0, 4)], columns=["stage", "at", "pos"])
    backwards = [rows.iloc[[k]] for k in (3, 1, 2, 0)]
    one = pd.concat(live._match(("s", "t", "i"), iter([rows]), State()))
    many = pd.concat(live._match(("s", "t", "i"), iter(backwards), State()))
    assert one.equals(many) and one["before_pos"].tolist() == [1, 3]


def test_layers_upsert_and_delete_in_place(spark, tmp_path):
    folder = str(tmp_path / "layer")
    rows = lambda text, sessions, sets=("r1", "r2"): spark.createDataFrame([(r, f"s{k}", text) for r in sets for k in sessions], "ruleset string, session_id string, verdict string")
    read = lambda: {(r.ruleset, r.session_id): r.verdict for r in spark.read.parquet(folder).collect()}
    tables.upsert_layer(rows("old", range(200)), folder)
    tables.upsert_layer(rows("new", range(195, 205), ("r2",)), folder)
    got = read()
    assert len(got) == 405 and {k for k, v in got.items() if v == "new"} == {("r2", f"s{k}") for k in range(195, 205)}
    tables.delete_from_layer(rows("", range(1, 205), ("r2",)), folder)
    assert {k for k in read() if k[0] == "r2"} == {("r2", "s0")} and len(read()) == 201
    tables.drop_ruleset(spark, folder, "r2")
    tables.replace_layer(rows("again", range(3), ("r1",)), folder)
    assert read() == {("r1", f"s{k}"): "again" for k in range(3)}


def test_manifests_tell_equal_lines_apart(spark):
    def manifest(lines):
        return report.manifests(spark.createDataFrame([("s", *x) for x in lines], "session_id string, section int, line bigint, text string")).first()["manifest"]

    base = [(1, k, "x") for k in range(600)]
    assert manifest(base + [(2, 0, "a"), (2, 0, "a")]) != manifest(base + [(2, 0, "b"), (2, 0, "b")])
    assert manifest(base) == manifest(base[::-1]) != manifest(base[:-1])


def test_deep_trees_and_chains_end(spark):
    chain = spark.createDataFrame([("s", f"n{k}", f"n{k + 1}") for k in range(30)], "session_id string, src string, dst string")
    nodes = spark.createDataFrame([("s", f"n{k}", k == 0) for k in range(31)], "session_id string, id string, risk boolean")
    assert graph.tainted(nodes, chain).count() == 31
    parents = spark.createDataFrame([(k, k - 1) for k in range(1, 40)], "pid bigint, ppid bigint")
    assert files.process_tree(parents, spark.createDataFrame([(0,)], "pid bigint")).count() == 40


def test_marks_fold_by_decomposition_and_terms_are_literal(spark):
    df = spark.createDataFrame([("Škoda Łódź Ấn a(b",)], "t string")
    assert df.select(search.tokens(F.col("t"))).first()[0] == ["skoda", "łodz", "an", "a", "b"]
    texts = spark.createDataFrame([("s", 1, "k", "t", "p", "see a(b now")], "session_id string, seq int, kind string, ts string, prompt_id string, text string")
    assert "a(b" in search.newest_hits(texts, texts.select("session_id", "seq"), ["a(b"]).first()["snippet"].replace("[", "").replace("]", "")


def test_lines_and_listings_are_not_cut(spark):
    sha = "a" * 40
    lines = spark.createDataFrame([("b", k, f"{sha} {'b' * 40} refs/heads/x{k}") for k in range(150)], "batch string, pos int, value string")
    assert files.ref_lines(lines).count() == 150 and files.ref_lines(lines, 100).count() == 100
    empty = spark.createDataFrame([], "session_id string, value string")
    loose = spark.createDataFrame([("s", f"f{k}") for k in range(700)], "session_id string, value string")
    assert files.worktree_delta(empty, empty, loose).count() == 700
    assert {r["truncated"] for r in files.worktree_delta(empty, empty, loose, 500).collect()} == {True}


def test_finding_keys_have_one_form_across_buckets(spark):
    from vigilog.operators.actions import seq_digest
    seqs = [10, 4095, 4097, 4095, 20_000]
    rows = spark.createDataFrame([("f", s) for s in seqs], "k string, seq bigint")
    assert seq_digest(rows, ["k"]).first().asDict() == {
        "k": "f", "seq_count": 4, "first_seq": 10, "last_seq": 20_000, "seq_text": "[10,4095,4097,20000]"}
