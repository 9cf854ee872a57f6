"""Plans and steps whose work must not grow faster than their input."""

import json

from pyspark.sql import functions as F

from vigilog.functions.payloads import redact_payloads
from vigilog.functions.redaction import redact_text, stages
from vigilog.operators import gitrefs as G


def test_a_payload_is_not_written_anew_for_every_rule(spark):
    rows = spark.createDataFrame([('{"tool_input":{"command":"ls"}}',)], "v string").select(F.parse_json("v").alias("p"))
    plan = redact_payloads(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project [") < len(stages())
    text = redact_text(spark.createDataFrame([("a",)], "t string"), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Project [") < len(stages())


def test_only_suspect_strings_change_and_keep_their_places(spark):
    payload = {"tool_input": {"a": "plain", "b": ["x", "password=hunter22 npm_" + "a" * 36, 'say "hi" \\'], "c": None}, "message": "ok", "n": 1}
    rows = spark.createDataFrame([(json.dumps(payload),)], "v string").select(F.parse_json("v").alias("p"))
    out = redact_payloads(rows).first()
    want = {**payload, "tool_input": {**payload["tool_input"], "b": ["x", "password=[REDACTED:assigned-secret] [REDACTED:npm-token]", 'say "hi" \\']}}
    assert json.loads(out["raw"]) == want
    assert [(h["type"], h["path"]) for h in out["hits"]] == [("npm-token", "tool_input.b[1]"), ("assigned-secret", "tool_input.b[1]")]


def test_payloads_are_read_once_and_secrets_behind_escapes_are_found(spark, monkeypatch):
    secrets = ["sk-ant-" + "a1" * 12, "password=hunter22", "npm_" + "b" * 36, "https://u:pw@h", "-u me:pass", "Authorization: Bearer abc", "Zx9" * 9, "plain"]
    texts = [before + s + after for s in secrets for before in ("", "\n", '"', "\\", "\t", "é", "\u0001", "x ") for after in ("", '"', "\\", "\n")]
    rows = spark.createDataFrame([(i, t, json.dumps({"tool_input": {"a": [1, [t]]}, "prompt": "ok"})) for i, t in enumerate(texts)], "i int, t string, v string")
    with monkeypatch.context() as m:
        # No pass over the payloads comes before the one that redacts them.
        m.setattr("pyspark.sql.classic.dataframe.DataFrame.first", lambda _: 1 / 0)
        made = redact_payloads(rows.withColumn("p", F.parse_json("v")), hits="h")
    alone = redact_text(made, "t", path="tool_input.a[1][0]")
    got = alone.select("raw", "redacted", "h", "hits").collect()
    assert all(json.loads(r["raw"]) == {"prompt": "ok", "tool_input": {"a": [1, [r["redacted"]]]}} and r["h"] == r["hits"] for r in got)
    assert sum(bool(r["h"]) for r in got) > len(texts) // 2


def _git(spark):
    updates = spark.createDataFrame([(1, "a", 20.0, "commit"), (2, "a", 35.0, "force"), (3, "a", 36.0, "commit"), (4, "b", 15.0, "other"), (5, "a", 29.0, "reset")],
                                    "id long, repo string, at double, kind string")
    events = spark.createDataFrame([
        ("a", "s1", "t1", "git commit -m x", 20.0), ("a", "s2", "t2", None, 21.0), ("a", "s1", "t3", "git push --force origin main", 34.0), ("b", "s3", "t4", "git commit -m y", 0.0),
        ("b", "s3", "t5", "git commit -m z", 0.001)], "repo string, session_id string, tool_use_id string, command string, at double")
    return updates, events


def test_attribution_at_the_borders_of_its_window(spark):
    got = {r["id"]: (r["confidence"], r["session_id"], r["tool_use_id"]) for r in G.attribute_updates(*_git(spark)).collect()}
    assert got == {1: ("exact", "s1", "t1"), 2: ("exact", "s1", "t3"), 3: ("session", "s1", None), 4: ("exact", "s3", "t5"), 5: ("ambiguous", "unknown", None)}
    pairs = sorted(map(tuple, G.attribution_candidates(*_git(spark)).collect()))
    assert pairs == [(1, "s1"), (2, "s1"), (2, "s2"), (3, "s1"), (4, "s3"), (5, "s1"), (5, "s2")]


def test_attribution_lays_no_pairs_out(spark):
    updates, events = _git(spark)
    plan = G.attribute_updates(updates, events)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice" in plan and not [x for x in plan.splitlines() if "Join" in x and "slice" in x]
    # Pairs of updates and sessions come straight from their join.
    plan = G.attribution_candidates(updates, events)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_a_walk_writes_each_row_once_and_passes_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vigilog.session.shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(G, "shared_folder", lambda _: str(tmp_path), raising=False)
    commits = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["b"]), ("m", ["c", "d"]), ("n", ["m"]), ("o", ["gone"])], "sha string, parents array<string>")
    pairs = [("n", "a"), ("n", "d"), ("a", "n"), ("m", "m"), ("o", "gone"), ("c", "d"), ("x", "a")]
    got = G.reached(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, start string, goal string"), commits)
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 3, 4]
    walk = [p for p in tmp_path.iterdir() if p.name.startswith("walk-")]
    rows = spark.read.parquet(str(walk[0])).select("id", "sha")
    assert rows.count() == rows.distinct().count()
    assert len(list(tmp_path.iterdir())) == 2  # parents, and the rows of all rounds


def test_gates_before_costly_rules_change_nothing(spark):
    """What is looked for first is in every text that the rule behind it finds."""
    import re

    from pyspark.sql import functions as F
    from vigilog.functions import predicates as P, redaction as R
    paths = [".env", ".env.local", "a/b.pem", "x.key", "id_rsa", "/h/.ssh/id", ".aws", "k/.gnupg/", "credentials", "credentials.json", "Secrets.yaml", ".npmrc", ".env.example", "environment", "main.ts"]
    rows = [(f"cat {a}{p}{b} | wc", p) for p in paths for a, b in (("", ""), ("'", "'"), ("@", ""))]
    got = spark.createDataFrame(rows, "command string, path string").select(
        "path", P.first_sensitive_token(F.col("command")).alias("found"), P.is_sensitive_path(F.col("path")).alias("is")).collect()
    assert len({r["path"] for r in got if r["is"]}) == 12 and all((r["found"] == r["path"]) == r["is"] and (r["found"] is None) != r["is"] for r in got)
    texts = ["see http://user:hunter2@h/x", "HTTPS://u:pw@h " + "x" * 3000, "a://b", "x" * 3000, None]
    out = R.redact_text(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select("t", "redacted").collect()
    assert [r["redacted"] != r["t"] for r in out[:4]] == [True, True, False, False] and "hunter2" not in out[0]["redacted"] and out[4]["redacted"] is None
    # Every rule is either looked for in `suspect` or has its own fixed text in its pattern.
    assert all(re.escape(s.needs) in re.escape(s.pattern) for s in R.stages() if s.needs)


def test_refused_decisions_do_not_have_their_notes_redacted(spark):
    from vigilog.operators import review as W
    items = spark.createDataFrame([("s", "k")], "session_id string, key string")
    heads = spark.createDataFrame([("s", 9, "h")], "session_id string, head_seq long, head_hash string")
    sent = spark.createDataFrame([("r1", "s", "k", "expected", " token=abcdef123 ", "t"), ("r2", "s", "gone", "expected", "token=abcdef123", "t")],
                                 "review_id string, session_id string, key string, disposition string, note string, created_at string")
    rows = {r["review_id"]: r for r in W.accept_reviews(sent, items, heads).collect()}
    assert rows["r1"]["note"] == "token=[REDACTED:assigned-secret]" and rows["r2"]["note"] is None and rows["r2"]["refusal"] == "not-current"


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


def test_whole_rows_do_not_pass_through_the_windows_of_pairs_and_turns(spark, sf):
    from vigilog.operators import actions as A, story as T
    from vigilog.plans.activity_queries import Activity

    a = Activity(spark, sf)
    wide = {"target", "summary", "ts", "agent_type", "d"}
    for df in (A.pair_actions(a.events, a.split), T.story_rows(a.actions, a.events)):
        plan = df._jdf.queryExecution().optimizedPlan()
        windows = [n for n in _nodes(plan) if n.nodeName() == "Window"]
        assert windows
        for n in windows:
            names = {c.split("#")[0] for c in n.output().mkString(" ").split()}
            assert not names & wide, names


def test_flags_of_a_folded_post_reach_its_pre(spark):
    from vigilog.operators import actions as A

    rows = [("s", 1, "t", "PreToolUse", "pre", None), ("s", 2, "t", "PostToolUse", "post", 1), ("s", 3, "t", "PostToolUse", "post", 1),
            ("s", 4, None, "PostToolUse", "post", 0), ("s", 5, "v", "PostToolUseFailure", "failure", 0), ("s", 6, "w", "PreToolUse", "pre", None)]
    events = spark.createDataFrame([r + (2, 1) for r in rows], "session_id string, seq long, tool_use_id string, hook_event string, phase string, success int, duration_ms long, redaction_count int")
    for name in ("ts", "action_type", "tool_name", "target", "prompt_id", "agent_type", "source"):
        events = events.withColumn(name, F.lit(name))
    events = events.withColumn("d", F.struct(F.lit(None).cast("string").alias("description")))
    flags = spark.createDataFrame([("s", 1, 1, ["a"], ["n"]), ("s", 2, 7, ["b", "a"], []), ("s", 3, 3, ["c"], []), ("s", 4, 4, [], ["m"])],
                                  "session_id string, seq long, score int, signals array<string>, notes array<string>")
    got = {r["seq"]: (r["post_seq"], r["phase"], r["outcome"], r["score"], sorted(r["signals"]), r["notes"], r["redaction_count"]) for r in A.pair_actions(events, flags).collect()}
    assert got == {1: (2, "post", "succeeded", 7, ["a", "b"], ["n"], 2), 3: (None, "post", "succeeded", 3, ["c"], [], 1),
                   4: (None, "post", "failed", 4, [], ["m"], 1), 5: (None, "failure", "failed", 0, [], [], 1), 6: (None, "pre", "attempted", 0, [], [], 1)}


def test_trace_joins_are_not_broadcast_by_file_size(spark, monkeypatch):
    from vigilog.operators import graph
    nodes = spark.createDataFrame([("s", f"p:{k}", "prompt", "t", k, k == 3) for k in range(9)], "session_id string, id string, kind string, label string, seq bigint, risk boolean")
    edges = spark.createDataFrame([("s", f"p:{a}", f"p:{b}") for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 4), (5, 2), (7, 8))], "session_id string, src string, dst string")
    findings = spark.createDataFrame([], "session_id string, combo string, severity string")
    turns = spark.createDataFrame([("s", str(k), k, 0, 0) for k in range(9)], "session_id string, turn_id string, files int, commits int, flagged int")
    plans = []
    kept = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    near = graph.neighbourhood(edges, graph.default_roots(nodes, findings, turns))
    plans.append(near._jdf.queryExecution().executedPlan().toString())
    assert {r["id"] for r in near.collect()} == {"p:8", "p:7"}
    assert {r["id"] for r in graph.neighbourhood(edges, nodes.where("seq = 3").select("session_id", "id")).collect()} == {f"p:{k}" for k in (1, 2, 3, 4, 5)}
    begun = len(plans)
    assert {r["id"] for r in graph.tainted(nodes, edges).collect()} == {f"p:{k}" for k in range(6)}
    assert len(plans) - begun < 10 and not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
