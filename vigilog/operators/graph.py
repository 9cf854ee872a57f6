"""Causal trace: nodes, edges, roots, bounded traversal, taint and layering."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.lists import basename, lookup, one_line
from vigilog.functions.wording import churn_label, plural
from vigilog.operators.ordered import carry_last
from vigilog.session import cut_lineage, stored

NODE = ["session_id", "id"]
AGGREGATE_MIN = 3


def shuffled(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the number of sessions. Their files are far smaller than their rows in memory,
    so neither is left to be broadcast by the size of its files."""
    return left.join(right.hint("merge"), on, how)


def directory(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("/"))).otherwise("./")


def prompt_id(turn: Column) -> Column:
    return F.concat(F.lit("p:"), turn)


def actor_steps(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Steps that get a node: cited by a finding, flagged, or spawning a subagent."""
    cited = findings.select("session_id", F.explode(F.array(
        F.struct(F.col("antecedent_seq").alias("seq"), F.lit(0).alias("effect")),
        F.struct(F.col("consequent_seq").alias("seq"), F.lit(1).alias("effect")))).alias("x")
    ).select("session_id", "x.*").groupBy("session_id", "seq").agg(F.max("effect").alias("effect"))
    steps = rows.filter(F.col("role") == "step")
    post = cited.withColumnRenamed("seq", "post_seq").withColumnRenamed("effect", "post_effect")
    marked = shuffled(shuffled(steps, cited, ["session_id", "seq"], "left"), post, ["session_id", "post_seq"], "left")
    acts = F.col("effect").isNotNull() | F.col("post_effect").isNotNull() | (F.size("signals") > 0) | (
        F.col("is_subagent") & (F.col("tool") == "Task"))
    return marked.filter(acts).withColumn(
        "is_effect", (F.coalesce("effect", F.lit(0)) == 1) | (F.coalesce("post_effect", F.lit(0)) == 1))


def trace(rows: DataFrame, turns: DataFrame, files: DataFrame, commits: DataFrame, findings: DataFrame
          ) -> tuple[DataFrame, DataFrame]:
    """All nodes and edges of every session."""
    c, lit = F.col, F.lit
    node = lambda kind, label, sub, seq, risk: [lit(kind).alias("kind"), label.alias("label"), sub.alias("sub"),
                                                seq.cast("bigint").alias("seq"), risk.alias("risk")]
    nothing = lit(None).cast("string")
    parts = F.concat_ws(" · ", F.when(c("steps") > 0, plural(c("steps"), "step")), F.when(c("files") > 0, plural(c("files"), "file")),
                        F.when(c("commits") > 0, plural(c("commits"), "commit")))
    prompts = turns.select("session_id", prompt_id(c("turn_id")).alias("id"), *node(
        "prompt", c("title"), F.when(parts == "", "no changes").otherwise(parts), c("first_seq"), c("flagged") > 0))

    actors = actor_steps(rows, findings)
    step_id = F.concat(lit("s:"), c("seq").cast("string"))
    steps = actors.select("session_id", step_id.alias("id"), *node(
        "step", F.concat(F.coalesce("tool", "type"), F.when(c("target").isNotNull(), F.concat(lit(" · "), basename(c("target")))).otherwise("")),
        F.substring(one_line(c("summary")), 1, 80), F.coalesce("post_seq", "seq"), F.size("signals") > 0))
    caused = actors.filter(~c("is_effect")).select("session_id", prompt_id(c("turn_id")).alias("src"), step_id.alias("dst"), lit("caused").alias("rel"))
    where = actors.select("session_id", F.explode(F.array_compact(F.array("seq", "post_seq"))).alias("seq"), step_id.alias("step"))

    made = shuffled(files.filter(c("turn_id").isNotNull()), where, ["session_id", "seq"], "left").select(
        "session_id", F.coalesce("step", prompt_id(c("turn_id"))).alias("parent"), "path", "seq", "skipped", "insertions", "deletions")
    made = made.withColumn("dir", directory(c("path")))
    sizes = made.groupBy("session_id", "parent", "dir").agg(F.count(lit(1)).alias("n"))
    made = shuffled(made, sizes, ["session_id", "parent", "dir"])
    single, grouped = made.filter(c("n") < AGGREGATE_MIN), sizes.filter(c("n") >= AGGREGATE_MIN)
    file_id = F.concat(lit("f:"), c("parent"), lit(":"), c("path"))
    dir_id = F.concat(lit("d:"), c("parent"), lit(":"), c("dir"))
    file_nodes = single.select("session_id", file_id.alias("id"), *node(
        "file", basename(c("path")), churn_label(c("insertions"), c("deletions"), c("skipped")), c("seq"), lit(False)))
    dir_nodes = grouped.select("session_id", dir_id.alias("id"), *node(
        "dir", F.concat(c("n").cast("string"), lit(" files in "), c("dir")), nothing, lit(None), lit(False)))
    wrote = single.select("session_id", c("parent").alias("src"), file_id.alias("dst"), lit("wrote").alias("rel")).unionByName(
        grouped.select("session_id", c("parent").alias("src"), dir_id.alias("dst"), lit("wrote").alias("rel")))

    commit_id = F.concat(lit("c:"), c("seq").cast("string"))
    commit_nodes = commits.select("session_id", commit_id.alias("id"), *node(
        "commit", F.coalesce(F.nullif(F.trim(F.concat_ws(" ", F.substring("sha", 1, 7), "subject")), lit("")), lit("commit")),
        F.when(c("files") > 0, F.concat(c("files").cast("string"), lit(" files"))).otherwise("commit"), c("seq"), lit(False)))
    both = actors.select("session_id", "turn_id", "seq", step_id.alias("step")).unionByName(
        commits.select("session_id", "turn_id", "seq", nothing.alias("step")))
    producers = carry_last(both, ["session_id", "turn_id"], "seq", c("step"), "producer", include_current=False).filter(c("step").isNull())
    committed = producers.select("session_id", F.coalesce("producer", prompt_id(c("turn_id"))).alias("src"), commit_id.alias("dst"), lit("committed").alias("rel"))

    # A finding sits between its antecedent and its consequent; it needs a turn to hang on.
    owner = rows.filter(c("role") == "step").select("session_id", F.explode(F.array_compact(F.array("seq", "post_seq"))).alias("at"),
                                                   "turn_id", step_id.alias("step"))
    side = lambda name: owner.select("session_id", c("at").alias(f"{name}_seq"), c("turn_id").alias(f"{name}_turn"), c("step").alias(f"{name}_step"))
    placed = shuffled(shuffled(findings, side("antecedent"), ["session_id", "antecedent_seq"], "left"),
                      side("consequent"), ["session_id", "consequent_seq"], "left").filter(
        c("antecedent_turn").isNotNull() | c("consequent_turn").isNotNull())
    finding_id, host_id, server_id = (F.concat(lit(p), c("combo")) for p in ("F:", "h:", "m:"))
    label = F.when(c("combo") == "exfil-chain", "exfil chain").when(c("combo").startswith("injected"), "injected instruction").when(
        c("server").isNotNull(), "tool poisoning").otherwise(F.regexp_replace("combo", "-", " "))
    finding_nodes = placed.select("session_id", finding_id.alias("id"), *node(
        "finding", label, F.substring(one_line(c("display_note")), 1, 90), c("consequent_seq"), lit(True)))
    arrived = c("outcome") == "succeeded"
    host_nodes = placed.filter(c("host").isNotNull()).select("session_id", host_id.alias("id"), *node(
        "host", c("host"), F.when(arrived, "tool-reported destination").otherwise("attempted destination"), lit(None), lit(True)))
    server_nodes = placed.filter(c("server").isNotNull()).select("session_id", server_id.alias("id"), *node(
        "host", c("server"), lit("poisoned server"), lit(None), lit(True)))
    home = prompt_id(F.coalesce("antecedent_turn", "consequent_turn"))
    edge = lambda df, src, dst, rel: df.select("session_id", src.alias("src"), dst.alias("dst"), (rel if isinstance(rel, Column) else lit(rel)).alias("rel"))
    went = F.when(arrived, "sent").otherwise("targeted")
    into = edge(placed, F.coalesce("antecedent_step", home), finding_id, "flagged")
    out = edge(placed.filter(c("consequent_step").isNotNull()), finding_id, c("consequent_step"), "flagged")
    reach = edge(placed.filter(c("host").isNotNull()), F.coalesce("consequent_step", finding_id), host_id, went)
    served = edge(placed.filter(c("server").isNotNull()), finding_id, server_id, went)

    nodes = prompts
    for df in (steps, file_nodes, dir_nodes, commit_nodes, finding_nodes, host_nodes, server_nodes):
        nodes = nodes.unionByName(df)
    edges = caused
    for df in (wrote, committed, into, out, reach, served):
        edges = edges.unionByName(df)
    return nodes, edges.filter(c("src") != c("dst"))


def expand_directories(files: DataFrame, rows: DataFrame, findings: DataFrame, opened: DataFrame) -> DataFrame:
    """File rows behind the directory nodes that were opened."""
    where = actor_steps(rows, findings).select(
        "session_id", F.explode(F.array_compact(F.array("seq", "post_seq"))).alias("seq"), F.concat(F.lit("s:"), F.col("seq").cast("string")).alias("step"))
    made = files.filter(F.col("turn_id").isNotNull()).join(where, ["session_id", "seq"], "left").withColumn(
        "parent", F.coalesce("step", prompt_id(F.col("turn_id"))))
    dir_id = F.concat(F.lit("d:"), F.col("parent"), F.lit(":"), directory(F.col("path")))
    return made.withColumn("id", dir_id).join(opened.select(*NODE), NODE, "left_semi").select("session_id", "id", "path", "seq")


def root_options(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """Candidate roots: findings by severity, then turns in order."""
    severity = findings.select("session_id", F.concat(F.lit("F:"), "combo").alias("id"), "severity")
    return shuffled(nodes.filter(F.col("kind").isin("finding", "prompt")), severity, NODE, "left").select(
        *NODE, "kind", F.when(F.col("kind") == "finding", F.concat("label", F.lit(" · "), "severity")).otherwise(F.col("label")).alias("label"),
        F.when(F.col("kind") == "finding", F.coalesce(lookup(V.SEVERITY_RANK, F.col("severity")), F.lit(3))).otherwise(9).alias("rank"), "seq")


def default_roots(nodes: DataFrame, findings: DataFrame, turns: DataFrame) -> DataFrame:
    """Top finding of each session, else its turn with the most outcomes."""
    worth = turns.select("session_id", prompt_id(F.col("turn_id")).alias("id"),
                         (F.col("files") + 2 * F.col("commits") + 3 * F.col("flagged")).alias("worth"))
    options = shuffled(root_options(nodes, findings), worth, NODE, "left")
    order = F.struct("rank", -F.coalesce("worth", F.lit(0)), F.coalesce("seq", F.lit(0)), "id")
    return options.groupBy("session_id").agg(F.min_by("id", order).alias("id"))


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes within `depth` causal hops of their session's root, in both directions.

    All sessions advance together; one equi join per hop and direction. Roots are worked out once.
    """
    roots = stored(roots.select(*NODE), "roots")

    def walk(src: str, dst: str) -> list[DataFrame]:
        links = edges.select("session_id", F.col(src).alias("id"), F.col(dst).alias("next"))
        fronts = [roots]
        for hop in range(depth):
            # The distinct nodes lie as the next hop joins them.
            front = shuffled(fronts[-1], links, NODE).select("session_id", F.col("next").alias("id")).distinct()
            fronts.append(cut_lineage(front) if hop % 3 == 2 else front)
        return fronts[1:]

    return reduce(DataFrame.unionByName, [roots, *walk("dst", "src"), *walk("src", "dst")]).distinct()


def tainted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes connected, along edges in one direction, to a risk node; rounds end when no new node is met.

    Both directions advance together. Only what a round has met is written, and no node is followed twice in a direction.
    """
    way = lambda src, dst, up: edges.select("session_id", F.col(src).alias("id"), F.lit(up).alias("up"), F.col(dst).alias("next"))
    links = stored(way("dst", "src", True).unionByName(way("src", "dst", False)), "links")
    keys = [*NODE, "up"]
    front = stored(nodes.filter("risk").select(*NODE).distinct().withColumn("up", F.explode(F.array(F.lit(True), F.lit(False)))), "front")
    met = [front]
    while not front.isEmpty():
        reached = shuffled(front, links, keys).select("session_id", F.col("next").alias("id"), "up").distinct()
        front = stored(shuffled(reached, reduce(DataFrame.unionByName, met), keys, "left_anti"), "front")
        met.append(front)
        if len(met) > 8:  # a deep graph is not read from ever more folders
            met = [stored(reduce(DataFrame.unionByName, met), "met")]
    return reduce(DataFrame.unionByName, met).select(*NODE).distinct()


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest-path layer of every node, all sessions peeled together.

    Round r settles the nodes whose predecessors are all settled. Nodes on a
    cycle are never settled; they sit one layer after their settled predecessors.
    """
    links = cut_lineage(edges.select("session_id", "src", "dst").distinct())
    waiting = cut_lineage(nodes.select(*NODE).distinct())
    open_links, settled = links, None
    for round_ in count():
        blocked = open_links.select("session_id", F.col("dst").alias("id")).distinct()
        ready = cut_lineage(waiting.join(blocked, NODE, "left_anti").withColumn("layer", F.lit(round_)))
        if ready.isEmpty():
            break
        settled = ready if settled is None else settled.unionByName(ready)
        waiting = cut_lineage(waiting.join(ready, NODE, "left_anti"))
        gone = ready.select("session_id", F.col("id").alias("src"))
        open_links = cut_lineage(open_links.join(gone, ["session_id", "src"], "left_anti"))
    if settled is None:
        return waiting.withColumn("layer", F.lit(0))
    above = links.join(settled.withColumnRenamed("id", "src"), ["session_id", "src"]).groupBy(
        "session_id", F.col("dst").alias("id")).agg((F.max("layer") + 1).alias("layer"))
    rest = waiting.join(above, NODE, "left").withColumn("layer", F.coalesce("layer", F.lit(0)))
    return settled.unionByName(rest)
