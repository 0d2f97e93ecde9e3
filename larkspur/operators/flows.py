"""Flows: sources and sinks of one text, tool calls in a session, and taint through assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut, ship

# The risk of a source reaching a sink; other pairs 0.3.
RISK = {("user_input", "command_execution"): 1.0, ("network", "command_execution"): 0.9, ("environment", "network"): 0.8, ("file", "network"): 0.7, ("user_input", "file_write"): 0.6}
# Tools that read secrets or fetch code, and tools that send or run.
TOXIC = [(["read_file", "read_env", "get_credentials"], ["http_post", "send_data", "upload"], "CREDENTIAL_EXFILTRATION"), (["download", "fetch_url", "http_get"], ["exec", "eval", "run_command"], "REMOTE_CODE_EXECUTION")]


def pairs(sources: DataFrame, sinks: DataFrame, key: str) -> DataFrame:
    """Every source with every sink of the same key, and the pair's risk."""
    risk = F.lit(0.3)
    for (a, b), value in RISK.items():
        risk = F.when((F.col("source_type") == a) & (F.col("sink_type") == b), value).otherwise(risk)
    return sources.join(sinks, key).withColumn("risk_score", risk).withColumn("is_tainted", F.col("risk_score") > 0.3)


def adjacent(events: DataFrame, rules=TOXIC, session="session_id", order=("ts",), tool="tool") -> DataFrame:
    """A source tool whose very next event in the session is a sink tool."""
    nxt = F.lead(tool).over(Window.partitionBy(session).orderBy(*order))
    kind = F.lit(None).cast("string")
    for sources, sinks, name in reversed(rules):
        kind = F.when(F.col(tool).isin(sources) & F.col("next_tool").isin(sinks), name).otherwise(kind)
    return events.withColumn("next_tool", nxt).withColumn("flow", kind).filter("flow IS NOT NULL")


def ordered(events: DataFrame, sources: list[str], sinks: list[str], session="session_id", order=("ts",), tool="tool") -> DataFrame:
    """For every sink event, how many source events came before it in its session. A running count gives what a self-join
    of ordered pairs would, without making the pairs."""
    before = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.when(F.col(tool).isin(sources), 1)).over(before)
    return events.withColumn("sources_before", n).filter(F.col(tool).isin(sinks) & (F.col("sources_before") > 0))


def drift(events: DataFrame, key: str, size: str, order=("ts",), buffer: int = 100, least: int = 10) -> DataFrame:
    """Sizes over three times or under 0.3 times the mean of the last `buffer` - 1 others of their key, once there are ten."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(buffer - 1), -1)
    out = events.withColumn("mean_before", F.avg(size).over(w)).withColumn("n_before", F.count(size).over(w))
    far = (F.col(size) > 3 * F.col("mean_before")) | (F.col(size) < 0.3 * F.col("mean_before"))
    return out.filter((F.col("n_before") >= least) & far)


def behaviors(events: DataFrame, patterns: dict[str, list[str]], session="session_id", order="ts", tie="event_id", tool="tool") -> DataFrame:
    """(session, pattern, confidence) where all tools of a pattern occur: 1 minus the spread of their first places over the
    session's length. Places are numbered in a window and their least taken, so no session is gathered."""
    at = F.row_number().over(Window.partitionBy(session).orderBy(order, tie))
    wanted = sorted({t for ts in patterns.values() for t in ts})
    first = events.withColumn("_at", at).groupBy(session).agg(F.max("_at").alias("_n"), *[F.min(F.when(F.col(tool) == t, F.col("_at"))).alias(f"_{i}") for i, t in enumerate(wanted)])

    def confidence(tools: list[str]) -> Column:
        places = [F.col(f"_{wanted.index(t)}") for t in tools]
        spread = F.greatest(*places) - F.least(*places) if len(places) > 1 else F.lit(0)
        there = F.forall(F.array(*places), lambda p: p.isNotNull())
        return F.when(there, F.when(F.col("_n") > 1, 1 - spread / (F.col("_n") - 1)).otherwise(1.0))

    each = F.array(*[F.struct(F.lit(k).alias("pattern"), confidence(v).alias("confidence")) for k, v in patterns.items()])
    return first.select(session, F.explode(each).alias("p")).select(session, "p.*").filter("confidence IS NOT NULL")


# Pairs of tools by the risk of the second following the first, and what they are called.
PAIR_RISK = {("read_credentials", "http_post"): "critical", ("get_env", "send_data"): "critical", ("read_ssh_key", "upload"): "critical", ("read_file", "http_post"): "high", ("list_files", "delete"): "high", ("download", "exec"): "high"}
PAIR_SAYS = {
    ("read_credentials", "http_post"): "Credential exfiltration detected",
    ("get_env", "send_data"): "Environment variable leakage",
    ("read_ssh_key", "upload"): "SSH key theft attempt",
    ("read_file", "http_post"): "Potential data exfiltration",
    ("download", "exec"): "Remote code execution pattern",
    ("list_files", "delete"): "Destructive enumeration",
}


def pair_risk(source: Column, sink: Column, risks: dict = PAIR_RISK, says: dict = PAIR_SAYS) -> Column:
    """struct<risk, description> of a tool that follows another; medium where the pair is not known."""
    risk, told = F.lit("medium"), F.concat(F.lit("Suspicious flow from "), source, F.lit(" to "), sink)
    for (a, b), level in risks.items():
        risk = F.when((source == a) & (sink == b), level).otherwise(risk)
    for (a, b), text in says.items():
        told = F.when((source == a) & (sink == b), text).otherwise(told)
    return F.struct(risk.alias("risk"), told.alias("description"))


def taint(edges: DataFrame, sources: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(scope, var, hops, confidence): what taint reaches along edges (scope, src, dst), at 0.9 a hop, by its shortest way.

    Each round joins the frontier once and stops when nothing new is reached."""
    reached = cut(sources.select("scope", "var").distinct().withColumn("hops", F.lit(0)))
    frontier, hops = reached, 0
    while (most_hops is None or hops < most_hops) and not frontier.isEmpty():
        hops += 1
        step = frontier.join(edges, (frontier.scope == edges.scope) & (frontier["var"] == edges.src)).select(frontier.scope, F.col("dst").alias("var")).distinct()
        frontier = cut(step.join(reached, ["scope", "var"], "left_anti").withColumn("hops", F.lit(hops)))
        reached = cut(reached.unionByName(frontier))
    return reached.withColumn("confidence", F.pow(F.lit(0.9), F.col("hops")))


# What makes an assignment a source and a call a sink.
SOURCE_CALLS = r"^(input|sys\.argv|os\.environ|os\.getenv|request\.|requests\.get|open)\b"
SINK_CALLS = r"^(exec|eval|os\.system|os\.popen|subprocess\.\w+|cursor\.execute)$"


def taint_in_code(files: DataFrame, path="path", code="content") -> DataFrame:
    """Tainted variables of each file, from one parse of it: sources among its assignments, edges from its assignments."""
    from larkspur.functions.python import ast_facts

    ship(files.sparkSession)
    facts = cut(files.select(F.col(path).alias("scope"), F.explode(ast_facts(F.col(code))).alias("f")).select("scope", "f.*"))
    assigned = facts.filter("kind = 'assign'").select("scope", F.substring_index("name", "=", 1).alias("var"), F.regexp_replace("name", "^[^=]*=", "").alias("value"))
    edges = facts.filter("kind = 'flow'").select("scope", F.substring_index("name", "->", 1).alias("src"), F.substring_index("name", "->", -1).alias("dst"))
    return taint(edges, assigned.filter(F.col("value").rlike(SOURCE_CALLS)))


def across_files(files: DataFrame, repository: str = "repository", path: str = "path", code: str = "content", rules=None) -> DataFrame:
    """(scope, path, line, sink, hops, confidence): sinks that taint of other files reaches, through arguments and results.

    Each file is parsed once, for what crosses its border; the rest are joins of nodes within a repository."""
    from larkspur.functions.taint import Semantics, taint_links

    ship(files.sparkSession)
    links = taint_links(F.col(path), F.col(code), rules or Semantics())
    facts = cut(files.select(F.col(repository).alias("scope"), F.col(path).alias("path"), F.explode(links).alias("f")).select("scope", "path", "f.*"))
    edges = facts.filter("role = 'edge'").select("scope", F.col("node").alias("src"), F.col("to").alias("dst")).distinct()
    reached = taint(edges, facts.filter("role = 'source'").select("scope", F.col("node").alias("var")))
    sinks = facts.filter("role = 'sink'").select("scope", F.col("node").alias("var"), "path", "line", F.col("to").alias("sink"))
    met = sinks.join(reached, ["scope", "var"]).groupBy("scope", "path", "line", "sink").agg(F.min("hops").alias("hops"))
    return met.withColumn("confidence", F.pow(F.lit(0.9), F.col("hops")))


# Kinds of sinks with what reaching them is, how grave, and its weaknesses; others are unknown.
SINK_KINDS = {"exec": ("command_injection", "CRITICAL", ["CWE-77", "CWE-78"]), "command": ("command_injection", "CRITICAL", ["CWE-77", "CWE-78"]), "subprocess": ("command_injection", "CRITICAL", ["CWE-77", "CWE-78"]), "network": ("data_exfiltration", "HIGH", ["CWE-918", "CWE-200"]), "file_write": ("path_traversal", "HIGH", ["CWE-22", "CWE-73"]), "database": ("sql_injection", "HIGH", ["CWE-89"])}
#: The names of `functions.taint` for the same kinds.
SINK_NAMES = {"command_execution": "command", "eval_execution": "exec", "sql_query": "database", "network_out": "network"}


def taint_findings(flows: DataFrame, sink: str = "sink", risk: str = "confidence", least: float = 0.7) -> DataFrame:
    """Tainted flows of risk `least` or more as findings: vector, severity (a write at 0.9 is critical; an unknown sink is medium,
    high from 0.85) and weaknesses."""
    kind, r = F.lower(F.col(sink)), F.col(risk)
    for name, plain in SINK_NAMES.items():
        kind = F.when(F.lower(F.col(sink)) == name, plain).otherwise(kind)
    out = F.struct(F.lit("unknown").alias("vector"), F.when(r < 0.85, "MEDIUM").otherwise("HIGH").alias("severity"), F.array(F.lit("CWE-20")).alias("weaknesses"))
    for name, (vector, severity, weak) in SINK_KINDS.items():
        grave = F.when(r >= 0.9, "CRITICAL").otherwise(severity) if name == "file_write" else F.lit(severity)
        out = F.when(kind == name, F.struct(F.lit(vector).alias("vector"), grave.alias("severity"), F.array(*map(F.lit, weak)).alias("weaknesses"))).otherwise(out)
    return flows.filter(r >= least).withColumn("_f", out).select(*flows.columns, "_f.*")


def code_graphs(files: DataFrame, path: str = "path", code: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frameworks, calls, imports) of Python files: (path, framework), (path, caller, callee), (path, target). One parse each."""
    from larkspur.functions.python import code_graph

    ship(files.sparkSession)
    g = files.select(F.col(path).alias("path"), code_graph(F.col(code)).alias("g"))
    return g.select("path", "g.framework"), g.select("path", F.explode("g.calls").alias("c")).select("path", "c.*"), g.select("path", F.explode("g.imports").alias("target"))
