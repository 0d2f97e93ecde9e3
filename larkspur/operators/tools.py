"""Tools and the servers that offer them: which files hold one, what it does, claims and permits, and how tools hang together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import count_in
from larkspur.operators.prompts import INJECTION, PROMPT
from larkspur.operators.rules import CODE

# What marks a file as a tool, within its first 1000 characters; directories that hold none.
MARKS = [r"@tool\s*\(", r"class\s+\w*Tool\w*", r"def\s+handle\w*\s*\(", r"from\s+mcp\s+import", r"from\s+\.?\w*tools?\w*\s+import"]
NO_TOOLS = [".git", "__pycache__", "node_modules", "venv", ".venv", "test", "tests"]
# Risky operations with what they cost a tool's score.
OPERATIONS = {"exec": 30, "eval": 30, "compile": 5, "__import__": 5, "subprocess": 20, "os.system": 5, "pickle.loads": 15, "marshal.loads": 15, "requests.get": 5, "urllib.request": 5, "open": 5, "Path": 5}
SECRETS = r"""(?i)(?:api[_-]?key|password|token|secret)\s*=\s*["'][^"']+["']"""
# Concerns with severity and cost.
CONCERNS = {"code_injection": ("CRITICAL", 25), "command_injection": ("CRITICAL", 25), "credential_exposure": ("HIGH", 15), "unsafe_deserialization": ("HIGH", 15)}
# Metadata that carries instructions, names of suspicious packages.
METADATA = [r"ignore\s+(all\s+)?previous", r"system\s*:", r"</\w+>", r"\{\{.*\}\}", r"<IMPORTANT>", r"SYSTEM\s+OVERRIDE", r"<!--.*instructions", r"before.*using.*tool"]
PACKAGES = ["evil", "backdoor", "malware", "exploit"]
# Claims of safety, code they do not go with, names that borrow trust, operations a description should mention.
CLAIMS = ["This tool safely", "harmless function", "security-verified", "audit-approved", "read-only access", "sandboxed execution"]
DANGERS = ["eval", "exec", "system", "subprocess", "socket"]
TRUST = ["Microsoft", "Google", "OpenAI", "official", "certified", "verified", "trusted"]
HIDDEN = ["eval", "exec", "__import__", "compile", "globals", "locals", "setattr", "delattr", "__dict__"]
RELEVANT = r"(?i)command\s+injection|ssrf|server[- ]side\s+request|path\s+traversal|deserializ|arbitrary\s+file|open\s+redirect|remote\s+code\s+execution"

INDICATOR = "array<struct<type:string,confidence:double,severity:double,evidence:string>>"


def within(text: Column, words: list[str]) -> Column:
    """The words that occur in the text, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), w) for w in words]))


def is_tool(path: Column, code: Column) -> Column:
    named = F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"(?:tool|handler|mcp|server).*\.py$")
    marked = path.endswith(".py") & F.substring(code, 1, 1000).rlike("|".join(MARKS))
    return (named | marked) & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, NO_TOOLS)))


def concerns(code: Column) -> Column:
    """array<struct<concern, severity>> of a tool's code."""

    def has(*words: str) -> Column:
        return count_in(code, list(words)) > 0

    met = {
        "code_injection": has("exec(", "eval("),
        "command_injection": has("subprocess") & has("shell=True"),
        "credential_exposure": code.rlike(SECRETS),
        "unsafe_deserialization": has("pickle.loads", "marshal.loads"),
    }
    return F.array_compact(F.array(*[F.when(x, F.struct(F.lit(k).alias("concern"), F.lit(CONCERNS[k][0]).alias("severity"))) for k, x in met.items()]))


def describe(files: DataFrame, path: str = "path", code: str = "content") -> DataFrame:
    """One row a tool file: its name, imports that look like tools, risky operations, concerns and security score (100 less
    what they cost, not below 0)."""
    p, c = F.col(path), F.coalesce(F.col(code), F.lit(""))
    decorated, classed = F.regexp_extract(c, r"""@tool\s*\(["'](\w+)["']""", 1), F.regexp_extract(c, r"class\s+(\w*Tool\w*)", 1)
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    name = F.when(decorated != "", decorated).when(classed != "", classed).otherwise(stem)
    # `from a import b` gives a, `import a` gives a
    modules = F.transform(F.regexp_extract_all(c, F.lit(r"((?:from\s+[a-zA-Z0-9_.]+\s+)?import\s+[a-zA-Z0-9_.,\s]+)"), F.lit(1)), lambda s: F.regexp_extract(s, r"^(?:from|import)\s+((?:(?!\s+import\b)[a-zA-Z0-9_.,\s])+)", 1))
    imports = F.filter(modules, lambda m: F.lower(m).rlike("tool|handler|mcp"))
    out = files.filter(is_tool(p, c)).select(p.alias("path"), name.alias("tool"), imports.alias("imports"), within(c, list(OPERATIONS)).alias("operations"), concerns(c).alias("concerns"))
    cost = F.create_map(*[F.lit(x) for k, v in OPERATIONS.items() for x in (k, v)])
    dear = F.create_map(*[F.lit(x) for k, (_, v) in CONCERNS.items() for x in (k, v)])
    lost = F.aggregate("operations", F.lit(0), lambda a, o: a + cost[o]) + F.aggregate("concerns", F.lit(0), lambda a, o: a + dear[o["concern"]])
    return out.withColumn("score", F.greatest(F.lit(0), 100 - lost))


def relations(tools: DataFrame, repository: str) -> DataFrame:
    """(repository, path, imports): a tool imports another of its repository whose path or name holds the imported module.

    Names are filed under their substrings of the lengths that modules have, so that tools meet by an equi-join whose rows
    are the answer; no tool is tried against all others."""
    a = tools.select(repository, "path", F.explode("imports").alias("module")).filter("module <> ''").distinct()
    lengths = sorted(r[0] for r in a.select(F.length("module")).distinct().collect())  # no more than the longest module has characters
    names = tools.select(repository, F.col("path").alias("imports"), F.array("path", "tool").alias("said"))

    def of_length(text: Column, n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))

    def pieces(text: Column) -> Column:
        own = [of_length(text, n) for n in lengths]
        return F.flatten(F.array_compact(F.array(*own))) if own else F.array().cast("array<string>")

    b = names.withColumn("module", F.explode(F.array_distinct(F.flatten(F.transform("said", pieces))))).drop("said")
    return a.join(b, [repository, "module"]).filter(F.col("path") != F.col("imports")).select(repository, "path", "imports").distinct()


def summary(tools: DataFrame) -> DataFrame:
    critical = F.exists("concerns", lambda c: c["severity"] == "CRITICAL")
    return tools.agg(F.count(F.lit(1)).alias("tools"), F.coalesce(F.sum(F.size("operations")), F.lit(0)).alias("risky"), F.coalesce(F.sum(F.size("concerns")), F.lit(0)).alias("concerns"), F.count(F.when(critical, 1)).alias("critical"), F.min("score").alias("lowest"))


def manifest(text: Column) -> Column:
    """struct<name, version, tools, issues> of a server's manifest, else null."""
    kind = "struct<name:string,version:string,permissions:array<string>,tools:array<struct<name:string,description:string>>>"
    m = F.from_json(text, kind)
    asked = F.coalesce(m["permissions"], F.array().cast("array<string>"))

    def any_of(*names: str) -> Column:
        return F.arrays_overlap(asked, F.array(*map(F.lit, names)))

    issues = F.array_compact(F.array(F.when(any_of("*", "all"), "Overly broad permissions requested"), F.when(any_of("system", "admin"), "Elevated permissions requested")))
    tools = F.transform(m["tools"], lambda t: F.struct(t["name"].alias("name"), F.substring(F.coalesce(t["description"], F.lit("")), 1, 100).alias("description")))
    return F.when(m.isNotNull(), F.struct(F.coalesce(m["name"], F.lit("unknown")).alias("name"), F.coalesce(m["version"], F.lit("unknown")).alias("version"), tools.alias("tools"), issues.alias("issues")))


def configuration(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, vector, severity, confidence, description) of configuration files: instructions in metadata, the rules for
    install scripts in package.json, suspicious names in requirements.txt."""
    t, name = F.coalesce(F.col(text), F.lit("")), F.regexp_extract(path, r"([^/]*)$", 1)

    def one(when: Column, vector: str, severity: str, confidence: float, says: str) -> Column:
        return F.when(when, F.struct(F.lit(vector).alias("vector"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(says).alias("description")))

    found = [one(name.isin("mcp.json", "manifest.json", "package.json") & t.rlike(f"(?i){rx}"), "prompt_injection", "CRITICAL", 0.9, f"Prompt injection in metadata: {rx}") for rx in METADATA]
    found += [one((name == "package.json") & t.rlike(f"(?im){rx}"), "package_hijack", sev, conf, f"{says} in package.json") for rx, sev, conf, says in CODE["package_hijack"]]
    found += [one((name == "requirements.txt") & F.contains(F.lower(t), F.lit(w)), "supply_chain_attack", "HIGH", 0.8, f"Suspicious package name containing '{w}'") for w in PACKAGES]
    return files.select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*found))).alias("f")).select("path", "f.*")


def advisory(raw: DataFrame) -> DataFrame:
    """Advisories in one shape: `severity` is the first score of a CVSS kind, `relevant` tells those that matter to tools.
    Input: ecosystem, name, id, aliases, summary, details, severity array<struct<type, score>>."""
    cvss = F.filter("severity", lambda s: s["type"].startswith("CVSS") & (s["score"] != ""))
    brief = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.substring(F.coalesce("details", F.lit("")), 1, 200))
    told = F.concat(F.coalesce("details", F.lit("")), F.lit(" "), brief)
    return raw.select(F.concat_ws(":", "ecosystem", "name").alias("package"), "id", "aliases", brief.alias("summary"), F.get(cvss, F.lit(0))["score"].alias("severity"), told.rlike(RELEVANT).alias("relevant"))


def _indicators(*rows: tuple[Column, str, object, float, Column]) -> Column:
    made = [F.when(when, F.struct(F.lit(kind).alias("type"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("confidence"), F.lit(sev).alias("severity"), says.alias("evidence"))) for when, kind, conf, sev, says in rows]
    return F.array_compact(F.array(*made)).cast(INDICATOR)


def claims(description: Column, code: Column) -> Column:
    """Indicators of deceptive retrieval. Claims and names are sought without regard to case, as a description reads."""
    low = F.lower(F.coalesce(description, F.lit("")))
    c = F.coalesce(code, F.lit(""))
    trusted = within(low, [w.lower() for w in TRUST])
    hidden = F.filter(within(c, HIDDEN), lambda w: ~F.contains(low, w))
    misled = (count_in(low, [w.lower() for w in CLAIMS]) > 0) & (count_in(c, DANGERS) > 0)
    return _indicators(
        (misled, "rade_attack", 0.85, 0.9, F.lit("Description doesn't match code behavior")),
        (F.size(trusted) > 0, "rade_attack", 0.7, 0.6, F.array_join(trusted, ",")),
        (F.size(hidden) > 0, "rade_attack", 0.9, 0.95, F.array_join(hidden, ",")),
    )


def capabilities(config: Column) -> Column:
    """Indicators of a server's configuration (JSON): tools that together can read or write files and reach the network, and
    missing or odd fields."""
    j = F.from_json(config, "struct<name:string,version:string,tools:array<string>>")
    tools = F.transform(F.coalesce(j["tools"], F.array().cast("array<string>")), F.lower)

    def can(about: list[str], words: list[str]) -> Column:
        return F.exists(tools, lambda t: (count_in(t, about) > 0) & (count_in(t, words) > 0))

    net = can(["network", "http"], ["http", "request"])
    read, write = can(["filesystem"], ["read", "open"]) & net, can(["filesystem"], ["write", "save"]) & net
    pair = F.when(read, "filesystem read, network").otherwise("filesystem write, network")
    faults = F.array_compact(F.array(F.when(j["name"].isNull(), "no name"), F.when(j["version"].isNull(), "no version"), F.when(j["name"].startswith("__"), "name with double underscore")))
    return _indicators((read | write, "privilege_escalation", 0.85, 0.8, pair), (F.size(faults) > 0, "behavioral_anomaly", 0.75, 0.6, F.array_join(faults, ",")))


def encoded_injection(text: Column) -> Column:
    """'base64' or 'hex' where the decoded text holds an injection, else null."""
    wanted = "(?i)" + "|".join(f"(?:{p})" for p in INJECTION)
    tried = F.when(F.contains(text, F.lit("==")) | (F.length(text) % 4 == 0), F.try_to_binary(F.when(text.rlike(r"^[A-Za-z0-9+/]*={0,2}$"), text), F.lit("base64")))
    bare = F.regexp_replace(text, " ", "")
    hexed = F.when(bare.rlike(r"^(?:[0-9a-fA-F]{2})+$"), F.unhex(bare))
    return F.when(F.coalesce(F.try_validate_utf8(tried.cast("string")).rlike(wanted), F.lit(False)), "base64").when(F.coalesce(F.try_validate_utf8(hexed.cast("string")).rlike(wanted), F.lit(False)), "hex")


def confuses_context(text: Column) -> Column:
    """At least two of five signs that a text plays at being the conversation around it."""

    def times(word: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)

    heading = F.contains(text, F.lit("###")) & F.contains(F.lower(text), F.lit("instruction"))
    signs = [times("Human:") > 1, F.contains(text, F.lit("Assistant:")), F.contains(text, F.lit("System:")), heading, text.rlike(r"<\|.*?\|>")]
    return sum((s.cast("int") for s in signs), F.lit(0)) >= 2


def semantic_risk(indicators: Column) -> Column:
    """struct<malicious, confidence, risk>: risk is the mean of severity times confidence, at most 1; a confident indicator
    of running code, sending data or deception is enough."""
    zero = F.lit(0.0)
    risk = F.least(F.lit(1.0), F.aggregate(indicators, zero, lambda a, i: a + i["severity"] * i["confidence"]) / F.size(indicators))
    sure = F.exists(indicators, lambda i: i["type"].isin("code_execution", "data_exfiltration", "rade_attack") & (i["confidence"] > 0.7))
    most = F.aggregate(indicators, zero, lambda a, i: F.greatest(a, i["confidence"]))
    some = F.size(indicators) > 0
    return F.struct((some & ((risk > 0.5) | sure)).alias("malicious"), F.when(some, most).otherwise(0.95).alias("confidence"), F.when(some, risk).otherwise(0.0).alias("risk"))


def docstring_injections(facts: DataFrame, key: str = "path") -> DataFrame:
    """(key, type, severity, confidence, line) of facts of code (`functions.python.prose_facts`): injections in docstrings,
    descriptions set at run time, and conditions on time."""
    rules = [(rx, conf) for rows in PROMPT.values() for rx, conf in rows]
    docs = [F.when((F.col("kind") == "docstring") & F.col("name").rlike(f"(?i){rx}"), F.struct(F.lit("docstring").alias("type"), F.lit("CRITICAL" if conf > 0.9 else "HIGH").alias("severity"), F.lit(conf).alias("confidence"))) for rx, conf in rules]
    other = [F.when(F.col("kind") == kind, F.struct(F.lit(says).alias("type"), F.lit("HIGH").alias("severity"), F.lit(conf).alias("confidence"))) for kind, says, conf in (("description", "dynamic_description", 0.85), ("time_test", "behavioral", 0.8))]
    return facts.select(key, "line", F.explode(F.array_compact(F.array(*docs, *other))).alias("f")).select(key, "f.*", "line")
