"""Reports: verdicts, advice and findings as text, Markdown, SARIF or JSON, one row a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.rules import RANK

# What to do about an attack vector, and what is said of a level and a vector.
MITIGATIONS = {
    "command_injection": "Use parameterized commands, avoid shell=True",
    "data_exfiltration": "Block network access, monitor file operations",
    "credential_theft": "Use credential vault, never hardcode secrets",
    "persistence_mechanism": "Monitor startup locations, use read-only filesystems",
    "prompt_injection": "Sanitize all LLM inputs, use strict templates",
    "code_obfuscation": "Require source code review, block obfuscated code",
    "network_backdoor": "Block all network bindings, use egress filtering",
    "sandbox_escape": "Use hardware isolation, restrict capabilities",
}
LEVELS = {
    "CRITICAL": "DO NOT USE - Critical threats that will compromise your system",
    "HIGH": "HIGH RISK - Thorough review required, use only in isolated environment",
    "MEDIUM": "MODERATE RISK - Review issues and use with enhanced monitoring",
    "LOW": "LOW RISK - Standard security practices recommended",
    "MINIMAL": "SAFE - No significant threats detected",
}
RECOMMENDATIONS = {
    "command_injection": "Detected command injection - tool can execute arbitrary commands",
    "data_exfiltration": "Data exfiltration risk - tool can steal and transmit data",
    "credential_theft": "Credential theft detected - protect your secrets",
    "persistence_mechanism": "Persistence mechanisms found - tool may install backdoors",
}
LEVEL_OF = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}


def _told(vectors: Column, said: dict[str, str]) -> list[Column]:
    return [F.when(F.array_contains(vectors, k), v) for k, v in said.items()]


def mitigations(vectors: Column) -> Column:
    return F.array_compact(F.array(*_told(vectors, MITIGATIONS)))


def recommendations(level: Column, vectors: Column, tainted: Column) -> Column:
    """What a level calls for, then each vector, then how many tainted flows there are."""
    first = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[level]
    flows = F.when(tainted > 0, F.concat(tainted.cast("string"), F.lit(" tainted data flows detected")))
    return F.array_compact(F.array(first, *_told(vectors, RECOMMENDATIONS), flows))


def advice(findings: DataFrame, key: str, vector: str = "category") -> DataFrame:
    """(key, vectors, mitigations). Distinct vectors are gathered; they are as few as the vectors there are."""
    out = findings.groupBy(key).agg(F.sort_array(F.collect_set(vector)).alias("vectors"))
    return out.withColumn("mitigations", mitigations(F.col("vectors")))


def tool_verdict(signature: Column, changed: Column, action: Column, reason: Column, score: Column, threats: Column) -> Column:
    """struct<level, points, reason, block>: the worst of signature, policy and static analysis, low at least."""
    n = F.greatest(
        F.lit(2),
        F.when(signature == "blacklisted", 10).when(changed, 7),
        F.when(action == "block", 10).when(action == "modify", 5),
        F.when(score >= 8, 10).when(score >= 6, 7).when(score >= 4, 5),
    )
    level = F.when(n == 10, "critical").when(n == 7, "high").when(n == 5, "medium").otherwise("low")
    said = F.array_compact(F.array(F.when(signature == "blacklisted", "Tool is blacklisted").when(changed, "Tool signature has changed"), F.when(action == "block", F.coalesce(reason, F.lit("Policy violation"))).when(action == "modify", "Requires modification per policy")))
    said = F.concat(said, F.slice(F.coalesce(threats, F.array().cast("array<string>")), 1, 3))
    why = F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise("No specific threats detected")
    block = F.coalesce((signature == "blacklisted") | (action == "block") | (score >= 8), F.lit(False))
    return F.struct(level.alias("level"), n.alias("points"), why.alias("reason"), block.alias("block"))


def system_level(violations: Column, threats: Column) -> Column:
    return F.when(violations > 0, "high").when(threats > 5, "medium").otherwise("low")


def chains(entries: DataFrame, sinks: DataFrame, key: str, each: int = 5, most: int = 10) -> DataFrame:
    """Possible chains: a key's first entry points with its first sinks (a report of the top few). Both have key, type, location
    and an integer `n` for the order."""

    def first(rows: DataFrame, prefix: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(key).orderBy("n"))
        return rows.withColumn("_at", at).filter(F.col("_at") <= each).select(key, F.col("type").alias(f"{prefix}_type"), F.col("location").alias(f"{prefix}_location"), F.col("_at").alias(f"_{prefix}"))

    both = first(entries, "entry").join(first(sinks, "sink"), key)
    out = both.withColumn("_at", (F.col("_entry") - 1) * each + F.col("_sink"))
    out = out.withColumn("chain", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).filter(F.col("chain") <= most)
    return out.select(key, "chain", F.concat_ws(" -> ", "entry_type", "sink_type").alias("name"), "entry_location", "sink_location", F.lit("HIGH").alias("severity"), F.lit(0.7).alias("confidence"))


def by_severity(findings: DataFrame, key: str) -> DataFrame:
    """Counts by severity and in all, one row a report."""
    return findings.groupBy(key).agg(F.count(F.lit(1)).alias("findings"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s.lower()) for s in RANK])


def as_text(counts: DataFrame, key: str) -> DataFrame:
    lines = [F.concat(F.lit("Report: "), F.col(key).cast("string")), F.concat(F.lit("Findings: "), F.col("findings").cast("string"))]
    lines += [F.concat(F.lit(f"  {s}: "), F.col(s.lower()).cast("string")) for s in RANK]
    return counts.select(key, F.concat_ws("\n", *lines).alias("report"))


def as_markdown(counts: DataFrame, key: str) -> DataFrame:
    lines = [F.concat(F.lit("# "), F.col(key).cast("string")), F.lit(""), F.lit("| severity | findings |"), F.lit("| --- | --- |")]
    lines += [F.concat(F.lit(f"| {s} | "), F.col(s.lower()).cast("string"), F.lit(" |")) for s in RANK]
    return counts.select(key, F.concat_ws("\n", *lines).alias("report"))


def sarif_result(path: Column) -> Column:
    """One finding (columns category, severity, name, line) as a SARIF result."""
    level = F.create_map(*[F.lit(x) for kv in LEVEL_OF.items() for x in kv])[F.col("severity")]
    region = F.struct(F.col("line").alias("startLine"))
    place = F.struct(F.struct(F.struct(path.cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.struct(F.col("category").alias("ruleId"), level.alias("level"), F.struct(F.col("name").alias("text")).alias("message"), F.array(place).alias("locations"))


def as_sarif(findings: DataFrame, path: str, tool: str = "larkspur") -> DataFrame:
    """(path, report): one SARIF log a file, results in the order of lines. A log is as large as its file's findings; a whole
    corpus is written as results (`sarif_result`), a row each."""
    results = findings.select(F.col(path).alias("path"), F.struct("line", "category", "name", sarif_result(F.col(path)).alias("result")).alias("r"))
    logs = results.groupBy("path").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["result"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.col("results").alias("results"))
    return logs.select("path", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("report"))
