"""Which files deserve a model's attention, in what passes and batches, and what the parts' scores come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import count_in

# Parts of paths that are not sent to a model.
SKIPPED = ["_test.go", "_test.py", "_test.js", "_test.ts", "_test.rb", "_test.java", ".test.js", ".test.ts", ".spec.js", ".spec.ts", ".test.py", "/test/", "/tests/", "/testing/", "/__tests__/", "/e2e/", "/integration/", "/fixtures/", "/spec/", "/specs/", "/pkg/", "/vendor/", "/node_modules/", "/lib/", "/libs/", "/packages/", "/third_party/", "/external/", "/deps/", "/dependencies/", "/site-packages/", "/dist-packages/", "/gems/", "/bower_components/", "/jspm_packages/", "/.bundle/", "/target/", "/build/", "/dist/", "/out/", "/.cargo/", "/Pods/", "/.gradle/", "/.m2/", "/.ivy2/", "/.sbt/", "/composer/"]
# What makes a file sensitive, with its weight.
SENSITIVE = {
    r"@tool|class.*Tool|def.*handle_tool": 0.9,
    r"exec\(|eval\(|subprocess\.|os\.system": 0.85,
    r"requests\.|urlopen|socket\.|httpx": 0.7,
    r"open\(|Path\(.*\)\..*write|shutil\.|os\.remove": 0.6,
    r"\.env|api_key|secret|password|token": 0.8,
    r"system:|Human:|Assistant:|<\|.*\|>": 0.75,
    r"base64|marshal\.loads|pickle\.loads|exec.*decode": 0.8,
    r"handle_|execute_|process_request|on_message": 0.7,
}
# The share of each part in a file's rank, and the ranks at which it counts for more.
SHARES = {"threat": 0.25, "complexity": 0.10, "sensitivity": 0.20, "server": 0.15, "network": 0.10, "obfuscation": 0.15, "dependency": 0.05}
IMPORTANCE = [(0.7, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM"), (0.15, "LOW")]
NETWORK = ["requests", "urllib", "socket", "http", "websocket"]
# Words that call for a pass.
PASSES = {
    "entry_points": ["request.", "input(", "argv", "environ", "@app.route", "@tool"],
    "authentication": ["auth", "login", "password", "token", "session", "jwt"],
    "cryptography": ["crypt", "hash", "encrypt", "decrypt", "sign", "verify"],
    "logic_flaws": ["if ", "while ", "for ", "try:", "async ", "await "],
    "time_based": ["thread", "async", "lock", "mutex", "race", "concurrent"],
}


def skipped(path: Column) -> Column:
    """Tests, packages and build output; a part with capitals never meets a path in lower case."""
    return count_in(F.lower(path), SKIPPED) > 0


def simple(path: Column, size: Column) -> Column:
    """Small files whose path names nothing that handles requests."""
    return (size < 50000) & (count_in(F.lower(path), ["handler", "server", "execute", "process"]) == 0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _times(text: Column, word: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def complexity(code: Column) -> Column:
    """0 to 1 by length, branches, definitions and error handling."""
    lines = F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1
    branches = _count(code, r"\bif\s+|elif\s+|else:") + _count(code, r"\bfor\s+|\bwhile\s+")
    long = F.when((lines > 50) & (lines < 500), 3).when(lines >= 500, 2).otherwise(0)
    wide = F.when(branches > 10, 3).when(branches > 5, 2).otherwise(0)
    made = F.when((_count(code, r"\bclass\s+\w+") > 2) | (_count(code, r"\bdef\s+\w+") > 5), 2).otherwise(0)
    return (long + wide + made + F.when(_count(code, r"\btry:") > 2, 2).otherwise(0)) / 10


def obfuscation(code: Column) -> Column:
    """0 to 1 by short names, escapes, base64, run code and long strings."""
    equals = F.greatest(F.lit(1.0), _times(code, "="))
    parts = [
        (0.2, _count(code, r"\b[a-z_]\s*=") / equals),
        (0.2, _count(code, r"\\x[0-9a-f]{2}") / 100),
        (0.15, F.contains(code, F.lit("base64")).cast("int")),
        (0.25, (_times(code, "eval") + _times(code, "exec")) / 10),
        (0.1, _count(code, r"""["'][^"']{200,}["']""") / 5),
        (0.1, _count(code, r"\\u[0-9a-f]{4}") / 50),
    ]
    return sum((F.least(F.lit(1.0), x) * w for w, x in parts), F.lit(0.0))


def rank(files: DataFrame, path: str = "path", code: str = "content", critical: str = "n_critical", high: str = "n_high", dependencies: str = "n_dependencies") -> DataFrame:
    """Columns `parts` (a score from 0 to 1 for each), `rank` and `importance`. Skipped paths have rank 0.01."""
    p, c = F.lower(F.coalesce(path, F.lit(""))), F.coalesce(code, F.lit(""))
    n = [F.coalesce(x, F.lit(0)) for x in (critical, high, dependencies)]
    sensitive = sum((F.when(c.rlike(f"(?i){rx}"), w).otherwise(0.0) for rx, w in SENSITIVE.items()), F.lit(0.0))
    parts = {
        "threat": F.least(F.lit(1.0), n[0] * 0.3 + n[1] * 0.15),
        "complexity": complexity(c),
        "sensitivity": F.least(F.lit(1.0), sensitive / 3),
        "server": (count_in(p, ["tool", "handler", "mcp"]) + count_in(c, ["@tool", "handle_", "execute_"])) / 6,
        "network": count_in(F.lower(c), NETWORK) / len(NETWORK),
        "obfuscation": obfuscation(c),
        "dependency": F.least(F.lit(1.0), n[2] / 10),
    }
    out = files.withColumn("parts", F.struct(*[x.cast("double").alias(k) for k, x in parts.items()]))
    total = sum((F.col("parts")[k] * w for k, w in SHARES.items()), F.lit(0.0))
    out = out.withColumn("rank", F.when(skipped(F.coalesce(path, F.lit(""))), 0.01).otherwise(total))
    level = F.lit("MINIMAL")
    for least, name in reversed(IMPORTANCE):
        level = F.when(F.col("rank") >= least, name).otherwise(level)
    return out.withColumn("importance", level)


def passes(files: DataFrame, group: str, code: str = "content") -> DataFrame:
    """Passes each group of files calls for. Files are judged one by one and their flags gathered: no text is joined."""
    c, low = F.coalesce(code, F.lit("")), F.lower(F.coalesce(code, F.lit("")))
    flags = [F.max(count_in(c if k == "logic_flaws" else low, words) > 0).alias(k) for k, words in PASSES.items()]
    out = files.groupBy(group).agg(*flags, F.count(F.lit(1)).alias("_files"), (F.sum(F.length(c)) + F.count(F.lit(1)) - 1).alias("_chars"))
    big, deep = F.col("_chars") > 1000, (F.col("_files") > 5) | (F.col("_chars") > 5000)
    on = [F.lit("initial_scan"), *[F.when(F.col(k) & (big if k == "logic_flaws" else F.lit(True)), k) for k in PASSES], F.when(F.col("entry_points"), "data_flow"), F.when(deep, "deep_chains")]
    return out.select(group, F.array_compact(F.array(*on)).alias("passes"))


def combined_risk(model: Column, learned: Column, static: Column) -> Column:
    return F.least(F.lit(1.0), model * 0.35 + learned * 0.35 + static * 0.30)


def verdict(risk: Column) -> Column:
    return F.when(risk >= 0.8, "CRITICAL - Do not use").when(risk >= 0.6, "HIGH RISK - Review required").when(risk >= 0.4, "MODERATE RISK - Use with caution").when(risk >= 0.2, "LOW RISK - Monitor usage").otherwise("MINIMAL RISK - Safe to use")


def agreement(n_model: Column, n_learned: Column, model_high: Column, learned_high: Column) -> Column:
    """Confidence of an assessment: mean of how much each part found and whether they agree; 0.5 where nothing was found."""
    much = [F.when(n > 0, F.least(F.lit(1.0), n / 10)) for n in (n_model, n_learned)]
    same = F.when((n_model > 0) & (n_learned > 0), F.when(model_high == learned_high, 0.9).otherwise(0.6))
    factors = F.array_compact(F.array(*much, same))
    return F.when(F.size(factors) == 0, 0.5).otherwise(F.aggregate(factors, F.lit(0.0), lambda a, x: a + x) / F.size(factors))


def balanced(files: DataFrame, group: str, score: str = "rank", order=("path",)) -> DataFrame:
    """`turn`: an order of a group's files in which each round has one of high and one of middling score and, every third
    place, one of low score. Positions follow from ranks within the bands, so nothing is walked file by file."""
    band = F.when(F.col(score) >= 0.7, 0).when(F.col(score) >= 0.4, 1).otherwise(2)
    out = files.withColumn("_band", band)
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_band").orderBy(F.desc(score), *order)))
    sizes = Window.partitionBy(group)
    high, low = (F.count(F.when(F.col("_band") == b, 1)).over(sizes) for b in (0, 2))
    middle = F.count(F.when(F.col("_band") == 1, 1)).over(sizes)
    out = out.withColumns({"_h": high, "_m": middle, "_l": low})
    both = F.least("_h", "_m")
    # While both upper bands last, a low file comes in at every third place: one a round. After that only one file a round is
    # added, so it takes two of the rest before each low one; what is left of the low band goes last.
    at = F.when(F.col("_band") == 0, _place("_n", both, 0)).when(F.col("_band") == 1, _place("_n", both, 1)).otherwise(_low(both))
    return out.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(at, "_band", "_n"))).drop("_band", "_n", "_h", "_m", "_l")


def _place(n: str, both: Column, second: int) -> Column:
    """Rounds of three (high, middle, low), then of two of whatever upper band is left and a low one."""
    n = F.col(n)
    return F.when(n <= both, (n - 1) * 3 + second).otherwise(both * 3 + F.floor((n - both - 1) / 2) * 3 + (n - both - 1) % 2)


def _low(both: Column) -> Column:
    return (F.col("_n") - 1) * 3 + 2
