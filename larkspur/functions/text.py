"""Scalar functions over text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def listed(items: Column, state: Column, kind: str, step) -> Column:
    """array<kind>: a fold in which step(state, item) gives (next state, array of results). Results are gathered block by
    block, so that none is copied more often than there are blocks."""

    def inner(acc, x):
        state, made = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], made).alias("out"))

    def outer(acc, block):
        own = F.aggregate(block, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), inner)
        return let(own, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    begins = lambda all_: F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(BLOCK))
    blocks = let(items, lambda all_: F.transform(begins(all_), lambda i: F.slice(all_, i + 1, F.lit(BLOCK))))
    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(blocks, start, outer, lambda acc: acc["out"]))


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def match_offsets(text: Column, pattern: str) -> Column:
    """array<struct<offset, line, hit>>: code point offset and 1-based line of each match. The pattern must not match ''.

    The texts between matches give the offsets, so the text is cut twice and never walked in Python."""
    empty = F.array().cast("array<struct<offset:int,line:int,hit:string>>")
    return F.when(text.rlike(pattern), placed(all_matches(text, pattern), F.split(text, pattern, -1))).otherwise(empty)


def placed(hits: Column, gaps: Column) -> Column:
    """array<struct<offset, line, hit>> of matches, from them and the texts around them."""

    def newlines(s: Column) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def step(state, x):
        at, line = state["at"] + F.length(x["gap"]), state["line"] + newlines(x["gap"])
        own = F.array(F.struct(at.alias("offset"), line.alias("line"), x["hit"].alias("hit")))
        return F.struct((at + F.length(x["hit"])).alias("at"), (line + newlines(x["hit"])).alias("line")), own

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return listed(pairs, F.struct(F.lit(0).alias("at"), F.lit(1).alias("line")), "struct<offset:int,line:int,hit:string>", step)


def snippet(text: Column, line: Column, around: int = 3) -> Column:
    """Lines around a 1-based line, each with its number."""
    lines, first = F.split(text, "\n"), F.greatest(F.lit(1), line - around)
    shown = F.slice(lines, first, line + around - first + 1)
    return F.array_join(F.transform(shown, lambda s, i: F.concat((first + i).cast("string"), F.lit(": "), s)), "\n")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty text. Where characters are few, each is counted by taking it
    out of the text, a byte search each; where they are many, in runs of the sorted characters."""
    n = F.length(text)
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def runs(all_):
        ends = F.filter(F.sequence(F.lit(1), F.size(all_)), lambda i: (i == F.size(all_)) | ~F.get(all_, i).eqNullSafe(F.get(all_, i - 1)))
        return let(ends, lambda e: F.zip_with(e, F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1)), lambda a, b: (a - b).cast("double")))

    def counted(distinct):
        few = F.transform(distinct, lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
        return F.when(F.size(distinct) <= 256, few).otherwise(let(F.array_sort(chars), runs))

    total = F.aggregate(let(F.array_distinct(chars), counted), F.lit(0.0), lambda a, k: a + k * F.log2(k))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def redacted(hit: Column) -> Column:
    """All but two characters at each end starred, if longer than four."""
    n = F.length(hit)
    return F.when(n > 4, F.concat(F.substring(hit, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(hit, F.lit(2)))).otherwise(hit)


def cache_key(text: Column, suffix: Column) -> Column:
    """First 16 hex digits of the sha256 of content, suffix and length."""
    return F.substring(F.sha2(F.concat_ws(":", text, suffix, F.length(text).cast("string")), 256), 1, 16)


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def mean_line_length(text: Column) -> Column:
    lines = F.split(text, "\n")
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, s: a + F.length(s)) / F.size(lines)


def comment_ratio(text: Column) -> Column:
    lines = F.split(text, "\n")
    return F.size(F.filter(lines, lambda s: F.ltrim(s).startswith("#") | F.ltrim(s).startswith("//"))) / F.size(lines)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


# Token formats, most telling first.
TOKENS = [r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b", r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b", r"\bAIza[0-9A-Za-z\-_]{20,}\b", r"\b[A-Za-z0-9]{30,}\.[A-Za-z0-9\-_.]{5,}\b"]
KEY_BLOCK = r"-----BEGIN (?:RSA|DSA|EC|OPENSSH|PGP) PRIVATE KEY-----"
JWT = r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"


def secret_value(value: Column) -> Column:
    """struct<confidence, reason> of a value that looks like a secret, else null. The first rule that holds decides."""
    v = F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")
    h = entropy(v)

    def hit(confidence, reason: str) -> Column:
        return F.struct(F.lit(confidence).alias("confidence") if not isinstance(confidence, Column) else confidence.alias("confidence"), F.lit(reason).alias("reason"))

    out = F.when(v.rlike(KEY_BLOCK), hit(0.99, "private key")).when(v.rlike(JWT), hit(0.95, "jwt"))
    for p in TOKENS:
        out = out.when(v.rlike(p), hit(0.9, "token format"))
    out = out.when(v.rlike(r"\b[a-fA-F0-9]{40,}\b"), hit(0.75, "long hex"))
    out = out.when(v.rlike(r"\b[A-Za-z0-9+/]{40,}={0,2}\b") & (h >= 4.0), hit(F.least(F.lit(0.9), 0.6 + (h - 4.0) * 0.1), "base64"))
    return out.when((F.length(v) >= 12) & (h >= 4.2), hit(F.least(F.lit(0.85), 0.5 + (h - 4.2) * 0.1), "entropy"))


def sanitized(text: Column) -> Column:
    """Comments that could carry instructions, script and control characters taken out, in this order."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", "")
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def count_in(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.4, "MEDIUM").when(score >= 0.2, "LOW").otherwise("MINIMAL")


def path_priority(path: Column) -> Column:
    """A score for scanning the telling paths first; never negative."""
    p = F.lower(path)
    gains = {"auth": 30, "login": 25, "admin": 25, "config": 20, "secret": 30, "api": 15, "exec": 20, "server": 15}
    losses = {"test": 20, "docs": 15, "example": 15, "static": 10}
    score = F.lit(50)
    for word, n in gains.items():
        score = score + F.when(F.contains(p, F.lit(word)), n).otherwise(0)
    for word, n in losses.items():
        score = score - F.when(F.contains(p, F.lit(word)), n).otherwise(0)
    return F.greatest(F.lit(0), score)


# Advice to install packages, and the note left where such advice was taken out.
INSTALLS = [r"\bpip3?\s+install\b", r"\bnpm\s+install\b", r"\byarn\s+add\b", r"\bpnpm\s+add\b", r"\bpoetry\s+add\b", r"\bconda\s+install\b", r"\bbrew\s+install\b", r"\bapt(-get)?\s+install\b", r"\bapk\s+add\b", r"\bgo\s+get\b", r"\bcargo\s+add\b", r"\bgem\s+install\b", r"\bcomposer\s+require\b"]
NOTE = "Note: External dependency installation is not permitted in remediation. Provide code/config changes within the repository only."
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def lines_of(text: Column) -> Column:
    """Lines without their ends; an end at the very last makes no further line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END, -1)


def without_advice(text: Column, patterns: list[str] = INSTALLS) -> Column:
    """The lines that match none of the patterns; where some did, the note follows, once."""
    lines = lines_of(text)
    kept = F.filter(lines, lambda s: ~s.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))
    out = F.array_join(kept, "\n")
    return F.when((F.size(kept) < F.size(lines)) & ~F.contains(out, F.lit(NOTE)), F.concat(out, F.lit("\n" + NOTE))).otherwise(out)


# Names that no one hides behind.
PLAIN_NAMES = ["formatted", "format", "result", "results", "response", "request", "data", "value", "values", "content", "contents", "output", "input", "message", "error", "errors", "schema", "config", "options", "params", "parameters", "args", "kwargs", "callback", "handler", "buffer", "stream", "reader", "writer", "parser", "parsed", "indent", "index", "count", "counter", "length", "size", "offset", "limit", "timeout", "headers", "status", "metadata", "context", "state", "cache", "temp", "temporary", "file", "files", "path", "paths", "directory", "folder", "json_string", "json_data", "validated", "validator", "expected_type"]


def suspicious_names(code: Column) -> Column:
    """Sorted names that are assigned to and look random, hexadecimal or like base64."""
    names = F.array_distinct(F.regexp_extract_all(code, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*="), F.lit(1)))

    def odd(v: Column) -> Column:
        low = F.lower(v)
        return ~low.isin(PLAIN_NAMES) & (((F.length(v) > 5) & (entropy(v) > 4.0)) | low.rlike("^[a-f0-9]{8,}$") | v.rlike("^[A-Za-z0-9+/]{8,}={0,2}$"))

    return F.sort_array(F.filter(names, odd))


def is_url(target: Column) -> Column:
    return F.coalesce(target.rlike(r"(?i)^(?:(?:https?|ftp|git|ssh)://|(?:github\.com|gitlab\.com|bitbucket\.org)/|www\.)"), F.lit(False))


def github_repository(url: Column) -> Column:
    """struct<owner, name> of a repository's address, else null."""
    shape = r"(?i)^(?:https?://)?(?:www\.)?github\.com/+([^/?#]+)/([^/?#]+)"
    named = F.struct(F.regexp_extract(url, shape, 1).alias("owner"), F.regexp_replace(F.regexp_extract(url, shape, 2), r"\.git$", "").alias("name"))
    return F.when(url.rlike(shape), named)


def normalized_github(url: Column) -> Column:
    repo = github_repository(url)
    return F.when(repo.isNotNull(), F.concat(F.lit("https://github.com/"), repo["owner"], F.lit("/"), repo["name"])).otherwise(url)


# Paths that no request may name.
BLOCKED_PATHS = [r"\.\./", r"/\.\.", r"^/etc/", r"^/var/", r"^/usr/", r"^/root/", r"^/home/[^/]+/\.", r"\.ssh/", r"\.env", r"\.git/", r"\.svn/", r"id_rsa", r"\.pem$", r"\.key$", r"shadow$", r"passwd$"]


def path_refusal(path: Column, roots: list[str]) -> Column:
    """Why an absolute path is refused (empty, restricted, outside the roots), else null. Links are not followed."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | (path == root.rstrip("/")) | path.startswith(root.rstrip("/") + "/")
    blocked = path.rlike("(?i)" + "|".join(f"(?:{p})" for p in BLOCKED_PATHS))
    return F.when(F.coalesce(path, F.lit("")) == "", "empty").when(blocked, "restricted").when(~inside, "outside")


def url_refusal(url: Column) -> Column:
    """Why a repository's address is refused, else null."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    out = F.when(F.coalesce(url, F.lit("")) == "", "empty").when(~url.rlike("(?i)^https?:"), "scheme")
    return out.when(~host.isin("github.com", "raw.githubusercontent.com"), "domain").when(~url.rlike(r"^https?://github\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+/?$"), "form")


def options_refusal(options: Column) -> Column:
    """Why a map<string, string> of scan options is refused, else null. Further options are ignored."""
    out = F.when(F.lit(False), "")
    for name in ("quick_mode", "enable_llm", "deep_scan"):
        out = out.when(F.map_contains_key(options, name) & ~F.coalesce(F.lower(options[name]).isin("true", "false"), F.lit(False)), f"{name} must be boolean")
    fits = F.coalesce(options["profile"].isin("production", "development", "security-tool"), F.lit(False))
    return out.when(F.map_contains_key(options, "profile") & ~fits, "profile is not known")
