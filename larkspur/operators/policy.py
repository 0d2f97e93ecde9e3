"""A small policy language, compiled to columns.

Text: the first line names the action (BLOCK, MODIFY, LOG or ALLOW); each further line is a condition, joined by AND, or by
OR where the line says so; after `THEN:` lines `SET path = value`. Operators: == != IN, NOT IN, CONTAINS, NOT CONTAINS,
MATCHES (anchored at the start), NOT MATCHES, STARTS_WITH, ENDS_WITH, > and <, and the tests CONTAINS_SECRET, CONTAINS_PII,
CONTAINS_SHELL_CHARS, PATH_TRAVERSAL on a field. A dotted path by itself
holds where the field is true. `NOT` before a condition negates it. A policy with an error never matches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("BLOCK", "MODIFY", "LOG", "ALLOW")
OPERATORS = ("NOT CONTAINS", "NOT MATCHES", "NOT IN", "STARTS_WITH", "ENDS_WITH", "CONTAINS", "MATCHES", "IN", "==", "!=", ">", "<")
TESTS = ("CONTAINS_SECRET", "CONTAINS_PII", "CONTAINS_SHELL_CHARS", "PATH_TRAVERSAL")
SHELL = [";", "|", "&", "`", "$(", "\n"]
SECRET = r"(?i)(api[_-]?key|secret|password|token)\s*[\"']?\s*[:=]|-----BEGIN [A-Z ]*PRIVATE KEY-----|\bgh[pousr]_[A-Za-z0-9]{20,}"
PII = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b|\b\d{3}-\d{2}-\d{4}\b|\b(?:\d{4}[- ]?){3}\d{4}\b"


class Policy(NamedTuple):
    action: str
    condition: list
    changes: dict
    errors: list


def value_of(text: str):
    text = text.strip()
    try:
        return json.loads(text)
    except ValueError:
        return text.strip("'\"")


def parse(text: str) -> Policy:
    lines = [s.strip() for s in text.splitlines() if s.strip() and not s.strip().startswith("#")]
    action, condition, changes, errors = (re.sub(r"\s*(?:\b(?:IF|WHEN))?\s*:?$", "", lines[0].upper()) if lines else ""), [], {}, []
    if action not in ACTIONS:
        errors.append(f"unknown action {action!r}")
    setting = False
    for line in lines[1:]:
        if line.upper().rstrip(":") == "THEN":
            setting = True
        elif setting:
            m = re.fullmatch(r"SET\s+(\S+)\s*=\s*(.+)", line)
            changes.update({m[1]: value_of(m[2])} if m else {})
            errors += [] if m else [f"not a change: {line}"]
        elif line.upper() not in ("WHEN", "WHEN:", "IF", "IF:"):
            link, body = "AND", line
            if m := re.match(r"(AND|OR|WHEN|IF)\s+", body):
                link, body = "OR" if m[1] == "OR" else "AND", body[m.end() :]
            negated = bool(m := re.match(r"NOT\s+", body))
            body = body[m.end() :] if m else body
            if m := re.fullmatch(rf"(\S+)\s+({'|'.join(TESTS)})", body):
                condition.append((link, negated, m[1], m[2], None))
            elif m := re.fullmatch(rf"(\S+)\s*({'|'.join(map(re.escape, OPERATORS))})\s*(.+)", body):
                condition.append((link, negated, m[1], m[2], value_of(m[3])))
            elif re.fullmatch(r"\w+(\.\w+)+", body):
                condition.append((link, negated, body, "IS", True))
            else:
                errors.append(f"not a condition: {line}")
    return Policy(action, condition, changes, errors)


def compare(field: Column, op: str, value) -> Column:
    """A missing field equals nothing, and reads as 'None' where its text is asked for."""
    text = F.coalesce(field.cast("string"), F.lit("None"))
    many = [str(v) for v in (value if isinstance(value, list) else [value])]
    if op == "IS":
        return F.coalesce(F.lower(field.cast("string")) == "true", F.lit(False))
    if op == "==":
        return field.cast("string").eqNullSafe(F.lit(None if value is None else str(value)))
    if op == "!=":
        return ~field.cast("string").eqNullSafe(F.lit(None if value is None else str(value)))
    if op in ("IN", "NOT IN"):
        inside = F.coalesce(field.cast("string").isin(many), F.lit(False)) if isinstance(value, list) else F.contains(F.lit(str(value)), text)
        return inside if op == "IN" else ~inside
    if op in ("CONTAINS", "NOT CONTAINS"):
        inside = F.lit(False)
        for v in many:
            inside = inside | F.contains(text, F.lit(v))
        return inside if op == "CONTAINS" else ~inside
    if op in ("MATCHES", "NOT MATCHES"):
        hit = text.rlike(f"^(?:{value})")
        return hit if op == "MATCHES" else ~hit
    if op in ("STARTS_WITH", "ENDS_WITH"):
        out = F.lit(False)
        for v in many:
            out = out | (text.startswith(v) if op == "STARTS_WITH" else text.endswith(v))
        return out
    number = field.try_cast("double")
    return F.coalesce(number > float(value) if op == ">" else number < float(value), F.lit(False))


def test(field: Column, name: str) -> Column:
    text = F.coalesce(field.cast("string"), F.lit("None"))
    if name == "CONTAINS_SECRET":
        return text.rlike(SECRET)
    if name == "CONTAINS_PII":
        return text.rlike(PII)
    words = SHELL if name == "CONTAINS_SHELL_CHARS" else ["../", "..\\"]
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def compiled(policy: Policy, field: Callable[[str], Column]) -> Column:
    """Whether the policy matches. field: a column for each dotted path. OR binds what stands before it to what follows."""
    if policy.errors:
        return F.lit(False)
    out = F.lit(True)
    for i, (link, negated, path, op, value) in enumerate(policy.condition):
        hit = test(field(path), op) if op in TESTS else compare(field(path), op, value)
        hit = ~hit if negated else hit
        out = hit if i == 0 else (out | hit if link == "OR" else out & hit)
    return out


def _unseen(changes: Column, seen: Column) -> Column:
    return F.filter(F.map_entries(changes), lambda e: ~F.array_contains(seen, e["key"]))


def resolve(rows: DataFrame, policies: list[tuple[str, int, str, str]], field: Callable[[str], Column], scope: Column | None = None) -> DataFrame:
    """rows with action, policy and changes. policies: (id, priority, scope, text); scope '' holds everywhere, others where the
    row's array of scopes has them. Higher priority first, then id: the first BLOCK decides; else the SETs of all MODIFY
    policies merge, earlier ones winning; else LOG, else ALLOW."""
    ranked = sorted(policies, key=lambda p: (-p[1], p[0]))
    hits = []
    for name, _, where, text in ranked:
        parsed = parse(text)
        hit = compiled(parsed, field)
        if where and scope is not None:
            hit = hit & F.array_contains(scope, where)
        hits.append((name, parsed, hit))

    def first(action: str) -> Column:
        own = [F.when(hit, F.lit(name)) for name, p, hit in hits if p.action == action]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    block, modify, log = first("BLOCK"), first("MODIFY"), first("LOG")
    changes = F.create_map().cast("map<string,string>")
    merged = [F.when(hit, F.create_map(*[F.lit(x) for k, v in p.changes.items() for x in (k, str(v))])).otherwise(changes) for name, p, hit in hits if p.action == "MODIFY" and p.changes]
    if merged:
        out = F.array().cast("array<struct<key:string,value:string>>")
        for m in merged:
            out = F.concat(out, _unseen(m, F.transform(out, lambda e: e["key"])))
        changes = F.map_from_entries(out)
    action = F.when(block.isNotNull(), "BLOCK").when(modify.isNotNull(), "MODIFY").when(log.isNotNull(), "LOG").otherwise("ALLOW")
    return rows.withColumn("action", action).withColumn("policy", F.coalesce(block, modify, log)).withColumn("changes", F.when(block.isNull(), changes))


def render(template: str, values: dict, defaults: dict | None = None) -> str:
    """A policy template with its `{{ name }}` places filled: lists as JSON, strings quoted, other values as they print."""

    def told(value) -> str:
        return json.dumps(value) if isinstance(value, list) else f'"{value}"' if isinstance(value, str) else str(value)

    out = template
    for name, value in {**(defaults or {}), **values}.items():
        out = out.replace(f"{{{{ {name} }}}}", told(value))
    return out.strip()


# Built-in templates (name, category, severity, text, defaults).
TEMPLATES = [
    ("secrets", "data_protection", "critical", "BLOCK IF:\n    response CONTAINS_SECRET\n    AND tool.name NOT IN {{ WHITELIST }}", {"WHITELIST": []}),
    ("pii", "data_protection", "high", "{{ ACTION }} IF:\n    response CONTAINS_PII\n    AND NOT tool.sanitize_enabled\n    AND server.name NOT IN {{ TRUSTED_SERVERS }}", {"ACTION": "LOG", "TRUSTED_SERVERS": []}),
    ("command_injection", "injection", "critical", "BLOCK IF:\n    params CONTAINS_SHELL_CHARS\n    AND tool.name IN {{ DANGEROUS_TOOLS }}", {"DANGEROUS_TOOLS": ["exec", "system", "popen", "eval", "shell"]}),
    ("path_traversal", "injection", "high", 'BLOCK IF:\n    params PATH_TRAVERSAL\n    OR params.path CONTAINS "../"\n    OR params.file CONTAINS "../"', {}),
    ("network_exfiltration", "exfiltration", "high", "{{ ACTION }} IF:\n    tool.name IN {{ NETWORK_TOOLS }}\n    AND params.url NOT MATCHES {{ ALLOWED_DOMAINS }}", {"ACTION": "BLOCK", "NETWORK_TOOLS": ["http_post", "http_put", "send_data", "upload"], "ALLOWED_DOMAINS": r"^https://(.*\.)?example\.com/.*$"}),
    ("filesystem_access", "access_control", "medium", '{{ ACTION }} IF:\n    tool.name IN ["read_file", "write_file", "delete_file"]\n    AND params.path STARTS_WITH {{ RESTRICTED_PATHS }}', {"ACTION": "BLOCK", "RESTRICTED_PATHS": ["/etc/", "/sys/", "/proc/", "~/.ssh/", "~/.aws/"]}),
    ("env_access", "access_control", "high", 'BLOCK IF:\n    tool.name == "read_env"\n    AND params.name IN {{ SENSITIVE_VARS }}', {"SENSITIVE_VARS": ["AWS_SECRET_ACCESS_KEY", "GITHUB_TOKEN", "OPENAI_API_KEY", "DATABASE_PASSWORD"]}),
    ("disable_tool", "access_control", "varies", "BLOCK IF:\n    tool.name IN {{ DISABLED_TOOLS }}", {"DISABLED_TOOLS": []}),
    ("rate_limit", "rate_limiting", "low", "BLOCK IF:\n    tool.name == {{ TOOL_NAME }}\n    AND session.tool_count[{{ TOOL_NAME }}] > {{ MAX_CALLS }}", {"TOOL_NAME": "", "MAX_CALLS": 10}),
    ("sanitize_output", "data_protection", "medium", 'MODIFY IF:\n    tool.name == {{ TOOL_NAME }}\n    AND response CONTAINS_PII\nTHEN:\n    SET response = "[REDACTED]"', {"TOOL_NAME": ""}),
    ("env_file_protection", "data_protection", "critical", 'BLOCK IF:\n    tool.name IN {{ FILE_TOOLS }}\n    AND params.path CONTAINS ".env"', {"FILE_TOOLS": ["read_file", "cat", "head", "tail", "less", "more", "grep"]}),
    ("env_command_protection", "data_protection", "high", "BLOCK IF:\n    tool.name IN {{ ENV_COMMANDS }}", {"ENV_COMMANDS": ["env", "printenv", "set"]}),
    ("bash_env_protection", "data_protection", "high", 'BLOCK IF:\n    tool.name == "bash"\n    AND params.command CONTAINS "env"', {}),
    ("env_var_redaction", "data_protection", "high", 'MODIFY IF:\n    response CONTAINS_SECRET\n    OR response CONTAINS {{ SENSITIVE_PATTERNS }}\nTHEN:\n    SET response = "[REDACTED - SENSITIVE ENVIRONMENT DATA]"', {"SENSITIVE_PATTERNS": ["API_KEY=", "SECRET=", "PASSWORD=", "TOKEN="]}),
]


def from_template(name: str, **values) -> str:
    """The text of a built-in template with its places filled; an action is a bare word."""
    text, defaults = next((t, d) for n, _, _, t, d in TEMPLATES if n == name)
    given = {**defaults, **values}
    return render(text.replace("{{ ACTION }}", str(given.pop("ACTION", ""))), given)


def load(config: dict) -> list[tuple[str, int, str, str]]:
    """Policies (id, priority, scope, text) of a configuration of four levels: global, client, client:server,
    client:server:tool. An entry has `id` or `name`, `policy` or `content` (its text) or `template` with `variables`, and a
    `priority`; one that is not enabled is left out."""

    def own(entries: list[dict], scope: str) -> list[tuple[str, int, str, str]]:
        out = []
        for i, e in enumerate(entries or []):
            if e.get("enabled", True):
                text = from_template(e["template"], **e.get("variables", {})) if "template" in e else e.get("policy", e.get("content", ""))
                out.append((e.get("id") or e.get("name") or f"{scope}#{i}", int(e.get("priority", 0)), scope, text))
        return out

    def below(node: dict, levels: tuple, scope: str) -> list[tuple[str, int, str, str]]:
        out = own(node.get("policies"), scope)
        for name, child in (node.get(levels[0]) or {}).items() if levels else ():
            out += below(child, levels[1:], f"{scope}:{name}" if scope else name)
        return out

    return own((config.get("global") or {}).get("policies"), "") + below({"clients": config.get("clients")}, ("clients", "servers", "tools"), "")


def scopes(client: Column, server: Column, tool: Column) -> Column:
    """The scopes in which a call lies: '', its client, client:server, client:server:tool."""
    return F.array(F.lit(""), client, F.concat_ws(":", client, server), F.concat_ws(":", client, server, tool))
