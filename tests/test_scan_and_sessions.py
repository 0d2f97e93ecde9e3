"""The composed scan, graphs of code, sources with dots, policies of four levels, session ends, and the SQL functions."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur import sql
from larkspur.functions import python as P
from larkspur.functions import text as X
from larkspur.operators import context, detect, flows, policy, rules, scan, store
from larkspur.sources import files as sources
from larkspur.streaming import sessions

FILES = [
    ("app/run.py", "import os\nexec(input())\npassword = 'hunter2hunter2'\n"),
    ("app/run.js", "exec(input())\n"),
    ("package.json", '{"scripts": {"postinstall": "node -e require(child_process)"}}'),
    ("src/security/scan.py", "exec('x')\n"),
    ("tests/test_a.py", "exec('x')\n"),
    ("app/patterns.py", "exec('x')\n"),
    ("empty.py", None),
]


def test_deep_scan(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    got = scan.deep(files).collect()
    assert {r.path for r in got} == {"app/run.py", "package.json"} | ({"app/run.js"} & {r.path for r in got})
    assert not any(r.vector == "command_injection" for r in got if r.path == "app/run.js")
    assert {("command_injection", "CRITICAL", "exec", 2)} <= {(r.vector, r.severity, r.name, r.line) for r in got if r.source == "code"}
    assert {r.vector for r in got if r.path == "package.json"} == {"package_hijack"}
    assert {r.path for r in scan.deep(files, production=False).collect()} >= {"src/security/scan.py"}
    assert scan.deep(files.limit(0)).count() == 0


def test_gate_counts_reasons(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    got = {r.reason: r.files for r in scan.exclusions(scan.gate(files, ["*.json"])).collect()}
    assert got == {"excluded": 1, "context: test": 1, None: 5}


def test_json_secrets(spark):
    rows = [(1, json.dumps({"a": [{"api_key": "Zx81kQpLm2Wv9TrY"}], "keywords": {"token": "Zx81kQpLm2Wv9TrY"}, "password": "short", "port": 1})), (2, "no"), (3, None), (4, json.dumps({"x": "ghp_" + "a1B2" * 6}))]
    got = {(r.id, r.path, r.severity) for r in detect.json_secrets(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()}
    assert got == {(1, "$.a[0].api_key", "HIGH"), (4, "$.x", "CRITICAL")}


def test_json_leaves_at_any_depth(spark):
    deep = "1"
    for i in range(60):
        deep = json.dumps({"k": json.loads(deep)}) if i % 2 else f"[{deep}]"
    got = detect.json_leaves(spark.createDataFrame([(1, deep)], "id long, j string"), "id", "j").collect()
    assert [r.value for r in got] == ["1"] and got[0].path.count("k") == 30


@pytest.mark.parametrize("text", ["", "aaaa", "ab" * 500, "".join(map(chr, range(0x4E00, 0x4E00 + 900))) * 2])
def test_entropy_of_few_and_many_characters(spark, text):
    from collections import Counter
    from math import log2

    want = -sum(n / len(text) * log2(n / len(text)) for n in Counter(text).values()) if text else 0.0
    assert spark.createDataFrame([(text,)], "t string").select(X.entropy(F.col("t"))).first()[0] == pytest.approx(want, abs=1e-9)


def test_many_matches_are_placed(spark):
    text = "\n".join(f"x{i} 1.2.3.{i % 9}" for i in range(2000))
    import re

    got = spark.createDataFrame([(text,)], "t string").select(X.match_offsets(F.col("t"), r"[0-9]\.[0-9]\.[0-9]\.[0-9]").alias("m")).first().m
    want = [(m.start(), 1 + text.count("\n", 0, m.start()), m[0]) for m in re.finditer(r"[0-9]\.[0-9]\.[0-9]\.[0-9]", text)]
    assert [(r.offset, r.line, r.hit) for r in got] == want


def test_code_graph():
    got = P.graph_of("import a.b\nfrom flask import x\n\ndef f():\n    def g():\n        h()\n    g()\nk()\n")
    assert got["framework"] == "flask" and got["imports"] == ["a/b.py", "flask.py"]
    assert sorted((c["caller"], c["callee"]) for c in got["calls"]) == [("f", "g"), ("g", "h")]
    assert P.graph_of("def broken(") == {"framework": None, "calls": [], "imports": []}


def test_taint_findings(spark):
    rows = spark.createDataFrame([("exec", 0.9), ("file_write", 0.95), ("file_write", 0.8), ("odd", 0.9), ("network", 0.5)], "sink string, confidence double")
    got = {(r.sink, r.confidence): (r.vector, r.severity) for r in flows.taint_findings(rows).collect()}
    assert got == {("exec", 0.9): ("command_injection", "CRITICAL"), ("file_write", 0.95): ("path_traversal", "CRITICAL"), ("file_write", 0.8): ("path_traversal", "HIGH"), ("odd", 0.9): ("unknown", "HIGH")}


def test_repository_finds_security_files(spark, tmp_path):
    for name, text in ((".env", "A=1"), ("src/.netrc", "x"), ("src/a.py", "y = 1"), (".hidden.py", "z"), ("node_modules/.env", "B=2")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.text for r in sources.repository(spark, str(tmp_path)).collect()}
    assert got == {".env": "A=1", "src/.netrc": "x", "src/a.py": "y = 1"}


def test_client_configurations(spark, tmp_path):
    for name in (".cursor/config.json", ".config/Claude/claude_desktop_config.json", "other.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"mcpServers": {"s": {"command": "c"}}}')
    found = sources.discovered(spark, str(tmp_path))
    assert sorted(r.client for r in found.collect()) == ["claude", "cursor"]
    assert {r.server for r in sources.servers(found).collect()} == {"s"}


def test_every_template_compiles(spark):
    for name, _, _, _, _ in policy.TEMPLATES:
        parsed = policy.parse(policy.from_template(name))
        assert not parsed.errors and parsed.action in policy.ACTIONS, name
    assert policy.parse(policy.from_template("pii", ACTION="BLOCK")).action == "BLOCK"


def test_policies_of_four_levels():
    config = {"global": {"policies": [{"id": "g", "policy": "LOG"}]}, "clients": {"c": {"policies": [{"id": "c1", "policy": "LOG"}], "servers": {"s": {"policies": [{"id": "s1", "template": "secrets"}], "tools": {"t": {"policies": [{"id": "t1", "policy": "LOG", "priority": 3}]}}}}}}}
    assert [(p[0], p[1], p[2]) for p in policy.load(config)] == [("g", 0, ""), ("c1", 0, "c"), ("s1", 0, "c:s"), ("t1", 3, "c:s:t")]
    assert policy.load({}) == []


def test_scan_score_with_flows(spark):
    from larkspur.operators import score

    found = spark.createDataFrame([("a", "HIGH"), ("a", "HIGH")], "k string, severity string")
    met = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "k string, is_tainted boolean")
    did = spark.createDataFrame([("a", 0.8)], "k string, risk_score double")
    got = {r.k: round(r.score, 6) for r in score.score(found, "k", met, did).collect()}
    # two high findings: base 0.62; half of the flows tainted; one behavior; model score 0.4
    assert got == {"a": pytest.approx(0.7 * 0.62 + 0.05 + 0.08 + 0.04), "b": pytest.approx(0.1 + 0.02)}


def stream(spark, tmp_path, rows, schema):
    """Rows as a stream of one file each batch, in order of time."""
    folder = tmp_path / "in"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


EVENTS = "session_id string, event_id long, ts timestamp, tool string, level string"


def test_sessions_end(spark, tmp_path):
    from datetime import datetime

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    batches = [[("a", 1, at(1), "x", "HIGH"), ("b", 2, at(1), "x", "LOW")], [("a", 3, at(1, 5), "y", None), ("a", 4, at(1, 6), "session_end", None)], [("c", 5, at(9), "x", None)], [("c", 6, at(10), "x", None)], [("c", 7, at(11), "x", None)]]
    events = stream(spark, tmp_path, batches, EVENTS).withWatermark("ts", "1 minute")
    sessions.to_table(sessions.lifecycles(events, 3600_000), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    got = {(r.session_id, r.events, r.risky, r.most, r.ended) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got >= {("a", 2, 1, "HIGH", "end"), ("b", 1, 0, "LOW", "silence")}


def test_cache_and_alerts(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [("k", i, datetime(2024, 1, 1) + timedelta(minutes=m), None, None) for i, m in enumerate((0, 30, 59, 61, 90))]
    looked = stream(spark, tmp_path, [rows], EVENTS).withColumnRenamed("session_id", "key")
    seen = {}
    sessions.alerts(sessions.cache(looked, 3600), lambda rows, n: seen.update({r.event_id: r.hit for r in rows.collect()}), str(tmp_path / "cp")).awaitTermination(180)
    assert seen == {0: False, 1: True, 2: True, 3: False, 4: True}


def test_sql_functions(spark):
    assert "lk_scan" in sql.register(spark)
    r = spark.sql("SELECT lk_level(0.65D) AS a, lk_redacted('abcdefgh') AS b, lk_tokens('abcdefghi') AS c, lk_indel_ratio('abcd', 'abxd') AS d").first()
    assert (r.a, r.b, r.c, r.d) == ("HIGH", "ab****gh", 2, 0.75)
    found = spark.sql("SELECT s.name FROM VALUES ('x = yaml.load(f)'), ('plain') AS t(text), LATERAL lk_scan(t.text) AS s").collect()
    assert {r.name for r in found} == {"yaml_unsafe_load"}


def test_rollups(spark):
    found = spark.createDataFrame([("s", "x", "HIGH"), ("s", "x", "CRITICAL"), ("s", "y", "LOW")], "scan string, type string, severity string")
    results = spark.createDataFrame([("s", 0.2), ("s", 0.6), ("t", 0.5)], "scan string, risk_score double")
    got = {r.scan: (r.findings, r.critical, r.high, r.by_type) for r in store.answer_rollup(found, results).collect()}
    assert got == {"s": (3, 1, 1, {"x": 2, "y": 1}), "t": (0, 0, 0, None)}
    assert len(rules.library("registry")) == 59


def test_profiles_of_a_configuration(spark):
    got = context.profiles('{"scan_profiles": {"p": {"exclude_paths": ["**/tests/**", "*.log"], "severity_adjustments": {"test_code": "low", "other": "info"}}, "q": {}}}')
    assert got == {"p": (["**/tests/**", "*.log"], {"test": "low"}), "q": ([], {})} and context.profiles("{}") == {}
    rows = spark.createDataFrame([("a/tests/b.py",), ("x.log",), ("a/x.log",), ("x.logs",), ("tests.py",)], "path string")
    assert [r[0] for r in rows.select(context.excluded(F.col("path"), got["p"][0])).collect()] == [True, True, True, False, False]
    assert not rows.select(context.excluded(F.col("path"), []).alias("e")).first().e


def test_activity_log(spark):
    rows = spark.createDataFrame([(2, "s", "t", "2024-01-01 00:00:00.5", None), (1, "s", "t", "2024-01-01 00:00:00.5", "x"), (3, None, "t", "2024-01-01 00:00:00.5", '"')], "id long, session string, tool string, at string, note string")
    got = store.activity_log(rows.withColumn("at", F.col("at").cast("timestamp")), "session", "tool", "at", ["id"]).orderBy("id").collect()
    assert [(r.id, json.loads(r.event)) for r in got] == [
        (1, {"type": "tool_call", "session": "s", "tool": "t", "at": "2024-01-01T00:00:00.500000", "note": "x"}),
        (3, {"type": "tool_call", "tool": "t", "at": "2024-01-01T00:00:00.500000", "note": '"'}),
    ]
