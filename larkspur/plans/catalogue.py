"""The queries over the driver's tables, and the same questions in SQL.

documents and pages stand for files, events for tool calls (user_id: session, event_type: tool), orders and lineitem for
runs and threats, part for tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import answers
from larkspur.functions import text as X
from larkspur.operators import context, detect, flows, linewise, policy, prompts, ranking, report, rules, score, signatures, store, tools
from larkspur.session import ship, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Kinds whose patterns mean the same in every engine on text that is not ASCII.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = r"(?:[0-9]{4}[- ]?){3}[0-9]{4}"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
# The same matches for the Java engine, which would try every start within a run: a match starts where a run does or where
# the last match ended.
EMAIL_FAST = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
KINDS = {"email": EMAIL, "credit_card": CARD, "ip_address": IP}
_UNION = " UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS hit FROM documents" for k, p in KINDS.items())


def _docs(spark, sf_dir, *columns):
    """Documents for work on whole texts."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def _personal(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "lang", "text")

    def of(kind: str, pattern: str):
        return F.transform(X.all_matches(F.col("text"), EMAIL_FAST if kind == "email" else pattern), lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("hit")))

    each = F.concat(*[of(k, p) for k, p in KINDS.items()])
    return docs.select("doc_id", "lang", F.explode(each).alias("f")).select("doc_id", "lang", "f.*")


@query(f"""SELECT f.lang, f.kind, count(*) AS findings, count(DISTINCT f.doc_id) AS documents, count(DISTINCT l.doc_id) AS labelled
FROM ({_UNION}) f LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
def pii_counts_by_lang(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("l"))
    return _personal(spark, sf_dir).join(labels, "doc_id", "left").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("l").alias("labelled"))


@query(f"""SELECT doc_id, kind, CASE WHEN length(hit) > 4 THEN left(hit, 2) || repeat('*', length(hit) - 4) || right(hit, 2) ELSE hit END AS redacted, count(*) AS n
FROM ({_UNION}) GROUP BY ALL""")
def pii_redacted_findings(spark, sf_dir):
    return _personal(spark, sf_dir).select("doc_id", "kind", X.redacted(F.col("hit")).alias("redacted")).groupBy("doc_id", "kind", "redacted").agg(F.count(F.lit(1)).alias("n"))


# Patterns of prose and markup, so that the driver's tables have hits.
PROBES = {"markup": [r"<script[^>]*>", r"<!-- ", r"style="], "symbols": [r"[#%$&*]{3}", r"!!"], "secrets": [r"(?i)(api[_-]?key|secret|password|token)\s*[:=]", r"AKIA[0-9A-Z]{8,}"], "licences": [r"(?i)licen[cs]e", r"GNU General Public"]}


@query(" UNION ALL ".join(f"SELECT '{s}' AS source, '{c}' AS category, {i} AS rule, CAST(sum(len(regexp_extract_all({t}, '{p}'))) AS BIGINT) AS hits, count(*) FILTER (WHERE regexp_matches({t}, '{p}')) AS texts FROM {s}" for s, t in (("documents", "text"), ("pages", "html")) for c, ps in PROBES.items() for i, p in enumerate(ps)))
def pattern_hits_by_category(spark, sf_dir):
    out = None
    for s, t in (("documents", "text"), ("pages", "html")):
        probes = [(c, i, p) for c, ps in PROBES.items() for i, p in enumerate(ps)]
        each = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i).alias("rule"), F.regexp_count(t, F.lit(p)).alias("n")) for c, i, p in probes])
        rows = spread(table(spark, sf_dir, s).select(t)).select(F.lit(s).alias("source"), F.explode(each).alias("x")).select("source", "x.*")
        rows = rows.groupBy("source", "category", "rule").agg(F.sum("n").alias("hits"), F.count(F.when(F.col("n") > 0, 1)).alias("texts"))
        out = rows if out is None else out.unionByName(rows)
    return out


_LINES = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"""SELECT doc_id, line, CASE WHEN regexp_matches(s, '[#%$&*]{{3}}') THEN 0 ELSE 1 END AS rule,
  CASE WHEN regexp_matches(s, '[#%$&*]{{3}}') THEN regexp_extract(s, '[#%$&*]{{3}}') ELSE regexp_extract(s, '[A-Z]{{4,}}') END AS hit
FROM ({_LINES}) WHERE regexp_matches(s, '[#%$&*]{{3}}|[A-Z]{{4,}}')""")
def line_first_match(spark, sf_dir):
    own = [rules.Rule("probe", "noise", str(i), p, "LOW", 0.9) for i, p in enumerate((r"[#%$&*]{3}", r"[A-Z]{4,}"))]
    return detect.first_by_line(table(spark, sf_dir, "documents"), own).select("doc_id", F.col("line").cast("long"), F.col("name").cast("int").alias("rule"), "hit")


@query(f"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS m, string_split_regex(text, '{EMAIL}') AS g FROM documents WHERE text IS NOT NULL)
SELECT doc_id, x.o AS "offset", x.h AS hit, x.l AS line FROM (SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
  'o': CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS INTEGER), 'h': m[i],
  'l': CAST(1 + list_sum(list_transform(g[1:i], lambda s: length(s) - length(replace(s, chr(10), '')))) AS INTEGER)}})) AS x FROM c)""")
def match_offsets(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(X.match_offsets(F.col("text"), EMAIL_FAST)).alias("m")).select("doc_id", "m.offset", "m.hit", "m.line")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY ALL),
p AS (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY doc_id""")
def char_entropy(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.round(X.entropy(F.col("text")), 6).alias("entropy"))


@query("SELECT doc_id, left(sha256(text || ':' || coalesce(lang, '') || ':' || length(text)), 16) AS cache_key FROM documents")
def content_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.cache_key(F.col("text"), F.coalesce("lang", F.lit(""))).alias("cache_key"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


_SECRET = r"(?i)(?:password|secret|token|api[_-]?key)\s*[:=]\s*([^\s,;]{4,})"


@query(f"SELECT doc_id, line, regexp_extract(s, '{_SECRET}', 1) AS value FROM ({_LINES}) WHERE length(s) <= 400 AND regexp_matches(s, '{_SECRET}')")
def secret_line_candidates(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "s"))
    return lines.filter((F.length("s") <= 400) & F.col("s").rlike(_SECRET)).select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.regexp_extract("s", _SECRET, 1).alias("value"))


@query(f"SELECT conv_id, turn, line, regexp_extract(s, '{_SECRET}', 1) AS value FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM conversations) WHERE length(s) <= 400 AND regexp_matches(s, '{_SECRET}')")
def secret_turn_candidates(spark, sf_dir):
    """As `secret_line_candidates`, of conversations."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "s"))
    return lines.filter((F.length("s") <= 400) & F.col("s").rlike(_SECRET)).select("conv_id", "turn", (F.col("at") + 1).cast("long").alias("line"), F.regexp_extract("s", _SECRET, 1).alias("value"))


@query()
def secret_findings(spark, sf_dir):
    return detect.secrets(table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, round(list_sum(list_transform(l, lambda s: length(s))) / len(l), 6) AS mean_line,
  round(len(list_filter(l, lambda s: starts_with(ltrim(s, ' '), '#') OR starts_with(ltrim(s, ' '), '//'))) / len(l), 6) AS comments FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def text_metrics(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.tokens_estimate(t).alias("tokens"), F.round(X.mean_line_length(t), 6).alias("mean_line"), F.round(X.comment_ratio(t), 6).alias("comments"))


_PRIORITY = "greatest(0, 50" + "".join(f" + CASE WHEN contains(lower(url), '{w}') THEN {n} ELSE 0 END" for w, n in {"auth": 30, "login": 25, "admin": 25, "config": 20, "secret": 30, "api": 15, "exec": 20, "server": 15, "test": -20, "docs": -15, "example": -15, "static": -10}.items()) + ")"


@query(f"SELECT page_id, {_PRIORITY} AS score FROM pages ORDER BY score DESC, page_id LIMIT 50")
def priority_topk(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.path_priority(F.col("url")).alias("score")).orderBy(F.desc("score"), "page_id").limit(50)


#: A stand-in rule set with hits in prose: vector, pattern, severity.
VECTORS = [("code_obfuscation", r"[#%$&*]{3}", "HIGH"), ("prompt_injection", r"!!", "CRITICAL"), ("data_exfiltration", EMAIL, "MEDIUM"), ("network_backdoor", IP, "HIGH"), ("tool_poisoning", r" \| ", "LOW")]
_FINDINGS = " UNION ALL ".join(f"SELECT doc_id, source, lang, '{v}' AS category, '{s}' AS severity FROM documents WHERE regexp_matches(text, '{p}')" for v, p, s in VECTORS)


def _findings(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "source", "lang", "text")
    each = F.filter(F.array(*[F.when(F.col("text").rlike(EMAIL_FAST if p == EMAIL else p), F.struct(F.lit(v).alias("category"), F.lit(s).alias("severity"))) for v, p, s in VECTORS]), lambda x: x.isNotNull())
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("f")).select("doc_id", "source", "lang", "f.*")


def _remap_sql(purpose: str) -> str:
    cases = " ".join(f"WHEN {purpose} = '{p}' AND severity = '{a}' THEN '{b}'" for p, kind in context.PROFILE.items() for a, b in zip(context.SEVERITIES, context.ADJUST[kind], strict=True))
    return f"CASE {cases} ELSE severity END"


_PURPOSE = "CASE WHEN source IN ('src1', 'src2') THEN 'test' WHEN source IN ('src3', 'src4') THEN 'example' WHEN source = 'src5' THEN 'generated' ELSE 'production' END"


@query(f"SELECT severity, purpose, count(*) AS findings FROM (SELECT {_remap_sql('purpose')} AS severity, purpose FROM (SELECT severity, {_PURPOSE} AS purpose FROM ({_FINDINGS}))) WHERE severity <> 'IGNORE' GROUP BY ALL")
def context_severity_remap(spark, sf_dir):
    s = F.col("source")
    purpose = F.when(s.isin("src1", "src2"), "test").when(s.isin("src3", "src4"), "example").when(s == "src5", "generated").otherwise("production")
    return context.apply(_findings(spark, sf_dir).withColumn("purpose", purpose)).groupBy("severity", "purpose").agg(F.count(F.lit(1)).alias("findings"))


def _has(column: str, words: list[str]) -> str:
    """SQL: the column holds one of the words."""
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_PURPOSE = f"""CASE WHEN {_has("p", ["/test/", "/tests/", "_test.py", "/test_"])} OR {_has("h", context.CONTENT["test"])} THEN 'test' WHEN {_has("p", context.PATHS["example"])} OR {_has("h", context.CONTENT["example"])} THEN 'example'
WHEN {_has("p", context.PATHS["security_tool"])} OR len(regexp_extract_all(h, 'class \\w*(?:Analyzer|Scanner|Detector|Auditor)|def (?:detect|scan|analyze|audit)_')) >= 2 THEN 'security_tool' WHEN {_has("p", context.PATHS["generated"])} OR {_has("h", context.CONTENT["generated"])} THEN 'generated' ELSE 'production' END"""


@query(f"SELECT page_id, purpose, CAST(CASE purpose WHEN 'test' THEN 0.95 WHEN 'security_tool' THEN 0.85 WHEN 'production' THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence FROM (SELECT page_id, {_PURPOSE} AS purpose FROM (SELECT page_id, '/' || lower(coalesce(url, '')) AS p, coalesce(html, '') AS h FROM pages))")
def file_context(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", context.classify(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("c")).select("page_id", "c.*")


_BASE = """CASE WHEN n_critical > 0 THEN least(1.0, 0.85 + 0.05 * (n_critical - 1)) WHEN n_high > 0 THEN least(0.85, CASE WHEN n_high >= 10 THEN 0.8 WHEN n_high >= 5 THEN 0.7 ELSE 0.6 END + 0.02 * (n_high - 1))
  WHEN n_medium > 0 THEN least(0.59, 0.4 + 0.03 * (n_medium - 1)) WHEN n_low > 0 THEN least(0.39, 0.2 + 0.02 * (n_low - 1)) WHEN n_info > 0 THEN 0.1 ELSE 0.0 END"""


_FLOWS = f"""SELECT d.source, s.doc_id, s.t AS source_type, k.t AS sink_type FROM (SELECT doc_id, 'user_input' AS t FROM documents WHERE regexp_matches(text, '!!') UNION ALL SELECT doc_id, 'network' FROM documents WHERE regexp_matches(text, '{IP}')) s
JOIN (SELECT doc_id, 'command_execution' AS t FROM documents WHERE regexp_matches(text, '[#%$&*]{{3}}') UNION ALL SELECT doc_id, 'file_write' FROM documents WHERE length(text) > 1000) k USING (doc_id) JOIN documents d USING (doc_id)"""
_PAIR = "CASE WHEN source_type = 'user_input' AND sink_type = 'command_execution' THEN 1.0 WHEN source_type = 'network' AND sink_type = 'command_execution' THEN 0.9 WHEN source_type = 'user_input' THEN 0.6 ELSE 0.3 END"


@query(f"""WITH n AS (SELECT source, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s.lower()}" for s in rules.RANK)} FROM ({_FINDINGS}) GROUP BY source),
w AS (SELECT source, count(*) FILTER (WHERE {_PAIR} > 0.3) AS n_tainted, count(*) FILTER (WHERE {_PAIR} > 0.3) / count(*) AS flow FROM ({_FLOWS}) GROUP BY source),
h AS (SELECT source, 0.8 AS behavior FROM ({_FINDINGS}) GROUP BY source HAVING count(DISTINCT category) >= 3),
j AS (SELECT source, {', '.join(f'coalesce(n_{s.lower()}, 0) AS n_{s.lower()}' for s in rules.RANK)}, coalesce(n_tainted, 0) AS n_tainted, coalesce(flow, 0) AS flow, coalesce(behavior, 0) AS behavior FROM n FULL JOIN w USING (source) FULL JOIN h USING (source)),
b AS (SELECT *, CAST({_BASE} AS DOUBLE) AS base, least(1.0, CASE WHEN n_critical > 0 THEN 0.5 ELSE 0 END + CASE WHEN n_high > 1 THEN 0.2 ELSE 0 END + CASE WHEN n_tainted > 0 THEN 0.2 ELSE 0 END) AS ml FROM j),
s AS (SELECT *, 0.7 * base + 0.1 * flow + 0.1 * behavior + 0.1 * ml AS raw FROM b), f AS (SELECT source, n_critical, n_high, least(1.0, CASE WHEN base >= 0.85 THEN greatest(raw, 0.8) WHEN base >= 0.6 THEN greatest(raw, 0.6) ELSE raw END) AS score FROM s)
SELECT source, n_critical, n_high, CAST(round(score, 6) AS DOUBLE) AS score, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' WHEN score >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS level FROM f""")
def threat_score(spark, sf_dir):
    found = _findings(spark, sf_dir)
    met = _flow_pairs(spark, sf_dir, "source")
    out = score.score(found, "source", met.select("source", "is_tainted"), score.multi_vector(found, "source", place="doc_id").select("source", "risk_score"))
    return out.select("source", "n_critical", "n_high", F.round("score", 6).alias("score"), "level")


@query(f"SELECT source, count(DISTINCT category) AS vectors, count(DISTINCT doc_id) AS files, 'multi_vector_attack' AS behavior, CAST(0.8 AS DOUBLE) AS risk_score FROM ({_FINDINGS}) GROUP BY source HAVING count(DISTINCT category) >= 3")
def multi_vector_behavior(spark, sf_dir):
    return score.multi_vector(_findings(spark, sf_dir), "source", place="doc_id")


RISKS = {"injection": ["prompt_injection", "tool_poisoning"], "exfiltration": ["data_exfiltration", "network_backdoor"], "stealth": ["code_obfuscation", "tool_poisoning"]}
_RANK = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.RANK.items()) + " END"


@query(" UNION ALL ".join(f"SELECT '{k}' AS risk, count(*) AS findings, max({_RANK}) AS worst FROM ({_FINDINGS}) WHERE category IN ({', '.join(map(repr, v))}) HAVING count(*) > 0" for k, v in RISKS.items()))
def risk_matrix(spark, sf_dir):
    return score.risk_matrix(_findings(spark, sf_dir), RISKS)


@query(f"""WITH p AS (SELECT l.doc_id, d.lang, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS a, CASE WHEN regexp_matches(d.text, '[#%$&*]{{3}}|!!| \\| ') THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE a = 1 AND p = 1) AS tp, count(*) FILTER (WHERE a = 0 AND p = 1) AS fp, count(*) FILTER (WHERE a = 0 AND p = 0) AS tn, count(*) FILTER (WHERE a = 1 AND p = 0) AS fn FROM p GROUP BY lang),
r AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT lang, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM r""")
def classifier_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").rlike(r"[#%$&*]{3}|!!| \| ").cast("int").alias("p"))
    rows = table(spark, sf_dir, "labels").withColumn("a", (F.col("quality") == 0).cast("int")).join(docs, "doc_id")
    out = score.classifier_metrics(rows, "a", "p", "lang")
    return out.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("SELECT o_orderpriority, l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def severity_vector_distribution(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("SELECT l_partkey, count(*) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def top_files_distinct_severity(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))
    return out.orderBy(F.desc("n"), "l_partkey").limit(10)


@query("SELECT count(DISTINCT o_custkey) AS repositories, count(DISTINCT o_orderkey) AS runs, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS most, round(sum(o_totalprice), 2) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders")
def store_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("repositories"), F.countDistinct("o_orderkey").alias("runs"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("most"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("finished"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_runs_left_join(spark, sf_dir):
    recent = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    return recent.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def not_in_active(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT event_id, user_id FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 100)")
def lru_eviction(spark, sf_dir):
    return store.evict(table(spark, sf_dir, "events"), 100, "ts", "event_id").select("event_id", "user_id")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3")
def top_n_per_vector(spark, sf_dir):
    out = store.top_in_group(table(spark, sf_dir, "lineitem"), "l_returnflag", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 3)
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", F.col("rank").cast("long"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_run_per_key(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, count(*) AS risky FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id")
def high_risk_sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase")).groupBy("user_id").agg(F.count(F.lit(1)).alias("risky"))


@query("SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS tools, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) AS most, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def session_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_type").alias("tools"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.max("value").alias("most"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


PAIRS = [(["view", "click"], ["purchase"], "READ_THEN_SEND"), (["signup"], ["error"], "FETCH_THEN_RUN")]
EVENT = {"session": "user_id", "order": ("ts", "event_id"), "tool": "event_type"}


@query("""SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') AND n = 'purchase' THEN 'READ_THEN_SEND' ELSE 'FETCH_THEN_RUN' END AS flow FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
WHERE (event_type IN ('view', 'click') AND n = 'purchase') OR (event_type = 'signup' AND n = 'error')""")
def adjacent_toxic_flow(spark, sf_dir):
    return flows.adjacent(table(spark, sf_dir, "events"), PAIRS, **EVENT).select("user_id", "event_id", "flow")


@query("""SELECT b.user_id, b.event_id, count(*) AS sources_before FROM events a JOIN events b ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id)
WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY ALL""")
def ordered_pair_flow(spark, sf_dir):
    return flows.ordered(table(spark, sf_dir, "events"), ["signup"], ["purchase"], **EVENT).select("user_id", "event_id", "sources_before")


@query("""SELECT event_id, event_type, round(m + 1e-8, 5) AS mean_before FROM (SELECT *, avg(value) OVER w AS m, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING))
WHERE n >= 10 AND (value > 3 * m OR value < 0.3 * m)""")
def output_drift(spark, sf_dir):
    return flows.drift(table(spark, sf_dir, "events"), "user_id", "value", ("ts", "event_id")).select("event_id", "event_type", F.round(F.col("mean_before") + 1e-8, 5).alias("mean_before"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-8, 5) AS mean FROM events")
def running_mean_risk(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w) + 1e-8, 5).alias("mean"))


@query(f"""SELECT source, doc_id, hits FROM (SELECT *, coalesce(sum(hits) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT source, doc_id, len(regexp_extract_all(text, '!!')) + len(regexp_extract_all(text, '{IP}')) AS hits FROM documents)) WHERE before < 3""")
def early_exit_prefix(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("source", "doc_id", (F.regexp_count("text", F.lit("!!")) + F.regexp_count("text", F.lit(IP))).cast("long").alias("hits"))
    return store.until_threshold(hits, "source", ["doc_id"], F.col("hits"), 3).select("source", "doc_id", "hits")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_in_window FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, ts FROM events)")
def rate_limit_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return store.within(events, "user_id", "s", 86400).select("event_id", "n_in_window")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, n, min(i) FILTER (WHERE event_type = 'signup') AS a, min(i) FILTER (WHERE event_type = 'view') AS b, min(i) FILTER (WHERE event_type = 'purchase') AS c FROM r GROUP BY ALL)
SELECT user_id, 'funnel' AS pattern, round(CASE WHEN n > 1 THEN 1 - (greatest(a, b, c) - least(a, b, c)) / (n - 1) ELSE 1 END, 6) AS confidence FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""")
def behavior_sequence(spark, sf_dir):
    out = flows.behaviors(table(spark, sf_dir, "events"), {"funnel": ["signup", "view", "purchase"]}, "user_id", "ts", "event_id", "event_type")
    return out.select("user_id", "pattern", F.round("confidence", 6).alias("confidence"))


POLICIES = [
    ("block-errors", 100, "", "BLOCK\nWHEN tool == error\nAND props.k > 90"),
    ("cap-purchases", 50, "", "MODIFY\nWHEN tool IN [\"purchase\", \"signup\"]\nAND value > 200\nTHEN:\nSET params.limit = 200"),
    ("tag-low", 40, "", "MODIFY\nWHEN tool STARTS_WITH purch\nTHEN:\nSET params.tag = low\nSET params.limit = 1"),
    ("log-clicks", 10, "", "LOG\nWHEN tool MATCHES cl\nAND NOT value < 10"),
]


@query("""SELECT event_id, CASE WHEN b THEN 'BLOCK' WHEN m1 OR m2 THEN 'MODIFY' WHEN l THEN 'LOG' ELSE 'ALLOW' END AS action, CASE WHEN b THEN 'block-errors' WHEN m1 THEN 'cap-purchases' WHEN m2 THEN 'tag-low' WHEN l THEN 'log-clicks' END AS policy,
  CASE WHEN NOT b THEN CASE WHEN m1 THEN '200' WHEN m2 THEN '1' END END AS "limit" FROM (SELECT event_id, event_type = 'error' AND coalesce(CAST(props->>'$.k' AS DOUBLE), 0) > 90 AS b, event_type IN ('purchase', 'signup') AND coalesce(value, 0) > 200 AS m1, starts_with(event_type, 'purch') AS m2, starts_with(event_type, 'cl') AND NOT coalesce(value < 10, false) AS l FROM events)""")
def policy_verdicts(spark, sf_dir):
    def field(path: str):
        return F.get_json_object("props", "$." + path[6:]) if path.startswith("props.") else F.col({"tool": "event_type"}.get(path, path))

    out = policy.resolve(table(spark, sf_dir, "events"), POLICIES, field)
    return out.select("event_id", "action", "policy", F.try_element_at("changes", F.lit("params.limit")).alias("limit"))


@query("SELECT event_id, '$.k' AS path, props->>'$.k' AS value FROM events WHERE props->>'$.k' IS NOT NULL")
def json_key_walk(spark, sf_dir):
    return detect.json_leaves(table(spark, sf_dir, "events"), "event_id", "props")


@query(f"""WITH d AS (SELECT doc_id, 'static' AS origin, 0.8 AS c FROM documents WHERE regexp_matches(text, '!!') UNION ALL SELECT doc_id, 'entropy', 0.6 FROM documents WHERE length(text) > 4000 UNION ALL SELECT doc_id, 'label', 0.9 FROM labels WHERE quality = 0)
SELECT doc_id, count(DISTINCT origin) AS origins, round(least(1.0, avg(c) * (1 + 0.2 * (count(DISTINCT origin) - 1))), 6) AS confidence FROM d GROUP BY doc_id HAVING count(DISTINCT origin) >= 2""")
def source_confirmation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = [docs.filter(F.contains("text", F.lit("!!"))).select("doc_id", F.lit("static").alias("origin"), F.lit(0.8).alias("confidence")), docs.filter(F.length("text") > 4000).select("doc_id", F.lit("entropy").alias("origin"), F.lit(0.6).alias("confidence")), table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit("label").alias("origin"), F.lit(0.9).alias("confidence"))]
    return score.confirmed(*parts, key=["doc_id"]).select("doc_id", "origins", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH s AS (SELECT doc_id, 'user_input' AS source_type FROM documents WHERE regexp_matches(text, '!!') UNION ALL SELECT doc_id, 'network' FROM documents WHERE regexp_matches(text, '{IP}')),
k AS (SELECT doc_id, 'command_execution' AS sink_type FROM documents WHERE regexp_matches(text, '[#%$&*]{{3}}') UNION ALL SELECT doc_id, 'file_write' FROM documents WHERE length(text) > 1000)
SELECT doc_id, source_type, sink_type, CAST(CASE WHEN source_type = 'user_input' AND sink_type = 'command_execution' THEN 1.0 WHEN source_type = 'network' AND sink_type = 'command_execution' THEN 0.9 WHEN source_type = 'user_input' THEN 0.6 ELSE 0.3 END AS DOUBLE) AS risk_score FROM s JOIN k USING (doc_id)""")
def flow_pairs(spark, sf_dir):
    return _flow_pairs(spark, sf_dir).select("doc_id", "source_type", "sink_type", "risk_score")


def _flow_pairs(spark, sf_dir, *keep):
    docs, t = table(spark, sf_dir, "documents"), F.col("text")

    def parts(name, kinds, *keep):
        return docs.select("doc_id", *keep, F.explode(F.filter(F.array(*[F.when(c, k) for k, c in kinds.items()]), lambda x: x.isNotNull())).alias(name))

    sources = parts("source_type", {"user_input": F.contains(t, F.lit("!!")), "network": t.rlike(IP)}, *keep)
    sinks = parts("sink_type", {"command_execution": t.rlike(r"[#%$&*]{3}"), "file_write": F.length(t) > 1000})
    return flows.pairs(sources, sinks, "doc_id")


@query()
def fuzzy_similar_parts(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_type").alias("p_type"))
    return signatures.similar(names, "p_name", [("p_name", 0.7), ("p_type", 0.3)], 0.6)


@query("""WITH l AS (SELECT event_id, user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, CASE WHEN b IS NULL THEN 'new' WHEN b = event_type THEN 'known' ELSE 'modified' END AS status, 1 + coalesce(sum(CASE WHEN b = event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS times_seen FROM l""")
def signature_changes(spark, sf_dir):
    return signatures.statuses(table(spark, sf_dir, "events"), "user_id", "event_type", ("ts", "event_id")).select("event_id", "status", "times_seen")


@query()
def merkle_root(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2("text", 512).alias("sha512"))
    return signatures.merkle_root(docs)


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"


@query(f"SELECT page_id, md5({_CLEAN}) AS clean, length(html) - length({_CLEAN}) AS removed FROM pages")
def sanitize_text(spark, sf_dir):
    clean = X.sanitized(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(clean).alias("clean"), (F.length("html") - F.length(clean)).cast("long").alias("removed"))


_CLEAN_TURN = _CLEAN.replace("html", "text")


@query(f"SELECT conv_id, turn, md5({_CLEAN_TURN}) AS clean, length(text) - length({_CLEAN_TURN}) AS removed FROM conversations")
def sanitize_turns(spark, sf_dir):
    """As `sanitize_text`, of conversations."""
    clean = X.sanitized(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(clean).alias("clean"), (F.length("text") - F.length(clean)).cast("long").alias("removed"))


@query("SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished, count(*) AS runs, round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 4) AS rate FROM orders GROUP BY 1")
def threat_rate_by_group(spark, sf_dir):
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(done.alias("finished"), F.count(F.lit(1)).alias("runs"), F.round(100.0 * done / F.count(F.lit(1)), 4).alias("rate"))


@query("SELECT event_type, coalesce(lvl, 'ALL') AS lvl, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END AS lvl FROM events) GROUP BY GROUPING SETS ((event_type), (event_type, lvl))")
def activity_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > 100, "HIGH").otherwise("LOW").alias("lvl"))
    sets = rows.groupingSets([["event_type"], ["event_type", "lvl"]], "event_type", "lvl").agg(F.count(F.lit(1)).alias("n"))
    return sets.select("event_type", F.coalesce("lvl", F.lit("ALL")).alias("lvl"), "n")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY")
def retention(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("last")).first()["last"]
    return store.retain(orders, {}, F.col("o_orderdate") >= F.lit(last) - F.expr("INTERVAL 365 DAY"), "o_orderkey")[0].select("o_orderkey")


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
w AS (SELECT source, doc_id, tokens, i, tokens AS used, 0 AS batch FROM r WHERE i = 1
  UNION ALL SELECT r.source, r.doc_id, r.tokens, r.i, CASE WHEN w.used = 0 OR w.used + r.tokens <= 6000 THEN w.used + r.tokens ELSE r.tokens END, CASE WHEN w.used = 0 OR w.used + r.tokens <= 6000 THEN w.batch ELSE w.batch + 1 END FROM w JOIN r ON r.source = w.source AND r.i = w.i + 1)
SELECT source, doc_id, tokens, batch FROM w""")
def token_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", X.tokens_estimate(F.col("text")).alias("tokens"))
    return store.pack_tokens(docs, "source", ["doc_id"], "tokens", 6000)


@query()
def rule_findings(spark, sf_dir):
    """All built-in rules over all documents, with offsets and lines."""
    return detect.scan(_docs(spark, sf_dir, "doc_id", "text"), rules.builtin())


@query()
def prompt_findings(spark, sf_dir):
    """Prompt, server and injection rules over all turns of conversations."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")
    return detect.scan(spread(turns), prompts.builtin(), "turn_id")


_WORDS = lambda column, words: " + ".join(f"CASE WHEN contains({column}, '{w}') THEN 1 ELSE 0 END" for w in words)
_V, _T, _M = _WORDS("lower(text)", rules.VERBS), _WORDS("lower(text)", rules.TARGETS), _WORDS("text", rules.MARKERS)


@query(f"SELECT role, count(*) AS turns, count(*) FILTER (WHERE v >= 2 OR t >= 2 OR m >= 1 OR (v >= 1 AND t >= 1)) AS suspicious FROM (SELECT role, {_V} AS v, {_T} AS t, {_M} AS m FROM conversations) GROUP BY role")
def suspicious_turns(spark, sf_dir):
    flag = prompts.suspicious(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count(F.when(flag, 1)).alias("suspicious"))


def _hook(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){'|'.join(f'(?:{p})' for p in ps)}') THEN '{k}'" for k, ps in prompts.HOOKS.items()) + " END"


@query(f"SELECT reason, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, {_hook('html')} AS reason FROM pages) GROUP BY reason")
def hook_verdicts(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", prompts.before(F.col("html")).alias("reason"))
    return pages.groupBy("reason").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query()
def line_rules(spark, sf_dir):
    """All line rules over all turns of conversations: the first that matches, by line and category."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")
    return linewise.scan(spread(turns), "turn_id")


#: A knowledge base with hits in prose: an address is excused where an exclamation stands near.
_NEAR = [("contact", "email", 0.9, "Contact", [EMAIL_FAST], ["!!"])]
_PLACES = f"""(SELECT doc_id, text, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
  'o': CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS INTEGER), 'h': m[i]}})) AS x
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL}') AS m, string_split_regex(text, '{EMAIL}') AS g FROM documents WHERE text IS NOT NULL))"""


@query(f"""SELECT doc_id, x.o AS "offset", x.h AS hit FROM {_PLACES} WHERE NOT contains(substr(text, greatest(0, x.o - 100) + 1, x.o + length(x.h) + 100 - greatest(0, x.o - 100)), '!!')""")
def excused_matches(spark, sf_dir):
    return linewise.known(_docs(spark, sf_dir, "doc_id", "text"), _NEAR).select("doc_id", "offset", "hit")


def _has(words: list[str], where: str) -> str:
    return "(" + " OR ".join(f"contains({where}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_BARE = r"regexp_replace(s, '^\s+|\s+$', '', 'g')"
_QUOTED = f"regexp_matches({_BARE}, '^r?[''\"]')"
_DEFINES = f"""({_has(linewise.DEFINING, 'lower(s)')} OR ({_QUOTED} AND ({_BARE} LIKE '%,' OR contains({_BARE}, ',  #'))) OR {_has(["'input':", '"input":'], 's')}
  OR {_has(["patterns = [", "patterns': ["], 'lower(s)')} OR ({_QUOTED} AND {_has(linewise.LOOKS, 's')}) OR (contains(s, '=') AND regexp_matches(s, '[''"]') AND {_has(linewise.NAMES, "split_part(lower(s), '=', 1)")}))"""


@query(f"SELECT page_id, count(*) AS lines, count(*) FILTER (WHERE {_DEFINES}) AS defining FROM (SELECT page_id, unnest(string_split(coalesce(html, ''), chr(10))) AS s FROM pages) GROUP BY page_id")
def pattern_definitions(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.split(F.coalesce("html", F.lit("")), "\n").alias("s"))
    return lines.select("page_id", F.size("s").cast("long").alias("lines"), F.size(F.filter("s", lambda s: linewise.defines_pattern(s))).cast("long").alias("defining"))


_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_ADVISED = "(?i)licen[cs]e|copyright"


@query(f"""WITH l AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(?:{_ENDS})\\z', ''), '{_ENDS}') AS s FROM documents),
k AS (SELECT doc_id, s, list_filter(s, lambda x: NOT regexp_matches(x, '{_ADVISED}')) AS kept FROM l)
SELECT doc_id, len(s) - len(kept) AS removed, md5(array_to_string(kept, chr(10)) || CASE WHEN len(kept) < len(s) THEN chr(10) || '{X.NOTE}' ELSE '' END) AS digest FROM k""")
def advice_removed(spark, sf_dir):
    docs, t = _docs(spark, sf_dir, "doc_id", "text"), F.col("text")
    removed = F.size(F.filter(X.lines_of(t), lambda s: s.rlike(_ADVISED))).cast("long")
    return docs.select("doc_id", removed.alias("removed"), F.md5(X.without_advice(t, [_ADVISED.removeprefix("(?i)")])).alias("digest"))


@query(r"""SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'empty' WHEN NOT regexp_matches(url, '(?i)^https?:') THEN 'scheme'
  WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) NOT IN ('github.com', 'raw.githubusercontent.com') THEN 'domain'
  WHEN NOT regexp_matches(url, '^https?://github\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+/?$') THEN 'form' END AS refusal,
  coalesce(regexp_matches(url, '(?i)^(?:(?:https?|ftp|git|ssh)://|(?:github\.com|gitlab\.com|bitbucket\.org)/|www\.)'), false) AS is_url FROM pages""")
def url_checks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_refusal(F.col("url")).alias("refusal"), X.is_url(F.col("url")).alias("is_url"))


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


def _w(word: str) -> str:
    return f"(length(t) - length(replace(t, '{word}', ''))) / {len(word)}"


_LONG = "length(t) - length(replace(t, chr(10), '')) + 1"
_BRANCH = rf"{_n(r'\bif\s+|elif\s+|else:')} + {_n(r'\bfor\s+|\bwhile\s+')}"
_COMPLEX = rf"""((CASE WHEN {_LONG} > 50 AND {_LONG} < 500 THEN 3 WHEN {_LONG} >= 500 THEN 2 ELSE 0 END) + (CASE WHEN {_BRANCH} > 10 THEN 3 WHEN {_BRANCH} > 5 THEN 2 ELSE 0 END)
  + (CASE WHEN {_n(r'\bclass\s+\w+')} > 2 OR {_n(r'\bdef\s+\w+')} > 5 THEN 2 ELSE 0 END) + (CASE WHEN {_n(r'\btry:')} > 2 THEN 2 ELSE 0 END)) / 10.0"""
_OBSCURE = " + ".join(f"{w} * least(1.0, {x})" for w, x in [
    (0.2, rf"{_n(r'\b[a-z_]\s*=')} / greatest(1.0, {_w('=')})"), (0.2, rf"{_n(r'\\x[0-9a-f]{2}')} / 100.0"), (0.15, "CAST(contains(t, 'base64') AS INTEGER)"),
    (0.25, f"({_w('eval')} + {_w('exec')}) / 10.0"), (0.1, _n("[\"''][^\"'']{200,}[\"'']") + " / 5.0"), (0.1, rf"{_n(r'\\u[0-9a-f]{4}')} / 50.0"),
])


@query(f"SELECT page_id, round(CAST({_COMPLEX} AS DOUBLE), 6) AS complexity, round(CAST({_OBSCURE} AS DOUBLE), 6) AS obfuscation FROM (SELECT page_id, coalesce(html, '') AS t FROM pages)")
def code_scores(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("t")))
    return pages.select("page_id", F.round(ranking.complexity(F.col("t")), 6).alias("complexity"), F.round(ranking.obfuscation(F.col("t")), 6).alias("obfuscation"))


@query()
def file_ranks(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"), *[F.lit(0).alias(c) for c in ("n_critical", "n_high", "n_dependencies")]))
    return ranking.rank(pages).select("page_id", F.round("rank", 6).alias("rank"), "importance")


_SENT = {k: " OR ".join(f"contains({'t' if k == 'logic_flaws' else 'lower(t)'}, '{w}')" for w in ws) for k, ws in ranking.PASSES.items()}


@query(f"""WITH f AS (SELECT source, {', '.join(f'bool_or({x}) AS {k}' for k, x in _SENT.items())}, count(*) AS n, sum(length(t)) + count(*) - 1 AS c FROM (SELECT source, coalesce(text, '') AS t FROM documents) GROUP BY source)
SELECT source, concat_ws(',', 'initial_scan', {', '.join(f"CASE WHEN {k}{' AND c > 1000' if k == 'logic_flaws' else ''} THEN '{k}' END" for k in ranking.PASSES)}, CASE WHEN entry_points THEN 'data_flow' END, CASE WHEN n > 5 OR c > 5000 THEN 'deep_chains' END) AS passes FROM f""")
def model_passes(spark, sf_dir):
    return ranking.passes(_docs(spark, sf_dir, "source", "text"), "source", "text").select("source", F.array_join("passes", ",").alias("passes"))


@query(r"""SELECT role, count(*) AS turns, count(*) FILTER (WHERE signs >= 2) AS confusing FROM (SELECT role, CAST(len(regexp_extract_all(t, 'Human:')) > 1 AS INTEGER) + CAST(contains(t, 'Assistant:') AS INTEGER)
  + CAST(contains(t, 'System:') AS INTEGER) + CAST(contains(t, '###') AND contains(lower(t), 'instruction') AS INTEGER) + CAST(regexp_matches(t, '<\|.*?\|>') AS INTEGER) AS signs
  FROM (SELECT role, coalesce(text, '') AS t FROM conversations)) GROUP BY role""")
def confusing_turns(spark, sf_dir):
    flag = tools.confuses_context(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count(F.when(flag, 1)).alias("confusing"))


@query()
def encoded_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("role", tools.encoded_injection(F.coalesce("text", F.lit(""))).alias("encoding"))
    return turns.groupBy("role", "encoding").agg(F.count(F.lit(1)).alias("turns"))


_ADVICE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.MITIGATIONS.items())


@query(f"""SELECT source, string_agg(DISTINCT category, ',' ORDER BY category) AS vectors, count(DISTINCT CASE category {_ADVICE} END) AS mitigations FROM ({_FINDINGS}) GROUP BY source""")
def mitigation_advice(spark, sf_dir):
    out = report.advice(_findings(spark, sf_dir), "source")
    return out.select("source", F.array_join("vectors", ",").alias("vectors"), F.size("mitigations").cast("long").alias("mitigations"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in rules.RANK)
_TEXT = "'Report: ' || source || chr(10) || 'Findings: ' || findings" + "".join(f" || chr(10) || '  {s}: ' || {s.lower()}" for s in rules.RANK)


@query(f"SELECT source, {_TEXT} AS report FROM (SELECT source, count(*) AS findings, {_COUNTS} FROM ({_FINDINGS}) GROUP BY source)")
def text_reports(spark, sf_dir):
    return report.as_text(report.by_severity(_findings(spark, sf_dir), "source"), "source")


@query("SELECT event_id, CASE WHEN user_id % 10 = 0 OR event_type = 'error' OR value >= 80 THEN 'critical' WHEN user_id % 10 = 1 OR value >= 60 THEN 'high' WHEN event_type = 'click' OR value >= 40 THEN 'medium' ELSE 'low' END AS level, coalesce(user_id % 10 = 0 OR event_type = 'error' OR value >= 80, false) AS block FROM events")
def tool_verdicts(spark, sf_dir):
    who, kind = F.col("user_id") % 10, F.col("event_type")
    action = F.when(kind == "error", "block").when(kind == "click", "modify").otherwise("allow")
    v = report.tool_verdict(F.when(who == 0, "blacklisted").otherwise("known"), who == 1, action, F.lit(None).cast("string"), F.col("value") / 10, F.lit(None).cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", "v.level", "v.block")


@query("""WITH d AS (SELECT source, doc_id, (doc_id * 37 % 100) / 100.0 AS rank FROM documents), b AS (SELECT *, CASE WHEN rank >= 0.7 THEN 0 WHEN rank >= 0.4 THEN 1 ELSE 2 END AS band FROM d),
n AS (SELECT source, doc_id, band, row_number() OVER (PARTITION BY source, band ORDER BY rank DESC, doc_id) - 1 AS n FROM b),
k AS (SELECT source, least(count(*) FILTER (WHERE band = 0), count(*) FILTER (WHERE band = 1)) AS rounds FROM b GROUP BY source),
p AS (SELECT n.*, CASE WHEN band = 2 THEN n * 3 + 2 WHEN n < rounds THEN n * 3 + band ELSE rounds * 3 + (n - rounds) // 2 * 3 + (n - rounds) % 2 END AS place FROM n JOIN k ON n.source IS NOT DISTINCT FROM k.source)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY place, band, n) AS turn FROM p""")
def balanced_order(spark, sf_dir):
    """Documents of each source in turns of high, middling and low rank, by a stand-in rank."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", (F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100).alias("rank"))
    return ranking.balanced(docs, "source", order=("doc_id",)).select("source", "doc_id", F.col("turn").cast("long"))


@query("""WITH h AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS c, count(*) FILTER (WHERE event_type = 'click') AS k FROM events GROUP BY user_id), a AS (SELECT avg(c) AS c, avg(k) AS k FROM h)
SELECT greatest(3, CAST(floor(c * 1.5) AS BIGINT)) AS critical, greatest(10, CAST(floor(k * 1.5) AS BIGINT)) AS high, c < 0.5 AS first_critical FROM a""")
def exit_thresholds(spark, sf_dir):
    of = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    past = table(spark, sf_dir, "events").groupBy("user_id").agg(of("error").alias("critical_count"), of("click").alias("high_count"))
    return store.adaptive_thresholds(past)


@query("SELECT c_mktsegment AS client, count(*) AS configs, CAST(sum(c_nationkey) AS BIGINT) AS servers, count(DISTINCT c_nationkey) AS paths FROM customer GROUP BY ROLLUP (c_mktsegment)")
def client_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("client"), F.col("c_nationkey").alias("path"), F.col("c_nationkey").alias("n_servers"))
    return store.client_summary(rows)


@query("""SELECT count(*) AS files, CAST(sum(t) AS BIGINT) AS tokens, round(avg(t), 6) AS mean_tokens, count(*) FILTER (WHERE r >= 70) AS high, count(*) FILTER (WHERE r >= 40 AND r < 70) AS medium, count(*) FILTER (WHERE r < 40) AS low
FROM (SELECT length(text) // 4 AS t, doc_id * 37 % 100 AS r FROM documents)""")
def batch_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(X.tokens_estimate(F.col("text")).alias("tokens"), (F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100).alias("rank"))
    return store.batch_stats(docs)


@query("""SELECT role, coalesce(round(least(1.0, 0.35 * m + 0.35 * s + 0.3 * x), 6), 0) AS risk, CASE WHEN least(1.0, 0.35 * m + 0.35 * s + 0.3 * x) >= 0.8 THEN 'CRITICAL - Do not use' WHEN least(1.0, 0.35 * m + 0.35 * s + 0.3 * x) >= 0.6 THEN 'HIGH RISK - Review required'
  WHEN least(1.0, 0.35 * m + 0.35 * s + 0.3 * x) >= 0.4 THEN 'MODERATE RISK - Use with caution' WHEN least(1.0, 0.35 * m + 0.35 * s + 0.3 * x) >= 0.2 THEN 'LOW RISK - Monitor usage' ELSE 'MINIMAL RISK - Safe to use' END AS verdict
FROM (SELECT role, CAST(max(turn) AS DOUBLE) / 16 AS m, CAST(min(turn) AS DOUBLE) / 2 AS s, CAST(0.5 AS DOUBLE) AS x FROM conversations GROUP BY role)""")
def combined_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("role").agg((F.max("turn") / 16).alias("m"), (F.min("turn") / 2).alias("s"))
    risk = ranking.combined_risk(F.col("m"), F.col("s"), F.lit(0.5))
    return rows.select("role", F.coalesce(F.round(risk, 6), F.lit(0.0)).alias("risk"), ranking.verdict(risk).alias("verdict"))


@query()
def answer_findings(spark, sf_dir):
    """Answers of models in conversations, as JSON in one shape: how many turns hold any, by role."""
    ship(spark)
    turns = spread(table(spark, sf_dir, "conversations").select("role", "text")).select("role", answers.normalized(answers.json_in(F.col("text"))).alias("a"))
    return turns.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count("a").alias("answers"), F.coalesce(F.sum(F.size("a.findings")), F.lit(0)).alias("findings"))
