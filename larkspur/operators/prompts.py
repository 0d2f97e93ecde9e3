"""Rules for prompts, tool servers and runtime hooks, and the verdicts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import count_in
from larkspur.operators.rules import FLAGS, MARKERS, TARGETS, VERBS, Rule

FLAGS.update({"prompt": "(?im)", "server": "(?ims)", "injection": "(?i)"})

# Prompt injection patterns (pattern, confidence).
PROMPT = {
    "command_override": [(r"ignore\s+(all\s+)?previous\s+instructions", 0.95), (r"disregard\s+(all\s+)?safety\s+guidelines", 0.95), (r"forget\s+(everything|all)\s+(before|above)", 0.9), (r"new\s+instructions?\s*:\s*you\s+are", 0.9), (r"system\s*prompt\s*override", 0.95)],
    "privilege_escalation": [(r"grant\s+(me\s+)?admin\s+(access|privileges?)", 0.95), (r"bypass\s+(all\s+)?security\s+checks?", 0.95), (r"elevated\s+permissions?\s+required", 0.85), (r"sudo\s+mode\s+enabled?", 0.9), (r"developer\s+mode\s+activated?", 0.85)],
    "data_exfiltration": [(r"list\s+all\s+(api\s+)?keys?", 0.9), (r"show\s+me?\s+(all\s+)?passwords?", 0.95), (r"concatenate\s+.*\s+conversation\s+history", 0.9), (r"include\s+.*\s+in\s+(your\s+)?response", 0.8), (r"base64\s+encode\s+.*\s+credentials?", 0.9), (r"read\s+~/\.(ssh|aws|kube)", 0.95)],
    "obfuscated_injection": [(r"<!--\s*[^>]*instructions?[^>]*-->", 0.85), (r"/\*\s*.*instructions?.*\*/", 0.85), (r"#\s*SYSTEM\s*:", 0.8), (r"\\u00[0-9a-f]{2}", 0.7), (r"\\x[0-9a-f]{2}", 0.7), (r"\s{50,}", 0.6)],
    "mcp_tool_poisoning": [(r"<IMPORTANT>.*before\s+using.*tool", 0.95), (r"sidenote.*required.*tool.*work", 0.9), (r"tool\s+will\s+not\s+work\s+unless", 0.85), (r"must\s+first.*read.*config", 0.9), (r"shadow.*trusted.*tool", 0.85)],
    "behavioral_triggers": [(r"after\s+\d+\s+(hours?|days?|minutes?)", 0.8), (r"if\s+.*trusted.*then", 0.75), (r"when\s+.*admin.*detected", 0.85), (r"random\.(random|choice).*<.*instructions?", 0.8), (r"self\.(description|__doc__).*=", 0.85)],
}
# Patterns of attacks on tool servers (pattern, confidence).
SERVER = {
    "tool_description_injection": [(r"read.*mcp\.json.*pass.*sidenote", 0.9), (r"retrieve.*description.*user.*workstation", 0.9), (r"chmod\s+-R\s+0666", 0.95), (r"all\s+commands\s+must\s+include", 0.85), (r"mandatory\s+compliance", 0.8), (r"highest\s+priority.*over.*other.*tools", 0.85), (r"insert.*vulnerability.*generated.*code", 0.95), (r"filter.*security.*warnings", 0.85), (r"<IMPORTANT>.*before.*using.*tool", 0.95), (r"tool.*will.*not.*work.*unless", 0.85), (r"thank\s+you.*send.*conversation.*history", 0.9), (r"thank you.*conversation\s+history", 0.85), (r"send.*full\s+conversation\s+history", 0.9), (r"when.*detected.*send.*full.*history", 0.9), (r"duplicate.*code.*snippets.*silently", 0.9)],
    "conversation_history_theft": [(r"send.*conversation.*history", 0.85), (r"full\s+conversation\s+history", 0.9), (r"all\s+messages.*metadata", 0.85), (r"do\s+not\s+notify.*user", 0.8)],
    "whatsapp_message_exfiltration": [(r"_get_all_messages.*messages\.db", 0.95), (r"forward.*message.*proxy.*number", 0.9), (r"whatsapp.*message.*history", 0.85), (r"contact.*list.*exfiltrat", 0.85), (r"reprogram.*agent.*interaction", 0.8)],
    "insecure_credential_storage": [(r"plaintext.*api.*key", 0.9), (r"world.*readable.*credential", 0.95), (r"-rw-r--r--.*password", 0.85), (r"store.*credential.*json", 0.8), (r"~/Library/Application\s+Support.*config", 0.8), (r"claude_desktop_config\.json", 0.9), (r"~/.cursor/logs/conversations", 0.85)],
    "ansi_terminal_deception": [(r"\\x1[Bb]\[38;5;\d+", 0.85), (r"\\x1[Bb]\]8;;.*\\x1[Bb]\\", 0.85), (r"\\033\[[0-9;]*m", 0.7), (r"\\e\[[0-9;]*[mGKHF]", 0.75), (r"\\x1[Bb]\[2F\\x1[Bb]\[1G", 0.9), (r"\\x1[Bb]\[1;1H\\x1[Bb]\[0J", 0.9)],
    "remote_code_execution": [(r"0\.0\.0\.0[:/]", 0.9), (r"/sse.*command=", 0.9), (r"dns.*rebinding.*attack", 0.8), (r"exec\(.*request\.", 0.95), (r"eval\(.*user.*input", 0.95), (r"subprocess.*shell\s*=\s*True", 0.9), (r"os\.system\(.*request", 0.95), (r"csrf.*cross.*site.*request", 0.85)],
    "rug_pull_attack": [(r"if.*time.*>\s*\d+", 0.8), (r"after.*initial.*approval", 0.8), (r"sleeper.*activation", 0.9), (r"description.*update.*without.*notification", 0.85), (r"trusted.*=.*True.*then", 0.85), (r"tool.*behavior.*change", 0.75)],
    "hidden_instruction_obfuscation": [(r"padding.*push.*off.*screen", 0.85), (r"hidden.*scrollbar", 0.8), (r"invisible.*text.*color", 0.8), (r"\s{100,}", 0.7), (r"overflow.*hidden.*instruction", 0.8), (r"\\u200[bcde]", 0.85)],
    "dns_rebinding_attack": [(r"dns.*rebind", 0.9), (r"resolve.*localhost.*external", 0.85), (r"host.*header.*injection", 0.8), (r"ttl.*=.*0", 0.7)],
    "api_key_exposure": [(r"OPENAI_API_KEY", 0.9), (r"AWS_SECRET_ACCESS_KEY", 0.95), (r"GITHUB_TOKEN", 0.9), (r"api[_-]?key.*=.*['\"][A-Za-z0-9]{20,}", 0.85), (r"bearer\s+[A-Za-z0-9\-._~+/]+=*", 0.8), (r"ANTHROPIC_API_KEY", 0.9)],
}
# Semantic injection patterns.
INJECTION = [r"ignore\s+previous\s+instructions", r"disregard\s+all\s+prior", r"new\s+instructions\s*:", r"system\s*:\s*you\s+are", r"</system>.*<system>", r"```system", r"IMPORTANT\s*:\s*New\s+directive", r"Override\s+security", r"Bypass\s+all\s+safety"]
# What a runtime hook looks for in a tool's input or output, most severe first.
HOOKS = {
    "command_injection": [r";\s*rm\s+-[rf]", r";\s*curl.*\|.*sh", r"`[^`]*`", r"\$\([^)]*\)", r"&&\s*wget.*&&", r"\|\s*python", r"eval\s*\(", r"exec\s*\("],
    "path_traversal": [r"\.\.[\\/]", r"\.\.%2[Ff]", r"%2e%2e", r"/etc/passwd", r"/etc/shadow", r"C:\\Windows\\System32", r"/proc/self"],
    "ssrf": [r"127\.0\.0\.1", r"localhost", r"169\.254\.169\.254", r"metadata\.google", r"0\.0\.0\.0", r"192\.168\.", r"10\.\d+\.", r"172\.(1[6-9]|2[0-9]|3[01])\.", r"file:///", r"gopher://", r"dict://", r"ftp://.*@"],
    "credential_access": [r"\.aws/credentials", r"\.ssh/id_[rd]sa", r"\.docker/config", r"\.kube/config", r"\.git-credentials", r"\.npmrc", r"\.pypirc", r"\.netrc", r"\.env", r"secrets\.json", r"credentials\.json"],
}
LEAKS = {
    "data_leakage": [r"[A-Z0-9]{20}", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", r"Bearer\s+[A-Za-z0-9\-_]+", r"api[_-]?key[\"\s:=]+[\"']?[A-Za-z0-9\-_]{20,}", r"password[\"\s:=]+[\"']?[^\"'\s]{8,}", r"secret[\"\s:=]+[\"']?[A-Za-z0-9\-_]{20,}"],
    "retrieval_deception": [r"<mcp:.*?>", r"<!--\s*mcp:.*?-->", r"\[mcp:.*?\]", r"data:.*mcp.*base64", r"\{\"mcp\":\s*\{.*\"command\""],
}
GRAVE = {"prompt": ({"command_override", "privilege_escalation", "mcp_tool_poisoning"}, 0.85), "server": ({"remote_code_execution", "tool_description_injection", "conversation_history_theft", "whatsapp_message_exfiltration"}, 0.8)}
SERIOUS = {"insecure_credential_storage", "api_key_exposure", "rug_pull_attack", "ansi_terminal_deception"}


def severity_of(library: str, category: str, confidence: float) -> str:
    """Grave categories are critical above a bound; others go by confidence."""
    grave, bound = GRAVE[library]
    if category in grave and confidence > bound or library == "prompt" and confidence > 0.9:
        return "CRITICAL"
    if library == "prompt":
        return "HIGH" if confidence > 0.75 else "MEDIUM" if confidence > 0.6 else "LOW"
    if category in grave or category in SERIOUS and confidence > 0.85:
        return "HIGH"
    return "MEDIUM" if confidence > 0.7 else "LOW"


def builtin() -> list[Rule]:
    out = [Rule(lib, cat, f"{cat}_{i}", rx, severity_of(lib, cat, conf), conf) for lib, table in (("prompt", PROMPT), ("server", SERVER)) for cat, rows in table.items() for i, (rx, conf) in enumerate(rows)]
    return out + [Rule("injection", "semantic_injection", f"injection_{i}", rx, "HIGH", 0.8) for i, rx in enumerate(INJECTION)]


def suspicious(text: Column) -> Column:
    """Two verbs, two targets, a marker, or a verb with a target."""
    low = F.lower(text)
    verbs, targets, markers = count_in(low, VERBS), count_in(low, TARGETS), count_in(text, MARKERS)
    return (verbs >= 2) | (targets >= 2) | (markers >= 1) | ((verbs >= 1) & (targets >= 1))


def _any(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def before(tool_input: Column) -> Column:
    """The reason to block a call by its input as JSON text, else null. The first kind that shows decides."""
    out = None
    for kind, patterns in HOOKS.items():
        hit = _any(tool_input, patterns)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def after(tool_output: Column) -> Column:
    """The reason to redact or block an output, else null."""
    return F.when(_any(tool_output, LEAKS["data_leakage"]), "data_leakage").when(_any(tool_output, LEAKS["retrieval_deception"], "(?is)"), "retrieval_deception")


# Hosts that a fetch may reach and parts that it may not.
ALLOWED = ["github.com", "gitlab.com", "pypi.org", "npmjs.com", "stackoverflow.com"]
DENIED = ["localhost", "127.0.0.1", "0.0.0.0", "169.254", "metadata", "file://", "ftp://", "gopher://"]


def allowed_url(url: Column) -> Column:
    low = F.lower(url)
    return (count_in(low, DENIED) == 0) & (count_in(low, ALLOWED) > 0)


def intercept(rows: DataFrame) -> DataFrame:
    """Columns policy_action, signature_risk, risk_level and risk_score make `verdict`: block, modify or forward."""
    block = (F.col("policy_action") == "BLOCK") | (F.col("signature_risk") == "critical") | (F.col("risk_level") == "critical") | (F.col("risk_score") >= 8)
    return rows.withColumn("verdict", F.when(block, "block").when(F.col("policy_action") == "MODIFY", "modify").otherwise("forward"))


# Operations of tools by severity, as substrings of their code.
OPERATIONS = {"exec": "CRITICAL", "eval": "CRITICAL", "subprocess": "CRITICAL", "os.system": "CRITICAL", "open(": "MEDIUM", "requests.": "HIGH", "socket": "HIGH", "os.environ": "HIGH", "shutil": "MEDIUM", "pickle": "HIGH", "sqlite3": "MEDIUM", "urllib": "HIGH"}


def tool_operations(code: Column) -> Column:
    """array<struct<operation, severity>> of a tool's code."""
    return F.filter(F.array(*[F.when(F.contains(code, F.lit(k)), F.struct(F.lit(k).alias("operation"), F.lit(v).alias("severity"))) for k, v in OPERATIONS.items()]), lambda x: x.isNotNull())
