"""Sources: repository files, dependency manifests and client configurations, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import entropy, suffix
from larkspur.session import ship

# Directories and endings that are not scanned, files that always are, sizes in bytes.
SKIP_DIRS = ["dist", "build", "node_modules", "vendor", "venv", ".venv", "target", "out", "bin", "coverage", ".next", ".nuxt", "public", "static", "assets", "__pycache__", ".pytest_cache", "htmlcov", ".tox", "wheels", "eggs", ".eggs", "sdist", "lib", "lib64", "parts", "include", "share", ".git", ".svn", ".hg", ".bzr", "_darcs", ".idea", ".vscode"]
SKIP_ENDS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".bmp", ".webp", ".pdf", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".xz", ".exe", ".dll", ".so", ".dylib", ".a", ".lib", ".o", ".obj", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".flac", ".mkv", ".db", ".sqlite", ".sqlite3", ".lock", ".log", ".min.js", ".min.css", ".map"]
SECURITY_FILES = [".env", ".env.local", ".env.production", ".env.development", ".git-credentials", ".netrc", ".pgpass", ".my.cnf", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials.xml", "secrets.yml", "secrets.yaml", "key.pem", "cert.pem", "private.key", "public.key"]
CONFIG_ENDS = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml"]
LANGUAGES = {".py": "Python", ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".rb": "Ruby", ".go": "Go", ".rs": "Rust", ".java": "Java", ".cpp": "C++", ".cxx": "C++", ".cc": "C++", ".hpp": "C++", ".c": "C", ".h": "C/C++", ".cs": "C#", ".php": "PHP", ".sh": "Shell", ".bash": "Bash", ".ps1": "PowerShell", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".lua": "Lua", ".pl": "Perl", ".r": "R", ".m": "Objective-C", ".mm": "Objective-C++", ".dart": "Dart", ".ex": "Elixir", ".exs": "Elixir", ".clj": "Clojure", ".hs": "Haskell", ".ml": "OCaml", ".nim": "Nim", ".zig": "Zig", ".v": "V", ".jl": "Julia"}
LARGEST, WHOLE, ENTROPY, DEEP, HEAD = 5 << 20, 1 << 20, 100 << 10, 500 << 10, 1 << 20


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def skipped(path: Column, size: Column) -> Column:
    """In a skipped directory, hidden (unless a security file), over 5 MB, or of a binary ending."""
    low = F.lower(path)
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    dirs = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIP_DIRS)))
    ends = F.lit(False)
    for e in SKIP_ENDS:
        ends = ends | name.endswith(e)
    return dirs | (name.startswith(".") & ~name.isin(SECURITY_FILES)) | (size > LARGEST) | ends


def kinds(path: Column) -> list[Column]:
    end, name = suffix(path), F.element_at(F.split(F.lower(path), "/"), -1)
    language = lookup(end, LANGUAGES)
    return [language.alias("language"), language.isNotNull().alias("is_code"), end.isin(CONFIG_ENDS).alias("is_config"), name.isin(SECURITY_FILES).alias("is_security")]


def repository(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content, text and kind of every file to scan. Filters on path and length reach the listing, so the
    content of skipped files is not read. Security files whose names begin with a dot come by `hidden`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.element_at(F.split("path", root.rstrip("/") + "/", 2), -1)
    files = files.withColumn("path", relative).filter(~skipped(F.col("path"), F.col("length")))
    files = files.select("path", "length", "content").unionByName(hidden(spark, root).filter(~skipped(F.col("path"), F.col("length"))))
    files = files.select("path", "length", "content", *kinds(F.col("path"))).filter("is_code OR is_config OR is_security")
    return files.withColumn("text", F.decode(F.try_validate_utf8(F.col("content").cast("string")).cast("binary"), "utf-8"))


def fingerprints(files: DataFrame) -> DataFrame:
    """sha512, sha3_512, size and entropy: of the first MB of files over one MB (entropy 0), of others whole; entropy only
    under 100 KB."""
    from larkspur.functions.python import sha3_512

    ship(files.sparkSession)
    large = F.col("length") > WHOLE
    body = F.when(large, F.substring("content", 1, HEAD)).otherwise(F.col("content"))
    return files.select("path", F.sha2(body, 512).alias("sha512"), sha3_512(body).alias("sha3_512"), F.col("length").alias("size"), F.when(F.col("length") < ENTROPY, entropy(F.coalesce("text", F.lit("")))).otherwise(0.0).alias("entropy"), (F.col("length") < DEEP).alias("deep"))


def requirements(lines: DataFrame, column: str = "value", keep: list[str] = ()) -> DataFrame:
    """(name, version, and the columns `keep`) of requirement lines; == is dropped, other operators stay, a bare name has version ''."""
    body = F.trim(F.regexp_replace(column, r"#.*$", ""))
    m = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(==|>=|<=|~=|!=|<|>)?\s*([^;\s]*)"
    op, version = F.regexp_extract(body, m, 2), F.regexp_extract(body, m, 3)
    out = lines.filter((body != "") & ~body.startswith("-")).select(*keep, F.regexp_extract(body, m, 1).alias("name"), F.concat(F.when(op == "==", "").otherwise(op), version).alias("version"))
    return out.filter("name <> ''").withColumn("ecosystem", F.lit("PyPI"))


def package_json(files: DataFrame, column: str = "text", keep: list[str] = ()) -> DataFrame:
    """(name, version, dev, and the columns `keep`) of dependencies and devDependencies."""
    parsed = files.select(*keep, F.from_json(column, "dependencies map<string,string>, devDependencies map<string,string>").alias("p"))
    out = parsed.select(*keep, F.explode("p.dependencies").alias("name", "version"), F.lit(False).alias("dev"))
    return out.unionByName(parsed.select(*keep, F.explode("p.devDependencies").alias("name", "version"), F.lit(True).alias("dev"))).withColumn("ecosystem", F.lit("npm"))


def package_lock(files: DataFrame, column: str = "text", keep: list[str] = ()) -> DataFrame:
    """(name, version, and the columns `keep`) of a lock file: its `packages`, else its `dependencies` however deep."""
    from larkspur.functions.python import json_values

    ship(files.sparkSession)
    flat = F.from_json(column, "packages map<string,struct<version:string>>")["packages"]
    both = files.select(*keep, flat.alias("p"), column)
    rows = both.filter("p IS NOT NULL").select(*keep, F.explode("p").alias("at", "d")).filter("at <> ''")
    rows = rows.select(*keep, F.element_at(F.split("at", "node_modules/"), -1).alias("name"), F.coalesce("d.version", F.lit("")).alias("version"))
    leaf = both.filter("p IS NULL").select(*keep, F.explode(json_values(F.col(column))).alias("x")).select(*keep, "x.keys", "x.key", "x.value")
    n = F.size("keys")
    # dependencies, a name, dependencies, a name, ..., version
    nested = (n >= 3) & (n % 2 == 1) & (F.col("key") == "version") & F.forall(F.filter("keys", lambda k, i: (i % 2 == 0) & (i < n - 1)), lambda k: k == "dependencies")
    deep = leaf.filter(nested).select(*keep, F.get("keys", n - 2).alias("name"), F.coalesce("value", F.lit("")).alias("version"))
    return rows.unionByName(deep).withColumn("ecosystem", F.lit("npm"))


def vulnerable(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies with their advisories from an offline table (ecosystem, name, version, id, severity)."""
    return dependencies.join(advisories, ["ecosystem", "name", "version"], "left")


def servers(configs: DataFrame, column: str = "text") -> DataFrame:
    """(path, server, command, args) of client configurations with `mcpServers` or `servers`."""
    entry = "map<string,struct<command:string,args:array<string>,url:string>>"
    parsed = configs.select("path", F.from_json(column, f"mcpServers {entry}, servers {entry}").alias("c"))
    return parsed.select("path", F.explode(F.coalesce("c.mcpServers", "c.servers")).alias("server", "s")).select("path", "server", "s.*")


def git_history(commits: DataFrame) -> DataFrame:
    """Findings of commits (sha, message, insertions, deletions): large changes, and telling words in the message."""
    large = commits.filter("deletions > 500 OR insertions > 1000").select("sha", F.lit("large change").alias("name"), F.lit("HIGH").alias("severity"), F.lit(0.7).alias("confidence"))
    told = commits.filter(F.lower("message").rlike("backdoor|malicious|hack|exploit|bypass")).select("sha", F.lit("message").alias("name"), F.lit("MEDIUM").alias("severity"), F.lit(0.6).alias("confidence"))
    return large.unionByName(told)


def recent(commits: DataFrame, repository: str, newest_first: list, most: int = 20) -> DataFrame:
    """The `most` newest commits of each repository but the oldest of those, as the history is read."""
    w = Window.partitionBy(repository)
    out = commits.withColumns({"_n": F.count(F.lit(1)).over(w), "_at": F.row_number().over(w.orderBy(*newest_first))})
    return out.filter(F.col("_at") < F.least(F.lit(most), F.col("_n"))).drop("_n", "_at")


def config_form(text: Column) -> Column:
    """'listed' for a client configuration with a map of servers, 'zed' for one with language models and `mcp`, else null."""
    v = F.try_parse_json(text)

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))

    is_map = lambda name: F.coalesce(kind(name).startswith("OBJECT"), F.lit(False))
    has = lambda name: kind(name).isNotNull()
    listed = F.when(has("mcpServers"), is_map("mcpServers")).when(has("servers"), is_map("servers"))
    return F.when(listed, "listed").when(listed.isNull() & has("language_models") & has("mcp"), "zed")


# Where clients keep their configuration, under a home directory, by system.
CLIENTS = {
    "claude": {"darwin": ["Library/Application Support/Claude/claude_desktop_config.json"], "linux": [".config/Claude/claude_desktop_config.json", ".claude/config.json"], "win32": ["AppData/Roaming/Claude/claude_desktop_config.json", "AppData/Local/Claude/claude_desktop_config.json"]},
    "cursor": {"darwin": [".cursor/mcp/config.json", ".cursor/config.json"], "linux": [".cursor/mcp/config.json", ".cursor/config.json", ".config/cursor/mcp/config.json"], "win32": [".cursor/mcp/config.json", ".cursor/config.json", "AppData/Roaming/Cursor/mcp/config.json"]},
}


def hidden(spark: SparkSession, root: str, names: list[str] = ()) -> DataFrame:
    """(path, length, content) of files whose names begin with a dot, which Spark's own sources never list: those of `names`
    (default: the security files). Names are listed once by the file system; contents are read by the executors."""
    import pandas as pd
    from pyarrow import fs

    wanted = set(names or SECURITY_FILES)
    at, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    found = [i.path for i in at.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file and i.base_name.startswith(".") and i.base_name in wanted]

    def read(batches):
        own = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
        for pdf in batches:
            for full in pdf["full"]:
                with own.open_input_stream(full) as f:
                    data = f.read()
                yield pd.DataFrame({"path": [full[len(base.rstrip("/")) + 1 :]], "length": [len(data)], "content": [data]})

    rows = spark.createDataFrame([(p,) for p in found], "full string")
    return rows.mapInPandas(read, "path string, length long, content binary")


def discovered(spark: SparkSession, home: str, clients: dict = CLIENTS) -> DataFrame:
    """(client, path, text) of the client configurations under a home directory, of every system's places."""
    known = {p: c for c, by in clients.items() for ps in by.values() for p in ps}
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(home)
    plain = plain.select(F.element_at(F.split("path", home.rstrip("/") + "/", 2), -1).alias("path"), F.decode("content", "utf-8").alias("text"))
    beneath = configs_beneath(spark, home, sorted(known))
    return plain.unionByName(beneath).dropDuplicates(["path"]).withColumn("client", lookup(F.col("path"), known)).filter("client IS NOT NULL").select("client", "path", "text")


def configs_beneath(spark: SparkSession, home: str, paths: list[str]) -> DataFrame:
    """Files at the given places, in directories that begin with a dot too; there are as many as places."""
    from pyarrow import fs

    at, base = fs.FileSystem.from_uri(home) if "://" in home else (fs.LocalFileSystem(), home)
    rows = []
    for p in paths:
        full = f"{base.rstrip('/')}/{p}"
        if at.get_file_info(full).is_file:
            with at.open_input_stream(full) as f:
                rows.append((p, f.read().decode("utf-8", "ignore")))
    return spark.createDataFrame(rows, "path string, text string")
