"""Taint within a module: a walk that keeps labels on access paths, fields and keys apart, and calls apart by their callers.

A value is a dict from a suffix ('' for itself, '.name', '[key]') to the labels it carries. Functions of the module are
walked at each call, up to `DEPTH` callers deep; beyond that, or in recursion, a result carries what the arguments carry.
Functions that nobody calls are walked by themselves; parameters of tools count as user input. Branches join; loops are
walked until no label reaches a path that it had not reached before.

What counts as source, sink and sanitizer is a `Semantics`, to which rows of a table can be added. With `conditions`, a value
that is set or returned under a tainted condition carries the condition's labels (not what follows an early return).
`links_of` says what a module's functions pass to and take from those of other files; `operators.flows` joins that."""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 3
#: Parts of a path that long loops keep apart; what lies deeper is held by the path above it.
PARTS = 6
# What reads user input or the environment, what makes a value safe for which sinks, and sinks by kind.
SOURCES = {"user_input": r"input|raw_input|sys\.argv|request\.(GET|POST|FILES|META|body|args|form|files|json|data|values)\b.*|tool_input|sys\.stdin\.read\w*", "environment": r"os\.environ\b.*|os\.getenv", "network": r"requests\.get|urlopen|urllib\.request\.urlopen"}
SAFE_FOR = {"shlex.quote": {"command_execution"}, "html.escape": {"template"}, "escape": {"template"}, "markupsafe.escape": {"template"}, "int": {"*"}, "float": {"*"}, "len": {"*"}, "bool": {"*"}}
SINKS = {"command_execution": r"subprocess\.\w+|os\.(system|popen)", "eval_execution": r"eval|exec", "sql_query": r".*\.(execute|executemany|executescript|raw)", "template": r"render_template\w*|Template|HttpResponse|make_response", "network_out": r"requests\.(post|put)|.*\.sendall"}
GROWING = {"append", "add", "extend", "insert", "update", "appendleft", "setdefault"}


class Semantics(NamedTuple):
    """Sources and sinks (kind to a pattern of whole names), what calls make a value safe for, and whether conditions carry labels."""

    sources: dict[str, str] = SOURCES
    sinks: dict[str, str] = SINKS
    safe_for: dict[str, set] = SAFE_FOR
    conditions: bool = False

    def extended(self, rows: list[tuple[str, str, str]]) -> Semantics:
        """With rows (role, kind, name) added: role source or sink with a pattern as name, or safe with a plain name, for the sinks of
        that kind (`*`: all)."""
        sources, sinks, safe = dict(self.sources), dict(self.sinks), {k: set(v) for k, v in self.safe_for.items()}
        for role, kind, name in rows:
            if role == "safe":
                safe.setdefault(name, set()).add(kind)
            elif role in ("source", "sink"):
                table = sources if role == "source" else sinks
                table[kind] = f"{table[kind]}|{name}" if kind in table else name
            else:
                raise ValueError(f"unknown role {role!r}")
        return self._replace(sources=sources, sinks=sinks, safe_for=safe)


class Label(NamedTuple):
    kind: str
    line: int
    safe: frozenset = frozenset()
    steps: tuple = ()


def path_of(node: ast.AST) -> str | None:
    """The access path of a name, a field or a constant key; null for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (at := path_of(node.value)):
        return f"{at}.{node.attr}"
    if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) and (at := path_of(node.value)):
        return f"{at}[{node.slice.value!r}]"
    return None


def named(table: dict[str, str], name: str) -> str | None:
    return next((k for k, rx in table.items() if re.fullmatch(rx, name)), None)


def whole(value: dict) -> frozenset:
    return frozenset().union(*value.values()) if value else frozenset()


def merged(*values: dict) -> dict:
    return {k: frozenset().union(*(v.get(k, frozenset()) for v in values)) for v0 in values for k in v0}


def folded(env: dict) -> dict:
    """env with paths of at most `PARTS` parts, and each label of a path once, by its fewest steps: finitely many states."""
    out: dict = {}
    for path, labels in env.items():
        ends = [m.start() for m in re.finditer(r"[.\[]", path)]
        at = out.setdefault(path[: ends[PARTS]] if len(ends) > PARTS else path, {})
        for x in labels:
            at[x[:3]] = min(at.get(x[:3], x), x, key=lambda y: (len(y.steps), y.steps))
    return {path: frozenset(labels.values()) for path, labels in out.items()}


def held(env: dict) -> set:
    return {(path, x[:3]) for path, labels in env.items() for x in labels}


class Module:
    def __init__(self, tree: ast.Module, rules: Semantics = Semantics(), imported: dict[str, list[str]] | None = None):
        self.rules, self.imported, self.guards, self.passed = rules, imported or {}, [], set()
        self.functions = {n.name: n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
        self.makers = {n.name: f for n in tree.body if isinstance(n, ast.ClassDef) for f in n.body if isinstance(f, ast.FunctionDef) and f.name == "__init__"}
        self.called, self.found, self.known = set(), {}, {}
        self.block(tree.body, {}, ())
        for name, f in self.functions.items():
            if name not in self.called and name != "__init__":
                tool = any(re.fullmatch(r"(.*\.)?tool(\(.*\))?", ast.unparse(d), re.DOTALL) for d in f.decorator_list)
                args = {a.arg: {"": frozenset({Label("user_input", f.lineno)})} if tool else {} for a in f.args.args + f.args.kwonlyargs}
                self.enter(f, args, ())

    def enter(self, f, args: dict[str, dict], callers: tuple) -> dict:
        self.called.add(f.name)
        env = {name + suffix: labels for name, value in args.items() for suffix, labels in value.items()}
        key = (f.name, callers, frozenset(env.items()), tuple(self.guards))
        if key not in self.known:  # the same call in the same place, as loops make it, says nothing new
            self.known[key] = self.block(f.body, env, (*callers, f.name))
        return self.known[key]

    def get(self, env: dict, path: str) -> dict:
        """What env holds at the path and below it; what holds the path holds its parts as well, unless they were set."""
        out = {k[len(path) :]: v for k, v in env.items() if k == path or k.startswith((f"{path}.", f"{path}["))}
        if "" not in out:
            above = [p for p in env if path.startswith((f"{p}.", f"{p}["))]
            out |= {"": env[max(above, key=len)]} if above else {}
        return out

    def guarded(self, value: dict) -> dict:
        return merged(value, *({"": g} for g in self.guards)) if self.guards else value

    def under(self, test: ast.AST, env: dict, callers: tuple) -> frozenset:
        """The labels of a condition, where they count."""
        got = whole(self.value(test, env, callers))
        if not self.rules.conditions:
            return frozenset()
        for part in ast.walk(test):
            if isinstance(part, ast.Compare):
                got = got.union(*(whole(self.value(x, env, callers)) for x in (part.left, *part.comparators)))
        return frozenset(x._replace(steps=(*x.steps, "condition")[-8:]) for x in got)

    def put(self, env: dict, target: ast.AST, value: dict) -> None:
        value = self.guarded(value)
        if isinstance(target, (ast.Tuple, ast.List)):
            for part in target.elts:
                self.put(env, part, {"": whole(value)})
        elif isinstance(target, ast.Starred):
            self.put(env, target.value, value)
        elif path := path_of(target):
            for old in [k for k in env if k == path or k.startswith((f"{path}.", f"{path}["))]:
                del env[old]
            env |= {path + suffix: labels for suffix, labels in ({"": frozenset()} | value).items()}
        elif isinstance(target, ast.Subscript) and (path := path_of(target.value)):  # an unknown key
            env[path] = env.get(path, frozenset()) | whole(value)

    def value(self, node: ast.AST | None, env: dict, callers: tuple) -> dict:
        if node is None or isinstance(node, (ast.Constant, ast.Lambda)):
            return {}
        if isinstance(node, ast.Call):
            return self.call(node, env, callers)
        if isinstance(node, (ast.Name, ast.Attribute, ast.Subscript)):
            if kind := named(self.rules.sources, ast.unparse(node)):
                return {"": frozenset({Label(kind, node.lineno)})}
            if path := path_of(node):
                return self.get(env, path)
            return {"": whole(self.value(node.value, env, callers))}
        if isinstance(node, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            env = dict(env)
            for g in node.generators:
                self.put(env, g.target, {"": whole(self.value(g.iter, env, callers))})
            parts = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
            return {"": frozenset().union(*(whole(self.value(p, env, callers)) for p in parts))}
        if isinstance(node, ast.Dict):
            out = {"": frozenset()}
            for k, v in zip(node.keys, node.values, strict=True):
                got = whole(self.value(v, env, callers))
                at = f"[{k.value!r}]" if isinstance(k, ast.Constant) else ""
                out[at] = out.get(at, frozenset()) | got
            return out
        if isinstance(node, ast.NamedExpr):
            got = self.value(node.value, env, callers)
            self.put(env, node.target, got)
            return got
        if isinstance(node, ast.Compare):
            for part in ast.iter_child_nodes(node):
                self.value(part, env, callers)
            return {}
        return {"": frozenset().union(*(whole(self.value(p, env, callers)) for p in ast.iter_child_nodes(node) if isinstance(p, (ast.expr, ast.FormattedValue))))}

    def call(self, node: ast.Call, env: dict, callers: tuple) -> dict:
        name = ast.unparse(node.func)
        given = [self.value(a, env, callers) for a in node.args]
        by_name = {k.arg: self.value(k.value, env, callers) for k in node.keywords}
        flat = frozenset().union(*map(whole, [*given, *by_name.values()]))
        if kind := named(self.rules.sinks, name):
            for a, v in [*zip(node.args, given, strict=True), *((k.value, by_name[k.arg]) for k in node.keywords)]:
                for label in whole(v):
                    if not label.safe & {kind, "*"}:
                        self.found.setdefault((kind, node.lineno, label.kind, label.line, callers), (ast.unparse(a), label.steps))
        if kind := named(self.rules.sources, name):
            return {"": frozenset({Label(kind, node.lineno)})}
        if name in self.rules.safe_for:
            return {"": frozenset(x._replace(safe=x.safe | self.rules.safe_for[name], steps=(*x.steps, name)) for x in flat)}
        f = self.makers.get(name) or self.functions.get(name)
        if f is not None and len(callers) < DEPTH and f.name not in callers:
            own = [a.arg for a in f.args.args]
            made = name in self.makers
            args = dict(zip(own[1:] if made else own, given, strict=False)) | {k: v for k, v in by_name.items() if k}
            if not made:
                return self.enter(f, args, callers)
            inner = {k + s: x for k, v in args.items() for s, x in v.items()}
            self.called.add(f.name)
            self.block(f.body, inner, (*callers, name))
            return self.get(inner, own[0]) if own else {}
        receiver = frozenset()
        for other in elsewhere(self.imported, name):
            for at, v in [*enumerate(given), *by_name.items()]:
                self.passed |= {(x.kind, f"{other}#{at}", node.lineno) for x in whole(v) if "*" not in x.safe}
            receiver |= {Label(f"@{other}()", node.lineno)}
        if isinstance(node.func, ast.Attribute):
            receiver |= whole(self.value(node.func.value, env, callers))
            path = path_of(node.func.value)
            if path and node.func.attr in GROWING and flat:
                env[path] = env.get(path, frozenset()) | flat
        short = name.rsplit(".", 1)[-1] if "(" in name else name
        return {"": frozenset(x._replace(steps=(*x.steps, short)[-8:]) for x in flat | receiver)}

    def block(self, body: list[ast.stmt], env: dict, callers: tuple) -> dict:
        """Walk statements, changing env; the value of what they return."""
        out: dict = {}
        for s in body:
            if isinstance(s, ast.Return):
                out = merged(out, self.guarded(self.value(s.value, env, callers)))
            elif isinstance(s, ast.Assign):
                got = self.value(s.value, env, callers)
                for t in s.targets:
                    self.put(env, t, got)
            elif isinstance(s, ast.AnnAssign):
                self.put(env, s.target, self.value(s.value, env, callers))
            elif isinstance(s, ast.AugAssign):
                self.put(env, s.target, merged(self.value(s.target, env, callers), self.value(s.value, env, callers)))
            elif isinstance(s, (ast.For, ast.AsyncFor)):
                out = merged(out, self.loop(s, env, callers))
                out = merged(out, self.block(s.orelse, env, callers))
            elif isinstance(s, ast.While):
                out = merged(out, self.loop(s, env, callers))
            elif isinstance(s, ast.If):
                out = merged(out, self.branches([s.body, s.orelse], env, callers, self.under(s.test, env, callers)))
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                for item in s.items:
                    got = self.value(item.context_expr, env, callers)
                    if item.optional_vars is not None:
                        self.put(env, item.optional_vars, got)
                out = merged(out, self.block(s.body, env, callers))
            elif isinstance(s, (ast.Try, ast.TryStar)):
                out = merged(out, self.block(s.body, env, callers), self.branches([[], *[h.body for h in s.handlers]], env, callers), self.block(s.orelse + s.finalbody, env, callers))
            elif isinstance(s, ast.Match):
                out = merged(out, self.branches([c.body for c in s.cases], env, callers, self.under(s.subject, env, callers)))
            elif isinstance(s, ast.ClassDef):
                self.block([x for x in s.body if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))], dict(env), callers)
            elif not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                for part in ast.iter_child_nodes(s):
                    if isinstance(part, ast.expr):
                        self.value(part, env, callers)
        return out

    def loop(self, s: ast.For | ast.AsyncFor | ast.While, env: dict, callers: tuple) -> dict:
        """Walk a loop's body twice, then on until a round brings no label to a path that no earlier round had there."""
        out, seen, rounds = {}, held(folded(env)), 0
        while True:
            guard = frozenset()
            if isinstance(s, ast.While):
                guard = self.under(s.test, env, callers)
            else:
                self.put(env, s.target, {"": whole(self.value(s.iter, env, callers))})
            out, rounds, short = merged(out, self.within(guard, s.body, env, callers)), rounds + 1, folded(env)
            if rounds > 1:
                if held(short) <= seen:
                    return out
                env.clear()
                env |= short
            seen |= held(short)

    def within(self, guard: frozenset, body: list[ast.stmt], env: dict, callers: tuple) -> dict:
        if not guard:
            return self.block(body, env, callers)
        self.guards.append(guard)
        try:
            return self.block(body, env, callers)
        finally:
            self.guards.pop()

    def branches(self, bodies: list[list[ast.stmt]], env: dict, callers: tuple, guard: frozenset = frozenset()) -> dict:
        envs = [dict(env) for _ in bodies]
        out = merged(*[self.within(guard, b, e, callers) for b, e in zip(bodies, envs, strict=True)])
        env.clear()
        env |= merged(*envs)
        return out


FLOW = "array<struct<sink:string,line:int,source:string,source_line:int,access_path:string,context:string,steps:array<string>,confidence:double>>"


def flows_of(code: str | None, rules: Semantics = Semantics()) -> list[dict]:
    """Flows of a module from sources to sinks, by line. Code that cannot be parsed, or nests too deep, has none."""
    try:
        found = Module(ast.parse(code or ""), rules).found
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = [{"sink": s, "line": n, "source": k, "source_line": m, "access_path": path, "context": ">".join(c), "steps": list(steps), "confidence": round(0.9 ** len(steps), 6)} for (s, n, k, m, c), (path, steps) in found.items()]
    return sorted(out, key=lambda f: (f["line"], f["sink"], f["source_line"], f["context"]))


def taint_flows(code: Column, rules: Semantics = Semantics()) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([flows_of(c, rules) for c in texts])

    return F.pandas_udf(run, FLOW)(code)


def imports_of(tree: ast.Module, module: str) -> dict[str, list[str]]:
    """What each imported name may stand for: a dotted name from the root of the repository, or from the module's own directory."""
    own, out = module.split(".")[:-1], {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out[a.asname or a.name] = list(dict.fromkeys([a.name, ".".join([*own, a.name])]))
        elif isinstance(n, ast.ImportFrom):
            base = own[: len(own) - n.level + 1] if n.level else []
            for a in n.names:
                name = ".".join(x for x in (n.module, a.name) if x)
                at = [".".join([*base, name])] if n.level else [name, ".".join([*own, name])]
                out[a.asname or a.name] = list(dict.fromkeys(at))
    return out


def elsewhere(imported: dict[str, list[str]], name: str) -> list[str]:
    """The dotted names that a called name may have in other files, by its longest imported part."""
    parts = name.split(".")
    for n in range(len(parts), 0, -1):
        if at := imported.get(".".join(parts[:n])):
            return [".".join([x, *parts[n:]]) for x in at]
    return []


LINK = "array<struct<role:string,node:string,to:string,line:int>>"


def links_of(path: str | None, code: str | None, rules: Semantics = Semantics()) -> list[dict]:
    """What crosses a module's border. Nodes are `module.function#argument` and `module.function()`, a result. Roles: source (taint
    enters the node here), edge (what enters the node enters `to`), sink (what enters the node meets the sink of kind `to`).

    Functions at the top of a module take part. A value that is safe for some kinds of sinks only counts as unsafe past the
    border. Code that cannot be parsed has no links."""
    module = re.sub(r"(/__init__)?\.py$", "", path or "").strip("/").replace("/", ".")
    try:
        tree = ast.parse(code or "")
        walk, returned = Module(tree, rules, imports_of(tree, module)), set()
        for f in tree.body:
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = [*enumerate(f.args.posonlyargs + f.args.args), *((None, a) for a in f.args.kwonlyargs)]
                given = {a.arg: {"": frozenset(Label(f"@{module}.{f.name}#{k}", f.lineno) for k in (i, a.arg) if k is not None)} for i, a in args}
                returned |= {(x.kind, f"{module}.{f.name}()", f.lineno) for x in whole(walk.enter(f, given, ())) if "*" not in x.safe and not x.kind.startswith(f"@{module}.{f.name}#")}
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = {("edge", k[1:], node, line) if k.startswith("@") else ("source", node, None, line) for k, node, line in walk.passed | returned}
    out |= {("sink", k[1:], sink, line) for sink, line, k, _, _ in walk.found if k.startswith("@")}
    return [dict(zip(("role", "node", "to", "line"), x, strict=True)) for x in sorted(out, key=str)]


def taint_links(path: Column, code: Column, rules: Semantics = Semantics()) -> Column:
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([links_of(p, c, rules) for p, c in zip(paths, texts, strict=True)])

    return F.pandas_udf(run, LINK)(path, code)
