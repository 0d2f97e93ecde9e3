"""Taint: fields, callers, containers, tools, sanitizers, conditions, own rules, and between files."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions.taint import Semantics, flows_of, links_of, taint_flows
from larkspur.operators import flows

FIELDS = '''
class User:
    def __init__(self):
        self.name = input("Name: ")
        self.id = 123

user = User()
print(f"Welcome {user.name}")
subprocess.run(user.name, shell=True)
subprocess.run(str(user.id), shell=True)
'''
CALLERS = '''
def run(data):
    return subprocess.run(data, shell=True)

def fixed():
    run("ls")

def given():
    line = input()
    run(line)

fixed()
given()
'''
CONTAINERS = '''
lines = [input(i) for i in range(3)]
clean = [x.strip() for x in lines]
for c in clean:
    os.system(c)
data = {}
data["safe"] = "constant"
data["unsafe"] = input()
subprocess.run(data["unsafe"], shell=True)
subprocess.run(data["safe"], shell=True)
for item in lines:
    eval(item)
rest = []
rest.append(input())
os.system(rest[0])
'''
TOOLS = '''
@tool
def shell(command: str, other: str = "x"):
    return subprocess.run(command, shell=True).stdout

@mcp.tool()
def talk(data: str):
    print(data)

@tool
def query(q: str):
    conn.execute(q)

def helper(x):
    os.system(x)
'''
SAFE = '''
x = input()
subprocess.run(f"echo {shlex.quote(x)}", shell=True)
y = html.escape(x)
subprocess.run(y, shell=True)
n = int(x)
os.system(n)
eval(x)
if n > 1:
    z = x
else:
    z = "fixed"
os.system(z)
x = "fixed"
os.system(x)
'''


def lines(code, sink=None):
    return [f["line"] for f in flows_of(code) if sink in (None, f["sink"])]


def test_fields():
    (got,) = flows_of(FIELDS)
    assert got["access_path"] == "user.name" and got["line"] == 9 and got["source_line"] == 4


def test_callers():
    (got,) = flows_of(CALLERS)
    assert got["context"] == "given>run" and got["source_line"] == 9


def test_containers():
    assert lines(CONTAINERS) == [5, 9, 12, 15]


def test_tools():
    got = flows_of(TOOLS)
    assert [(f["sink"], f["line"]) for f in got] == [("command_execution", 4), ("sql_query", 12)]


def test_sanitizers_and_branches():
    assert lines(SAFE) == [5, 8, 13] and lines(SAFE, "eval_execution") == [8]


def test_steps():
    (got,) = flows_of("a = input()\nb = base64.b64decode(base64.b64encode(a.encode())).decode()\nexec(b)")
    assert got["steps"] == ["a.encode", "base64.b64encode", "base64.b64decode", "decode"] and got["confidence"] == round(0.9**4, 6)


def test_bad_and_recursive_code():
    assert flows_of(None) == [] and flows_of("def (:") == [] and flows_of("") == []
    assert lines("def f(x):\n  f(x)\n  g(x)\ndef g(x):\n  f(x)\n  eval(x)\nf(input())") == [6]


def test_as_column(spark):
    files = spark.createDataFrame([("a", FIELDS), ("b", None)], "path string, content string")
    got = files.select("path", F.explode(taint_flows(F.col("content"))).alias("f")).select("path", "f.*").collect()
    assert [(r.path, r.sink) for r in got] == [("a", "command_execution")]


def test_loops_until_nothing_new():
    """Taint that moves one variable a round, in both kinds of loop; paths that grow, swaps and branches of calls come to an end."""
    for head in ("while go():", "for i in range(9):"):
        for n in (3, 4, 12):
            moves = "".join(f"    v{k} = v{k - 1}\n" for k in range(n, 0, -1))
            got = flows_of(f"{head}\n{moves}    v0 = input()\nos.system(v{n})\n")
            assert [(f["sink"], f["line"], f["source_line"]) for f in got] == [("command_execution", n + 3, n + 2)]
    grown = "n = input()\nwhile go():\n    n.left = n\n    n.right = n\n    a, b = b, a\n" + "".join(f"    if c: n = f{k}(n)\n" for k in range(6)) + "os.system(n)\n"
    assert {f["sink"] for f in flows_of(grown)} == {"command_execution"}


def test_conditions():
    code = "q = input()\nif q == 'b':\n    c = 'd'\nelse:\n    c = 'e'\nos.system(c)\n"
    assert flows_of(code) == []
    (got,) = flows_of(code, Semantics(conditions=True))
    assert (got["line"], got["source_line"], got["steps"]) == (6, 1, ["condition"])
    safe = "n = int(input())\nif n > 1:\n    c = 'd'\nos.system(c)\n"
    assert flows_of(safe, Semantics(conditions=True)) == []
    after = "q = input()\nif q:\n    c = 'd'\nc = 'e'\nos.system(c)\n"
    assert flows_of(after, Semantics(conditions=True)) == []
    loop = "q = input()\nwhile q:\n    a = b\n    b = c\n    c = 'd'\nos.system(a)\n"
    assert [f["line"] for f in flows_of(loop, Semantics(conditions=True))] == [6]


def test_own_rules():
    code = "q = my.read()\nmy.run(q)\nmy.run(clean(q))\neval(clean(q))"
    own = Semantics().extended([("source", "mine", r"my\.read"), ("sink", "mine", r"my\.run"), ("safe", "mine", "clean")])
    assert flows_of(code) == []
    assert [(f["sink"], f["line"], f["source"]) for f in flows_of(code, own)] == [("mine", 2, "mine"), ("eval_execution", 4, "mine")]
    assert "mine" not in Semantics().sinks  # the base stays as it is
    with pytest.raises(ValueError):
        Semantics().extended([("other", "a", "b")])


def test_links_of_a_module():
    assert links_of("a.py", "def (:") == [] and links_of(None, None) == [] and links_of("a.py", "x = 1") == []
    got = links_of("pkg/b.py", "from .c import go\nfrom ..d import far\ndef f(x, *, y):\n    go(far(x), z=y)\n")
    assert {(g["role"], g["node"], g["to"]) for g in got} == {
        *{("edge", f"pkg.b.f#{a}", to) for a in ("0", "x") for to in ("d.far#0", "pkg.c.go#0")},
        ("edge", "pkg.b.f#y", "pkg.c.go#z"),
        ("edge", "d.far()", "pkg.c.go#0"),
    }


def test_across_files(spark):
    """A ring of files, a file that two repositories share by name, unparsable and empty files."""
    ring = [("r", "a.py", "import b\nb.f(input())\ndef g(x):\n    b.f(x)\n"), ("r", "b.py", "import a, sub.c as c\ndef f(x):\n    a.g(x)\n    c.h(x)\n"), ("r", "sub/c.py", "def h(y):\n    eval(y)\n"), ("r", "bad.py", "def (:"), ("r", "none.py", None)]
    other = [("s", "a.py", "import b\nb.f('x')\n"), ("s", "b.py", "def f(x):\n    eval(x)\n")]
    files = spark.createDataFrame(ring + other, "repository string, path string, content string")
    got = [tuple(r) for r in flows.across_files(files).collect()]
    assert got == [("r", "sub/c.py", 2, "eval_execution", 1, 0.9)]
    assert flows.across_files(files.limit(0)).count() == 0
