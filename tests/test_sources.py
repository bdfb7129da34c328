import pytest

from lattica.functions import patterns
from lattica.operators import solve
from lattica.plans import definitions, lang
from lattica.sources import pyast


def flows(text, source="input", sink="os.system", kill=None, spark=None):
    nodes, edges = pyast.lower("m.py", text)
    links = list(edges)
    args = [n for n in nodes if n["node_type"] == "code.Arg"]
    for p in (n for n in nodes if n["node_type"] == "code.Param"):
        links += [(a["node_id"], p["node_id"]) for a in args if a["callee_path"] == p["callee_path"] and a["props"]["index"] in (p["props"]["index"], p["props"]["name"])]
    for r in (n for n in nodes if n["node_type"] == "code.Return"):
        links += [(r["node_id"], c["node_id"]) for c in nodes if c["node_type"] == "code.Call" and c["callee_path"] == r["props"]["fn"]]
    of = lambda p: {n["node_id"] for n in nodes if n["node_type"] == "code.Call" and n["callee_path"] == p}
    seen, todo = set(), list(of(source))
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            if n not in of(kill):
                todo += [b for a, b in links if a == n]
    return bool(seen & of(sink))


@pytest.mark.parametrize(
    "text,expected",
    [
        ("import os\nx = input()\nos.system(x)", True),
        ("from os import system as s\nx = input()\ns('a' + x)", True),
        ("import os\nx = input()\nx = 'safe'\nos.system(x)", False),
        ("import os, shlex\nos.system(shlex.quote(input()))", False),
        ("import os, shlex\nx = input()\nif x:\n    x = shlex.quote(x)\nos.system(x)", True),
        ("import os\ndef f(a, b):\n    os.system(b)\nf(1, input())", True),
        ("import os\ndef f(a, b):\n    os.system(b)\nf(input(), 1)", False),
        ("import os\ndef f(a, b):\n    os.system(b)\nf(b=input(), a=2)", True),
        ("import os\ndef g():\n    return input()\nos.system(g())", True),
        ("import os\nd = {}\nd['a'] = input()\nd['b'] = 'x'\nos.system(d['b'])", False),
        ("import os\nd = {}\nd['a'] = input()\nos.system(d['a'])", True),
        ("import os\nclass C:\n    def run(self, v):\n        os.system(v)\n    def go(self):\n        self.run(input())", True),
        ("import os\nfor x in [input()]:\n    os.system(f'{x}')", True),
        ("import os\nwith open(input()) as f:\n    os.system(f.read())", True),
        ("import os\ny = [z for z in input()]\nos.system(y)", True),
        ("import os\nos.system('a' == input())", False),
    ],
)
def test_python_flows(text, expected):
    assert flows(text, kill="shlex.quote") is expected


def test_regions_of_structured_code():
    nodes, _ = pyast.lower("a/b.py", "def f(x):\n    if x:\n        g(1)\n    else:\n        h(2)\n    for i in x:\n        k(3)\n    try:\n        t()\n    finally:\n        z()\n    def inner():\n        w()\n")
    at = {n["callee_path"]: n for n in nodes if n["node_type"] == "code.Call"}
    root = at["g"]["region"].rsplit("/", 1)[0]
    assert at["g"]["region"].endswith(".t") and at["h"]["region"] == at["g"]["region"][:-1] + "e"
    assert "/loop" in at["k"]["region"] and at["z"]["region"] == root and at["z"]["ord"] > at["t"]["ord"]
    assert at["w"]["region"].startswith(root + "#fn") and at["g"]["loc"] == "a/b.py:3"


def test_unparsed_and_empty(spark):
    assert [n["node_type"] for n in pyast.lower("x.py", "def (")[0]] == ["code.Unparsed"]
    files = spark.createDataFrame([("x.py", "def ("), ("y.py", ""), ("z.py", None), ("w.py", "import os\ndef f(v):\n    os.system(v)"), ("v.py", "from w import f\nf(input())")], "path string, content string")
    nodes, edges = pyast.extract(files)
    calls = nodes.where("node_type = 'code.Call'")
    pick = lambda p: calls.where(calls.callee_path == p).select("node_id")
    reached = solve.flow_reach(edges, pick("input"), pick("none"))
    assert reached.join(pick("os.system"), "node_id").count() == 1  # across modules


@pytest.mark.parametrize("pattern,expected", [("(a+)+", True), (r"(\wx|a\w)*b", True), ("(a|ab)*", False), ("a*a*", True), (r"(\d+\s*)*x", True), ("(ab)+c", False), ("[a-z]+[0-9]+", False), ("a*b*", False), (r"\w+\d+", True), (r"^(?:x-)+y$", False), ("(", False)])
def test_ambiguous_patterns(pattern, expected):
    assert patterns.ambiguous(pattern) is expected


def test_classes():
    assert patterns.class_chars("[^ -~]") == "" and patterns.class_chars("[<>]") == "<>" and patterns.class_chars("ab") == ""
    assert patterns.strip_delimiters("/a\\/b/gi") == ("a\\/b", "gi") and patterns.strip_delimiters("abc") == ("abc", "")


def test_definitions(spark, tmp_path):
    (tmp_path / "b.rules").write_text("module b; rule R { issue Disk unless dominates coveredBy Check }")
    (tmp_path / "a.rules").write_text("module a; concept Disk { kind: issue } concept Check { kind: check }")
    found = definitions.load(str(tmp_path))
    assert [m.name for m in found] == ["a", "b"] and definitions.lint(found) == []
    assert [r.name for r in definitions.find(definitions.table(spark, found), "concept", "DIS").collect()] == ["Disk"]
    assert definitions.references(found, "Check") == ["b.R"]
    known = lang.ontology(*found)
    assert definitions.known_concepts(["is"], known) == ["Disk"]
    with pytest.raises(lang.RuleError, match="near: Disk"):
        definitions.known_concepts(["Dusk"], known)
    assert [definitions.parse_bytes(x) for x in ("512", "4K", "1.5 GiB")] == [512, 4096, 3 << 29]
