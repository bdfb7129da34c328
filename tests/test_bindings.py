import random
import re

import pytest
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.graph import Graph
from lattica.operators import bind, coverage, requirements
from lattica.plans import bindings as B
from lattica.plans import lang, policies
from lattica.plans.compile import Compiler, needed_concepts, pruned
from lattica.streaming import refresh

FACTS = "module string, kind string, name string, version string"


def applied(spark, facts, text):
    found = B.parse(text)
    rows = requirements.applicable(spark.createDataFrame(facts, FACTS), found, B.strata(found)).collect()
    return {(r.module, r.binding): r.confidence for r in rows}


def test_requirements_against_their_trees(spark):
    """Random nested requirements, evaluated directly on each module's facts."""
    rng = random.Random(8)
    names = ["a", "b", "c", "d"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return ("import", rng.choice(names)) if rng.random() < 0.7 else ("dependency", rng.choice(names), rng.choice(["", ">=2", "<2", "==1.5"]))
        op = rng.choice(["all", "any", "not"])
        return (op, *(tree(depth - 1) for _ in range(rng.randrange(1, 4))))

    def text(t):
        if t[0] in ("import", "dependency"):
            return f'{t[0]}({", ".join(chr(34) + x + chr(34) for x in t[1:] if x)})'
        return f"{t[0]}({', '.join(map(text, t[1:]))})"

    def holds(t, facts):
        if t[0] == "import":
            return any(k == "import" and n == t[1] for _, k, n, _ in facts)
        if t[0] == "dependency":
            fits = {"": lambda v: True, ">=2": lambda v: v >= 2, "<2": lambda v: v < 2, "==1.5": lambda v: v == 1.5}[t[2]]
            return any(k == "dependency" and n == t[1] and fits(float(v)) for _, k, n, v in facts)
        some = [holds(x, facts) for x in t[1:]]
        return {"all": all(some), "any": any(some), "not": not all(some)}[t[0]]

    trees = {f"b{i}": (tree(2), tree(1)) for i in range(25)}
    facts = {(f"m{rng.randrange(14)}", k, rng.choice(names), rng.choice(["1", "1.5", "2.5"]) if k == "dependency" else "") for k in ("import", "dependency") for _ in range(25)}
    facts |= {("m99", "language", "x", "")}
    got = applied(spark, sorted(facts), " ".join(f"binding {n} {{ requires {{ {text(t)} soft({text(s)}) }} }}" for n, (t, s) in trees.items()))
    modules = {f[0] for f in facts}
    own = {m: [f for f in facts if f[0] == m] for m in modules}
    assert got == {(m, n): "high" if holds(s, own[m]) else "medium" for m in modules for n, (t, s) in trees.items() if holds(t, own[m])}


def test_requirements_on_what_others_emit(spark):
    text = """
    binding base { emits one requires { import(x) } }
    binding next { emits two requires { project.has(one) } }
    binding back { emits one requires { project.has(two) } }
    binding lone { emits three confidence low requires { project.has(four) } }
    binding ring { emits four requires { project.has(three) } }
    binding none { emits five requires { not(project.has(two)) } }
    binding last { emits six confidence low requires { project.has(five) soft(import(y)) } }
    binding free { emits seven }
    """
    got = applied(spark, [("m", "import", "x", ""), ("n", "import", "y", ""), ("o", "language", "z", "")], text)
    assert got == {("m", "base"): "high", ("m", "next"): "high", ("m", "back"): "high", ("n", "none"): "high", ("o", "none"): "high", ("n", "last"): "low", ("o", "last"): "low", ("m", "free"): "high", ("n", "free"): "high", ("o", "free"): "high"}
    with pytest.raises(lang.RuleError, match="absence"):
        B.strata(B.parse("binding a { emits x requires { not(project.has(y)) } } binding b { emits y requires { project.has(x) } }"))
    for wrong in ("binding a { requires { nothing(x) } }", "binding a { requires { import(x, y) } }", "binding a { requires { any() } }", "binding a { selects x }", "binding a { requires { any(" + ", ".join(f"all(import(a{i}), import(b{i}))" for i in range(9)) + ") } }"):
        with pytest.raises(lang.RuleError):
            B.parse(wrong)
    assert requirements.applicable(spark.createDataFrame([], FACTS), B.parse(text), B.strata(B.parse(text))).count() == 0


def test_needed_bindings_follow_requirements():
    found = B.parse("binding a { emits x requires { project.has(y) } } binding b { emits y requires { not(project.has(z)) } } binding c { emits z } binding d { emits w }")
    assert [b.name for b in B.needed(found, {"x"})] == ["a", "b", "c"] and B.needed(found, {"q"}) == []


def test_selectors_and_files(spark):
    nodes = spark.createDataFrame([("1", "call", "db.session.run"), ("2", "call", "run"), ("3", "param", "db.session.run"), ("4", "call", "xsession.run"), ("5", "call", None)], "node_id string, family string, path string")
    rows = [("call", "run", "short", "any"), ("call", "session.run", "long", "sql"), ("call", "session.run", "other", "raw"), ("param", "run", "p", "in")]
    got = requirements.bind_selectors(nodes, spark.createDataFrame(rows, "family string, selector string, binding string, concept string"))
    assert {(r.node_id, r.binding) for r in got.collect()} == {("1", "long"), ("1", "other"), ("2", "short"), ("4", "short"), ("3", "p")}
    files = spark.createDataFrame([("m", "src/settings.py"), ("m", "a+b.txt"), ("n", "settingsXpy")], "module string, path string")
    got = requirements.file_facts(files, ["settings.py", "a+*.txt", "*.md"])
    assert {(r.module, r.name) for r in got.collect()} == {("m", "settings.py"), ("m", "a+*.txt")}


def go_matches(o, w):
    def norm(s):
        return s.strip("\"'").strip().lower().split("[")[0]

    def root(s):
        return "/".join(s.split("/")[:2]) if s.startswith("@") else s.split("/")[0]

    o, w = norm(o), norm(w)
    inside = lambda path, x: "/" in path and x and not re.search("[./]", x) and x in path.split("/")
    return bool(o and w) and (o == w or root(o) == w or root(w) == o or any(a.startswith(b + c) for a, b in ((o, w), (w, o)) for c in "./") or inside(o, w) or inside(w, o))


def test_nine_ways_are_one_join(spark):
    rng = random.Random(6)
    parts = ["a", "b", "core", "@s", "x.y", ""]
    names = sorted({rng.choice(["/", "."]).join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(60)} | {'"A"', "b[extra]", "@s/a", "@s/a/b", "core/", "/"})
    pairs = spark.createDataFrame([(o, w) for o in names for w in names], "name string, package string")
    expected = {(o, w) for o in names for w in names if go_matches(o, w)}
    assert {tuple(r) for r in pairs.where(S.package_matches("name", "package")).collect()} == expected
    one = spark.createDataFrame([(n,) for n in names], "name string")
    assert {tuple(r) for r in bind.package_pairs(one, one.withColumnRenamed("name", "package")).collect()} == expected


def test_verdicts_on_names(spark):
    p = spark.createDataFrame([("left", "1", False), ("left", "2", True), ("all", "9", False), ("reqests", "1", None), ("requests", "1", False)], "name string, version string, trusted boolean")
    known = spark.createDataFrame([("left", "2"), ("all", "*")], "name string, version string")
    got = bind.name_verdicts(p, known, spark.createDataFrame([("requests",), ("lefty",)], "name string"))
    assert {tuple(r) for r in got.collect()} == {("left", "1", "suspicious", None), ("all", "9", "malicious", None), ("reqests", "1", "suspicious", "requests")}


def test_labels_that_no_rule_needs_are_not_scanned(spark, tmp_path):
    module = lang.parse('module m; concept a { kind: issue } concept a2 { kind: issue, refines: a } concept b { kind: check } concept c { kind: issue } rule R { issue a as x unless global coveredBy b }')
    onto = lang.ontology(module)
    assert needed_concepts(module.rules, onto) == {"a", "a2", "b"}
    deep = lang.parse('module m; concept a { kind: issue } concept b { kind: check } rule R { issue a as x where dominates(b, x) and not x.kind in ["p"] }')
    assert needed_concepts(deep.rules, lang.ontology(deep)) >= {"a", "b"}
    nodes = spark.createDataFrame([(f"n{i}", "code.Call", "f:1", "", 0, "", "", "") for i in range(40)], "node_id string, node_type string, loc string, region string, ord int, scope string, method string, callee_path string").withColumn("props", F.create_map().cast("map<string,string>"))
    labels = spark.createDataFrame([(f"n{i}", "adc"[i % 3] if i % 4 else "a2", "x") for i in range(40)], "node_id string, concept string, confidence string").withColumn("fidelity", F.lit("semantic")).withColumn("detail", F.create_map().cast("map<string,string>"))
    edges = spark.createDataFrame([], "edge_type string, src string, dst string")
    Graph(nodes, edges, labels).write(str(tmp_path))
    g = Graph(nodes, edges, spark.read.parquet(f"{tmp_path}/labels"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = pruned(g, module.rules, onto).labels
        assert rows.count() == labels.where("concept in ('a', 'a2', 'b')").count()
        scan = rows.select("node_id")._jdf.queryExecution().executedPlan()
        scan.executeCollect()
        leaf = scan.collectLeaves().apply(0)
        read = leaf.metrics().apply("numOutputRows").value()
        assert read == labels.where("concept in ('a', 'a2', 'b')").count() < labels.count() and "PartitionFilters" in leaf.verboseStringWithOperatorId()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {r.node_id for r in Compiler(g, onto).compile(module.rules[0]).collect()}
    assert want == {r.node_id for r in Compiler(pruned(g, module.rules, onto), onto).compile(module.rules[0]).collect()} and want


def test_same_receiver_by_node_and_role(spark):
    rows = [("x", "a.run", "r1"), ("y", "b.run", "r2"), ("z", "c.run", None)]
    c = spark.createDataFrame(rows, "node_id string, callee_path string, recv string")
    g = spark.createDataFrame([("g", "a.check", None), ("r2", "", None)], "node_id string, callee_path string, recv string")
    ids = lambda d: sorted(r.node_id for r in d.collect())
    assert ids(coverage.uncovered_same_receiver(c, g)) == ["z"]
    assert ids(coverage.uncovered_same_receiver(c, g, spark.createDataFrame([("x",)], "node_id string"))) == ["y", "z"]


def test_manifest_of_a_hot_module(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("module"), F.col("id").alias("v"), F.when(F.col("id") % 3 > 0, "t").alias("t"))
    rows = rows.union(spark.sql("select 'cold', 1L, null"))
    of = lambda df: {r.module: (r.version, r.n) for r in refresh.manifest(df, "module", ["v", "t"]).collect()}
    a = of(rows)
    assert a == of(rows.repartition(7, "v").orderBy(F.desc("v"))) and a["hot"][1] == 20_000
    assert of(rows.where("v <> 7"))["hot"] != a["hot"] and of(rows.where("v <> 7"))["cold"] == a["cold"]
    assert of(rows.union(rows.where("v = 7")))["hot"] != a["hot"]
    assert of(rows.withColumn("t", F.coalesce("t", F.lit(""))))["hot"] != a["hot"]


def test_policies(spark):
    p = policies.parse(policies.CORE)["priority"]
    assert p.bands[0] == (8, "P0") and p.factors["confidenceLow"][1] == -2
    f = spark.createDataFrame([("critical", "high", True), ("odd", "low", None), (None, "medium", False)], "severity string, confidence string, context_internetReachable boolean")
    got = [(r.total, r.band, r.factors) for r in policies.prioritise(f, p).collect()]
    assert got == [(6, "P1", ["exposure"]), (-1, "P4", ["confidenceLow"]), (0, "P4", ["confidenceMedium"])]
    own = policies.parse('policy priority mine { score kind { a: 1 default: 5 } factor f { when x.n >= 3 and not y in [p, q] weight: -4 } bands: [ { band: "hi", min: 2 }, { band: "lo", min: 0 } ] }')["priority"]
    g = spark.createDataFrame([("a", 3, "z"), ("b", 3, "p"), ("b", None, None)], "kind string, x_n int, y string")
    assert [(r.total, r.band) for r in policies.prioritise(g, own).collect()] == [(-3, "lo"), (5, "hi"), (5, "hi")]
    for wrong in ("policy priority p { score a { x: y } }", "policy priority p { factor f { weight: 1 } }"):
        with pytest.raises(lang.RuleError):
            policies.parse(wrong)
