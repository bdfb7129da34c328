import json

import pytest
from pyspark.sql import functions as F

from lattica import report
from lattica.graph import Graph
from lattica.operators import bind, coverage, findings, solve
from lattica.plans import lang
from lattica.plans.compile import Compiler, active, needed_concepts
from lattica.sources import dsl, textscan
from lattica.streaming import refresh


def ids(df, column="node_id"):
    return sorted(r[column] for r in df.select(column).collect())


def frame(spark, names, column="node_id"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "src string, dst string")


@pytest.mark.parametrize(
    "flow,sources,kills,expected",
    [
        ("in>q", "in", "t", ["q"]),
        ("in>t t>q in>q", "in", "t", ["q"]),
        ("in>t t>q", "in", "t", []),
        ("in>t t>j in2>j j>q", "in in2", "t", ["q"]),
        ("in>b b>q", "in", "b", []),
        ("in>a a>b b>a b>q", "in", "", ["q"]),
        ("in>a in>b a>q b>q", "in", "", ["q"]),
        ("in>q", "in", "q", []),
        ("x>q", "in", "", []),
        ("in>q", "in", "in", []),
    ],
)
def test_taint(spark, flow, sources, kills, expected):
    e, k = edges(spark, flow), frame(spark, kills.split())
    reached = solve.flow_reach(e, frame(spark, sources.split()), k)
    assert ids(solve.taint_flows(reached, frame(spark, ["q"]), k)) == expected


def test_search_stops_at_targets_but_not_for_access(spark):
    e = edges(spark, "s>a a>b b>c s>c")
    hops = e.withColumn("proto", F.lit("tcp"))
    got = {(r.source, r.target, r.depth) for r in solve.hop_reach(hops, frame(spark, ["s"]), frame(spark, ["a", "b", "s"])).collect()}
    assert got == {("s", "a", 1)}
    steps = e.withColumn("ability", F.when(F.col("dst") == "b", "s3:GetObject*").otherwise("assume"))
    got = {(r.source, r.resource, r.depth) for r in solve.can_access(steps, frame(spark, ["s"]), frame(spark, ["a", "b"]), "s3:GetObject").collect()}
    assert got == {("s", "b", 2)}
    assert solve.can_access(steps, frame(spark, ["s"]), frame(spark, ["b"]), "s3:DeleteObject").count() == 0


def test_grants_by_level(spark):
    e = edges(spark, "a>s1 s1>s2 s2>cap")
    levels = spark.createDataFrame([("cap", 3), ("s1", 1)], "node_id string, rank int")
    got = solve.grant_closure(e, frame(spark, ["a"]), frame(spark, []), levels, 3).collect()
    assert [(r.source, r.target, r.depth) for r in got] == [("a", "cap", 3)]


def test_witness_prefers_rank_then_id(spark):
    e = edges(spark, "a>x b>x x>q")
    reached = solve.closure(e, frame(spark, ["a", "b"]))
    assert {r.node_id: r.parent for r in solve.witness_parents(e, reached).collect()} == {"x": "a", "q": "x"}
    ranks = spark.createDataFrame([("b", 3), ("a", 1)], "node_id string, rank int")
    parents = solve.witness_parents(e, reached, ranks)
    assert solve.witness_paths(parents, frame(spark, ["q"])).first().path == ["b", "x", "q"]


def test_attack_paths_and_choke_points(spark):
    steps = spark.createDataFrame([("s", "a", "reach"), ("a", "g", "reach"), ("s", "b", "reach"), ("b", "g", "reach"), ("g", "t", "exploits"), ("s", "a", "grant")], "src string, dst string, kind string")
    paths = solve.attack_paths(steps, frame(spark, ["s"]), frame(spark, ["t"]), 5)
    assert sorted(r.path for r in paths.collect()) == [["s", "a", "g", "t"], ["s", "b", "g", "t"]]
    got = {(r.src, r.dst, r.kind): r.severed for r in solve.choke_points(paths, steps).collect()}
    assert got[("g", "t", "exploits")] == 2 and ("s", "a", "reach") not in got and got[("s", "b", "reach")] == 1


def test_kill_by_characters(spark):
    rows = [("a", "x", {"alphabet": "abc"}), ("b", "x", {"removed": "<>"}), ("c", "x", {"removed": "<"}), ("d", "clean", {"advisory": "true"}), ("e", "clean", {}), ("f", "x", {})]
    labels = spark.createDataFrame(rows, "node_id string, concept string, detail map<string,string>")
    assert ids(solve.kill_nodes(labels, ["clean"], "<>")) == ["a", "b", "e"]


# ---- coverage


def code(spark, rows):
    return spark.createDataFrame([(i, r, o, f"app:{o}", r, c) for i, r, o, c in rows], "node_id string, region string, ord int, loc string, scope string, callee_path string")


def test_coverage_parts(spark):
    c = code(spark, [("x", "/fn1", 5, "a.b"), ("y", "/fn1/if2.t", 5, "a.c"), ("z", "", 5, "q")])
    g = lambda *r: code(spark, list(r))
    assert ids(coverage.uncovered_dominates(c, g(("g", "/fn1/if2.e", 2, "")))) == ["x", "y", "z"]
    assert ids(coverage.uncovered_dominates(c, g(("g", "/fn1", 1, "")))) == ["z"]
    assert ids(coverage.uncovered_post_dominates(c, g(("g", "/fn1", 9, "")))) == []
    assert ids(coverage.uncovered_post_dominates(c, g(("g", "/fn1/if2.t", 9, "")))) == ["x"]
    assert ids(coverage.uncovered_post_dominates(c, g(("g", "", 0, "")))) == []
    assert ids(coverage.uncovered_post_dominates(c, g())) == ["x", "y", "z"]
    assert ids(coverage.uncovered_same_scope(c, g(("g", "/fn1/if2.t", 0, "")))) == ["x", "z"]
    assert ids(coverage.uncovered_same_receiver(c, g(("g", "", 0, "a.k")))) == ["z"]
    assert ids(coverage.uncovered_global(c, g(("g", "", 0, "")))) == [] and coverage.uncovered_global(c, g()).count() == 3


def test_endpoint_coverage(spark):
    c = code(spark, [("x", "/fn1", 5, ""), ("z", "", 5, "")])
    none = spark.createDataFrame([], "edge_type string, src string, dst string")
    link = lambda s, t: spark.createDataFrame([("CHECKS", s, t)], "edge_type string, src string, dst string")
    late, bare, loop = code(spark, [("g", "/fn1", 9, "")]), code(spark, [("g", "", 0, "")]), code(spark, [("g", "/fn1/loop2/b", 2, "")])
    assert ids(coverage.uncovered_endpoint(c, late, link("g", "x"))) == ["x", "z"]
    assert ids(coverage.uncovered_endpoint(c, bare, link("g", "x"))) == ["z"]
    assert ids(coverage.uncovered_endpoint(c, bare, none)) == ["x", "z"]
    assert ids(coverage.uncovered_endpoint(c, loop, none)) == ["z"]


# ---- labels


def test_tenant_and_negative_claims(spark):
    s = "node_id string, concept string, app_seq long, specificity int, fidelity string, origin string, negative boolean, confidence string"
    rows = [("a", "k", 1, 0, "semantic", "builtin", False, "high"), ("a", "k", 2, 1, "syntactic", "builtin", False, "high"), ("b", "k", 1, 0, "semantic", "builtin", False, "high"), ("b", "k", 3, 0, "semantic", "tenant", True, "high"), ("c", "k", 1, 0, "resolved", "builtin", True, "high"), ("c", "k", 2, 0, "syntactic", "tenant", False, "high"), ("d", "k", 1, 2, "semantic", "builtin", True, "high"), ("d", "k", 2, 1, "semantic", "builtin", False, "high")]
    won, lost = findings.resolve(spark.createDataFrame(rows, s))
    assert sorted((r.node_id, r.app_seq) for r in won.collect()) == [("a", 2), ("c", 2)]
    assert sorted((r.node_id, r.app_seq) for r in lost.collect()) == [("a", 1), ("b", 1), ("d", 2)]


def test_confidence_and_priority(spark):
    labels = spark.createDataFrame([("a", "k", "high", "semantic"), ("b", "k", "high", "syntactic"), ("a", "other", "low", "semantic")], "node_id string, concept string, confidence string, fidelity string")
    assert {r.node_id: r.confidence_rank for r in findings.node_confidence(labels, "k").collect()} == {"a": 3, "b": 2}
    f = spark.createDataFrame([("r", "high", True, True), ("r", "high", None, False)], "rule_id string, severity string, exposed boolean, asset boolean")
    assert [(r.total, r.band) for r in findings.priority(f, {"exposed": 2, "asset": 2}).orderBy(F.desc("total")).collect()] == [(7, "P1"), (3, "P3")]


def test_packages(spark):
    p = spark.createDataFrame([("npm", "reacts", "5.5.0"), ("npm", "lodash", "5.10.1"), ("npm", "left", "0.1.6")], "eco string, name string, version string")
    a = spark.createDataFrame([("npm", "reacts", "A", None, "5.10.0", None), ("npm", "lodash", "B", None, "5.10.0", None), ("npm", "left", "C", "0.1.6", None, None)], "eco string, name string, id string, exact string, min_safe string, max_safe string")
    assert ids(bind.advisory_matches(p, a), "id") == ["A", "C"]
    names, popular = frame(spark, ["reacts", "raect", "react", "lodas"], "name"), frame(spark, ["react", "lodash"], "name")
    assert sorted((r.name, r.near) for r in bind.typosquats(names, popular).collect()) == [("lodas", "lodash"), ("reacts", "react")]
    bad = spark.createDataFrame([("left", "0.1.6"), ("reacts", "1")], "name string, version string")
    assert {r.name: r.verdict for r in bind.malware_verdicts(p, bad).collect()} == {"left": "malicious", "reacts": "suspicious"}


# ---- language

SPEC = """
concept Internet { kind: exposure }
concept Db { kind: asset }
concept Bucket { kind: asset, refines: Db }
concept Refund { kind: issue }
concept Authz { kind: check }
rule Open { meta { id: "A" severity: high } reach Internet -> Db as d where holdsAssetKind(d, Pii) }
rule Unguarded { meta { id: "B" } issue Refund unless endpoint coveredBy Authz }
rule Scored { issue Refund as r where r.score >= 7 or r.kind in ["api", "batch"] }
rule Staged { require profile none issue Refund }
""".replace("rule Staged { require profile none issue Refund }", "rule Staged { issue Refund require profile none }")


def run(spark, graph_text):
    module = lang.parse(SPEC)
    known = lang.ontology(module)
    assert lang.check(module, known) == []
    c = Compiler(dsl.load(spark, graph_text), known)
    return sorted((r.rule_id, r.node_id) for rule in active(module.rules, "web") for r in c.compile(rule).collect())


def test_rules_on_small_graphs(spark):
    got = run(spark, """
        node net Internet
        node db Db { asset_kinds = Pii }        # reached
        node far Bucket { asset_kinds = Other, x = Pii }
        node low Bucket { asset_kinds = Pii }
        edge NET net -> db { rule = sg-pub }
        edge NET net -> far
        edge NET db -> low
        node r1 Refund { score = 9, kind = worker, region = /fn1, order = 5 }
        node r2 Refund { score = high, kind = batch }
        node r3 Refund { score = 6, kind = worker }
        node c Authz { coverage = endpoint, region = /fn1, order = 1 }
        node c2 Authz { coverage = endpoint }
        edge CHECKS c2 -> r2
    """)
    assert got == [("A", "db"), ("B", "r3"), ("Scored", "r1"), ("Scored", "r2")]


def test_checks(spark):
    bad = lang.parse("""
        concept A { kind: source, taint: [T] } concept B { kind: sink, vulnerable_to: [T] } concept C { kind: check, neutralizes: [U] } concept D { kind: thing, refines: Nowhere }
        rule R { taint B -> A unless path coveredBy C }
        rule S { taint A -> B unless path coveredBy C unless sideways coveredBy A with confidence >= sure }
        rule S { query concept as x where x.concept == A select y }
    """)
    wrong = "\n".join(lang.check(bad, lang.ontology(bad)))
    for part in ("B is sink, not source", "neutralises no threat", "unknown coverage sideways", "A is no check", "unknown confidence sure", "declared twice", "select names y", "unknown kind thing", "refines Nowhere"):
        assert part in wrong, part
    for text in ("rule R { issue }", "rule R { taint A B }", "junk", "rule R { issue A where ( }", "concept A { kind: @ }"):
        with pytest.raises(lang.RuleError):
            lang.parse(text)


def test_expressions():
    rule = lang.parse('rule R { issue A as a where not a.x == "1" and a.y in [p, "q"] or a.z exists }').rules[0]
    assert rule.where == [lang.Op("or", (lang.Op("and", (lang.Op("not", (lang.Op("==", (lang.Ref("a.x"), "1")),)), lang.Op("in", (lang.Ref("a.y"), ["p", "q"])))), lang.Op("exists", (lang.Ref("a.z"),))))]


def test_ontology_and_strata():
    m = lang.parse('concept A { aliases: [Old] } concept B { refines: Old } concept C { refines: B } rule R { issue A unless dominates coveredBy C }')
    known = lang.ontology(m)
    assert known.descendants("Old") == ["A", "B", "C"] and needed_concepts(m.rules, known) == {"A", "B", "C"}
    assert lang.stratify({"p": [("q", True)], "q": [("q", False)]}) == [["q"], ["p"]]
    with pytest.raises(lang.RuleError):
        lang.stratify({"p": [("q", True)], "q": [("p", False)]})
    assert lang.semver_allows(">=1.2 <2", "1.9.9") and lang.semver_allows("^1.2", "1.3.0") and not lang.semver_allows("~1.2.0", "1.3.0")


def test_policy_runs_are_shared(spark):
    m = lang.parse("concept S { kind: source } concept K { kind: sink } concept L { kind: sink } rule A { taint S -> K } rule B { taint S -> L }")
    c = Compiler(dsl.load(spark, "node s S\nnode k K\nnode l L\nedge FLOWS s -> k\nedge FLOWS k -> l"), lang.ontology(m))
    assert [[r.node_id for r in c.compile(rule).collect()] for rule in m.rules] == [["k"], ["l"]] and len(c.runs) == 1


# ---- sources, sinks, refresh


def test_text_sources(spark):
    text = "Flask==2.0.1\n# comment\nrequests\n-r dev.txt\n  django == 4.2  \npyyaml>=6.0 # why\n"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "f int, line_no int, line string")
    assert {(r.name, r.specifier) for r in textscan.requirements(lines).collect()} == {("flask", "==2.0.1"), ("requests", "*"), ("django", "==4.2"), ("pyyaml", ">=6.0")}
    lines = spark.createDataFrame([(1, 1, "a=1"), (1, 2, "# a=5"), (1, 3, " a : 2 "), (1, 4, "PermitRoot yes"), (1, 5, "k e y : v")], "f int, line_no int, line string")
    got = {r.name: r.value for r in textscan.properties(lines, "f").collect()}
    assert got["a"] == "2"
    rules = [textscan.LineRule("root", "directive", "PermitRoot=yes"), textscan.LineRule("k", "compact", "key:v")]
    assert sorted((r.line_no, r.concept) for r in textscan.config_lines(lines, rules).collect()) == [(4, "root"), (5, "k")]
    paths = spark.createDataFrame([("a/b.py", ""), ("x/run", "#!/usr/bin/env python3\n"), ("Dockerfile", ""), ("z.bin", "")], "p string, c string")
    assert [r[0] for r in paths.select(textscan.route(F.col("p"), F.col("c"))).collect()] == ["python", "python", "config", ""]


def test_files_are_read(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    for name, text in (("a.py", "x = 1"), ("vendor/b.py", "y"), ("c.min.js", "z"), ("bin.dat", "\0")):
        (tmp_path / name).write_text(text)
    assert [r.path.rsplit("/", 1)[1] for r in textscan.read_files(spark, str(tmp_path)).collect()] == ["a.py"]


def test_reports(spark):
    f = spark.createDataFrame([("R1", "high", "high", "ab", "x.py:3", "P1", 7), ("R2", "low", "low", "cd", "y", "P4", 1)], "rule_id string, severity string, confidence string, fp string, loc string, band string, total int")
    doc = report.sarif(f).first().sarif
    assert report.validate_sarif(doc) == []
    results = json.loads(doc)["runs"][0]["results"]
    assert [(r["ruleId"], r["level"]) for r in results] == [("R1", "error"), ("R2", "note")]
    assert results[0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    assert [r.line for r in report.text_report(f).collect()] == ["[P1] R1 ab (high)", "[P4] R2 cd (low)"]
    envelope = report.api_json(f.withColumn("evidence", F.array(F.struct(F.lit("unless").alias("clause"))))).first().json
    assert report.validate_api(envelope) == [] and json.loads(envelope)["finding"]["evidence"] == [{"clause": "unless"}]
    assert report.validate_api('{"version": 2, "finding": {"fp": "x"}}') == ["version 2", "no rule_id", "no severity", "no confidence"]
    assert json.loads(report.finding_json(f).first().json)["rule_id"] == "R1"


def test_baseline_and_storage(spark, tmp_path):
    f = spark.createDataFrame([("R1", "ab"), ("R1", "cd")], "rule_id string, fp string")
    dsl.write_baseline(f.limit(1), str(tmp_path / "base"))
    split = findings.baseline_split(f, dsl.read_baseline(spark, str(tmp_path / "base")).select("fp"))
    assert sorted(r.status for r in split.collect()) == ["covered", "reported"]
    g = dsl.load(spark, "node a A { k = v }\nlabel a B\nedge NET a -> a")
    g.write(str(tmp_path / "graph"))
    back = Graph.read(spark, str(tmp_path / "graph"))
    assert ids(back.nodes_with_concept("B")) == ["a"] and back.node("a").first().props == {"k": "v"}
    with pytest.raises(ValueError):
        dsl.parse("nonsense here")


def test_incremental_equals_full(spark, tmp_path):
    old = spark.createDataFrame([("m1", 1), ("m2", 2), ("m3", 3)], "module string, v int")
    new = spark.createDataFrame([("m1", 1), ("m2", 5), ("m4", 4)], "module string, v int")
    evaluate = lambda rows: rows.select("module", (F.col("v") * 10).alias("w"))
    got = refresh.refresh(new, evaluate(old), "module", refresh.manifest(old, "module", ["v"]), ["v"], evaluate)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evaluate(new).collect()))
    assert {(r.module, r.op) for r in refresh.delta(refresh.manifest(old, "module", ["v"]), refresh.manifest(new, "module", ["v"]), "module").collect()} == {("m1", "same"), ("m2", "changed"), ("m3", "deleted"), ("m4", "added")}


def test_file_stream(spark, tmp_path):
    new = spark.createDataFrame([("m1", 1)], "module string, v int")
    new.write.parquet(str(tmp_path / "in"))
    seen = []
    q = refresh.follow(spark, str(tmp_path / "in"), new.schema, str(tmp_path / "ck"), lambda df, n: seen.append(df.count()))
    q.awaitTermination(60)
    assert sum(seen) == 1
