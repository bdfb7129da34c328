import json

from pyspark.sql import functions as F

from lattica import report
from lattica.operators import context
from lattica.sources import manifests

PROPS = "node_id string, props map<string,string>"


def lines_of(spark, text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no int, line string")


def rows(df):
    return sorted((r.name, r.version) for r in df.collect())


def test_context_lines(spark):
    nodes = spark.createDataFrame([("net", {}), ("fw", {}), ("host", {"asset_kinds": "pii , card,pii"}), ("off", {}), ("p1", {"dst": "host", "flag": "yes"}), ("p2", {"dst": "host", "flag": "no"}), ("s1", {"at": "host"}), ("s2", {"at": "off"}), ("s3", {"at": "gone"}), ("s4", {}), ("s5", {"at": "net"})], PROPS)
    labels = spark.createDataFrame([("net", "Internet"), ("fw", "Inner"), ("host", "Store"), ("off", "Store"), ("p1", "Scan"), ("p2", "Scan")], "node_id string, concept string")
    edges = spark.createDataFrame([("net", "fw", "open"), ("fw", "host", "b-rule"), ("fw", "host", "a-rule"), ("host", "net", "back")], "src string, dst string, rule string")
    found = spark.createDataFrame([(f"s{i}",) for i in range(1, 6)], "node_id string")
    got = context.enrich(
        found, nodes, labels, edges, [context.Exposure(("Internet",), "at", "public"), context.Exposure(("Inner",), "at", "inside")],
        [context.Confirmation(("Scan",), "dst", "scanned", "flag", "yes"), context.Confirmation(("Scan",), "dst", "looked at")], [context.Holding(("Store",), "at")],
    )
    assert {r.node_id: r.context for r in got.collect()} == {
        "s1": ["host is public (via a-rule) — scanned — looked at", "host is inside (via a-rule) — scanned — looked at", "host holds [card pii]"],
        "s5": ["net is public (via back)", "net is inside (via back)"],
    }
    assert context.enrich(found, nodes, labels, edges, [], [], []).count() == 0


def test_go_mod(spark):
    text = 'module m\ngo 1.22\nrequire a.org/x v1 // c\nrequire (\n\tb.org/y v2 // indirect\n\n\t"c.org/Z" "v3"\n\tonly\n)\nreplace (\n d.org/q v1 => e v2\n)\nrequire f.org/w => g v1\nexclude h v1\nrequirements i v1\nrequire ( \n\tj.org/k v4\n)\n'
    assert rows(manifests.go_mod(lines_of(spark, text), "file")) == [("a.org/x", "v1"), ("b.org/y", "v2"), ("c.org/z", "v3"), ("j.org/k", "v4")]


def test_setup_files(spark):
    text = "[metadata]\ninstall_requires =\n  no\n[options]\ninstall_requires = first>1\n  second\n\n  third ~= 2.0\nzip_safe = x\n  not\n[Options]\nINSTALL_REQUIRES=\n\tfourth\n[options.x]\n  no2\n"
    assert rows(manifests.setup_cfg(lines_of(spark, text), "file")) == [("first", ">1"), ("fourth", "*"), ("second", "*"), ("third", "~=2.0")]
    text = "my_install_requires=['no']\nsetup(install_requires = (\n  \"A[x]>=1, <2\", 'b',\n  # c\n), x=['no'])\nsetup(install_requires=REQS)\n"
    one = spark.createDataFrame([("f", text), ("g", None)], "file string, t string")
    assert rows(manifests.setup_py(one, "file", "t")) == [("a", ">=1, <2"), ("b", "*")]


def test_git_pins(spark):
    text = '[[package]]\nsource = "git+ssh://h/a#1"\nsource = "git+https://h/b.git?x=1#2"\n[[package]]\nsource = "git+https://h/c"\n[[package]]\nsource = "registry+https://h#3"\n[[package]]\n source = \'git+git@h:d.git#4\'\n'
    assert rows(manifests.cargo_lock_git(lines_of(spark, text), "file")) == [("h/b.git?x=1", "2"), ("h/d", "4")]
    text = '# x\n[submodule "a"]\n path = a\n url = git@h:o/a.git\n[submodule "b"]\n path = b\n[submodule "c"]\n url = http://h/c\n path = c\n'
    commits = spark.createDataFrame([("f", "a", "1"), ("f", "b", "2"), ("f", "c", "3"), ("g", "a", "9"), ("f", "d", "")], "file string, path string, commit string")
    assert rows(manifests.gitmodules(lines_of(spark, text), "file", commits)) == [("h/c", "3"), ("h/o/a", "1")]


def test_json_manifests_and_npmrc(spark):
    texts = spark.createDataFrame([("f", '{"dependencies": {"A": "^1.2 || 2", "b": null}, "devDependencies": {"c": "~v3"}}'), ("g", "no json"), ("h", None), ("i", "[]")], "file string, t string")
    assert rows(manifests.package_json(texts, "file", "t")) == [("a", "1.2"), ("b", "*"), ("c", "3")]
    assert manifests.composer_lock(texts, "file", "t").count() == 0
    assert rows(manifests.npmrc(lines_of(spark, "runtime=electron\ntarget=1\nbrave_electron_version = 2 # x\ntarget=3"), "file")) == [("brave/electron", "2")]
    assert rows(manifests.npmrc(lines_of(spark, "runtime=node\ntarget=1"), "file")) == [] == rows(manifests.npmrc(lines_of(spark, "runtime=electron"), "file"))


def test_sarif_lines_are_one_document(spark):
    found = spark.createDataFrame([("b", "R1", "high", "x.py:3", ["n1", "n2"]), ("a", "R2", "low", "y.py:1", ["n2"]), ("c", "R1", "high", "", None)], "fp string, rule_id string, severity string, loc string, path array<string>")
    nodes = spark.createDataFrame([("n1", "x.py:1"), ("n2", None)], "node_id string, loc string")
    found = report.path_locations(found, nodes)
    text = "\n".join(r.line for r in report.sarif_lines(found).collect())
    doc = json.loads(text)
    assert report.validate_sarif(text) == [] and [r["partialFingerprints"]["primary/v1"] for r in doc["runs"][0]["results"]] == ["a", "b", "c"]
    flow = doc["runs"][0]["results"][1]["codeFlows"][0]["threadFlows"][0]["locations"]
    assert [x["location"]["physicalLocation"]["artifactLocation"]["uri"] for x in flow] == ["x.py", "n2"]
    assert "codeFlows" not in doc["runs"][0]["results"][0]
    assert json.loads("\n".join(r.line for r in report.sarif_lines(found.limit(0)).collect()))["runs"][0]["results"] == []
