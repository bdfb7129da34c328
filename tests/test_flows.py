import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import flows, solve


def frame(spark, names, column="node_id"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "src string, dst string")


def ranked(spark, **ranks):
    return spark.createDataFrame(list(ranks.items()), "node_id string, rank int")


def test_a_better_source_wins_over_a_nearer_one(spark):
    e = flows.written(edges(spark, "weak>q far>a a>b b>q q>r weak>c c>k k>q2"))
    runs = flows.run(e, {"p": (ranked(spark, weak=1, far=3), frame(spark, ["k"]))})
    got = {r.node_id: (r.path, r["rank"]) for r in runs.witnesses("p", frame(spark, ["q", "r", "c", "q2", "k", "none"])).collect()}
    assert got == {"q": (["far", "a", "b", "q"], 3), "r": (["far", "a", "b", "q", "r"], 3), "c": (["weak", "c"], 1)}
    assert {(r.node_id, r.depth) for r in runs.near_misses("p").collect()} == {("k", 2)}
    assert {(r.node_id, r.depth) for r in runs.reached("p").where("node_id in ('q', 'r')").collect()} == {("q", 1), ("r", 2)}


def test_long_paths_keep_their_root(spark):
    parents = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 501)] + [("x", "n3")], "node_id string, parent string")
    got = {r.node_id: r.path for r in flows.witness_paths(parents, frame(spark, ["n500", "n1", "n0", "x"])).collect()}
    assert got == {"n500": [f"n{i}" for i in range(501)], "n1": ["n0", "n1"], "n0": ["n0"], "x": ["n0", "n1", "n2", "n3", "x"]}


def test_many_policies_equal_single_runs(spark):
    rng = random.Random(3)
    names = [f"v{i}" for i in range(25)]
    text = " ".join(f"{rng.choice(names)}>{rng.choice(names)}" for _ in range(45))
    e = flows.written(edges(spark, text))
    some = lambda k: rng.sample(names, k)
    policies = {f"p{i}": (some(2), some(3)) for i in range(17)}  # more than one column of masks
    runs = flows.run(e, {n: (frame(spark, s), frame(spark, k)) for n, (s, k) in policies.items()})
    pairs = {tuple(x.split(">")) for x in text.split()}
    assert "m1" in runs.bits.columns
    bits = runs.bits.collect()
    for i, (name, (sources, kills)) in enumerate(policies.items()):
        depth, front, d = {s: 0 for s in sources}, set(sources), 0
        while front:
            d += 1
            front = {b for a, b in pairs if a in front and a not in kills} - depth.keys()
            depth |= dict.fromkeys(front, d)
        got = {}
        for r in bits:
            if r[f"m{i // flows.POLICIES}"] >> flows.RANKS * (i % flows.POLICIES) & 15:
                got[r.node_id] = min(r.depth, got.get(r.node_id, 99))
        assert got == depth, name
    name, (sources, kills) = "p16", policies["p16"]
    one = solve.flow_reach(edges(spark, text), frame(spark, sources), frame(spark, kills))
    assert sorted(map(tuple, one.select("node_id", "depth").collect())) == sorted(map(tuple, runs.reached(name).select("node_id", "depth").collect()))


@pytest.mark.parametrize(
    "flow,guards,regions,covered",
    [
        ("", "a", {}, True),  # the path s a q passes the guard
        ("", "q", {}, False),  # the sink's own label is no matter of the flow
        ("s>g", "g", {"g": ("/fn1", 1), "a": ("/fn1", 2)}, True),  # a neighbour dominates a later node
        ("s>h h>g", "g", {"g": ("/fn1", 1), "a": ("/fn1/if1.t", 2)}, True),
        ("s>h h>i i>g", "g", {"g": ("/fn1", 1), "a": ("/fn1", 2)}, False),  # three steps
        ("s>g", "g", {"g": ("/fn1", 3), "a": ("/fn1", 2)}, False),  # later than the node
        ("s>g", "g", {"g": ("/fn1/if1.t", 1), "a": ("/fn1/if1.e", 2)}, False),  # another branch
        ("q>g", "g", {"g": ("/fn1", 1), "a": ("/fn1", 2)}, False),  # only what comes later on the path counts
        ("s>g", "g", {"a": ("/fn1", 2)}, False),  # a guard without regions
    ],
)
def test_flow_guards(spark, flow, guards, regions, covered):
    e = edges(spark, f"s>a a>q {flow}")
    nodes = spark.createDataFrame([(n, *regions.get(n, ("", 0))) for n in "s a q g h i".split()], "node_id string, region string, ord int")
    w = spark.createDataFrame([("q", ["s", "a", "q"])], "node_id string, path array<string>")
    got = flows.flow_guarded(w, e, nodes, nodes.where(F.col("node_id") == guards))
    assert [r.node_id for r in got.collect()] == (["q"] if covered else [])


def test_chains_of_roles_from_both_ends(spark):
    steps = edges(spark, "u>r1 r1>r2 r2>r3 r3>r4 r4>cap u>x x>cap2 r2>y y>cap2 v>r4 r1>u")
    got = {(r.source, r.resource): r.path for r in solve.grant_chains(steps, frame(spark, ["u", "v"]), frame(spark, ["cap", "cap2", "u"]), 6).collect()}
    assert got[("u", "cap")] == ["u", "r1", "r2", "r3", "r4", "cap"]
    assert got[("u", "cap2")] == ["u", "x", "cap2"] and got[("v", "cap")] == ["v", "r4", "cap"]
    assert ("v", "cap2") not in got and len(got) == 3
    short = solve.grant_chains(steps, frame(spark, ["u"]), frame(spark, ["cap"]), 4)
    assert short.count() == 0


def test_paths_that_cannot_end_are_not_grown(spark):
    steps = spark.createDataFrame([("s", "a", "x"), ("a", "t", "x"), ("s", "b", "x"), *((f"b{i}" if i else "b", f"b{i + 1}", "x") for i in range(6))], "src string, dst string, kind string")
    assert [r.path for r in solve.attack_paths(steps, frame(spark, ["s"]), frame(spark, ["t"]), 5).collect()] == [["s", "a", "t"]]
    assert solve.attack_paths(steps, frame(spark, ["s"]), frame(spark, ["t"]), 1).count() == 0
