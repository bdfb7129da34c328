"""Steps whose data or memory would grow faster than the input."""

from pyspark.sql import functions as F

from lattica import storage
from lattica.graph import Graph, Recording, new_labels
from lattica.operators import flows, requirements, solve
from lattica.plans import flowing, rules
from lattica.plans.compile import Compiler, pruned
from lattica.sources import views

from .test_engine import frame
from .test_flows import edges


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_grant_chains_take_only_steps_on_a_way(spark):
    steps = edges(spark, "u>r r>s s>cap v>r w>r x>s s>y y>z z>cap")
    kept = {(r.src, r.dst) for r in solve.on_the_way(steps, frame(spark, ["u"]), frame(spark, ["cap"]), 4).collect()}
    assert kept == {("u", "r"), ("r", "s"), ("s", "cap")}
    longer = {(r.src, r.dst) for r in solve.on_the_way(steps, frame(spark, ["u"]), frame(spark, ["cap"]), 5).collect()}
    assert longer == kept | {("s", "y"), ("y", "z"), ("z", "cap")}


def test_the_round_that_finds_a_node_names_its_parent(spark):
    got = solve.closure(edges(spark, "a>c a>b b>d c>d d>a b>a"), frame(spark, ["a", "c"]), by_source=True, parents=True).collect()
    assert {(r.source, r.node_id): (r.depth, r.parent) for r in got} == {("a", "a"): (0, None), ("a", "b"): (1, "a"), ("a", "c"): (1, "a"), ("a", "d"): (2, "b"), ("c", "c"): (0, None), ("c", "d"): (1, "c"), ("c", "a"): (2, "d"), ("c", "b"): (3, "a")}


def test_dealt_edges_are_distinct_and_not_shuffled_again(spark):
    dealt = storage.dealt(edges(spark, "a>b a>b b>c").select("src", "dst"), "src", "edges")
    assert sorted((r.src, r.dst) for r in dealt.collect()) == [("a", "b"), ("b", "c")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    no_broadcast(spark)
    try:
        met = frame(spark, ["a"]).join(dealt, F.col("node_id") == F.col("src"))
        assert plan(met).count("Exchange hashpartitioning") == 1
        assert met.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_selectors_go_to_the_nodes(spark):
    nodes = spark.createDataFrame([(f"n{k}", "call", "a.r") for k in range(20)] + [("m", "call", "b.r")], "node_id string, family string, path string")
    selectors = spark.createDataFrame([("call", "r", "any", "sink"), ("call", "b.r", "b", "candidate")], "family string, selector string, binding string, concept string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    no_broadcast(spark)
    try:
        found = requirements.bind_selectors(nodes, selectors)
        # one segment has all nodes: a shuffle by it is one task
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
        assert {(r.node_id, r.binding) for r in found.collect()} == {(f"n{k}", "any") for k in range(20)} | {("m", "b")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_recorded_labels_are_those_that_a_comparison_finds(spark):
    label = lambda *rows: spark.createDataFrame(rows, "node_id string, concept string")
    before = label(("a", "x"), ("a", "x"), ("b", "y"))
    phase = Recording.of(Graph(None, None, before)).append_labels(label(("a", "x"), ("c", "x"))).append_labels(label(("c", "x")))
    got = sorted(map(tuple, phase.written.collect()))
    assert got == [("a", "x"), ("c", "x"), ("c", "x")] == sorted(map(tuple, new_labels(before, phase.graph.labels).collect()))
    assert "Exchange" not in plan(phase.written)


def test_the_code_graph_is_dealt_once(spark):
    g = flowing.code(spark, "/root/testdata/sf0.001")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(9).select(F.col("id").cast("string").alias("node_id"))
        joined = g.nodes.join(ids, "node_id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert joined.count("Exchange hashpartitioning") == 1


def test_guards_two_steps_away_and_flows_of_a_node_to_itself(spark):
    nodes = spark.createDataFrame([("a", "/f", 1), ("g", "/f", 2), ("m", "/f", 3), ("z", "/f", 4), ("q", "/f", 5)], "node_id string, region string, ord int")
    edges = spark.createDataFrame([("a", "a"), ("a", "m"), ("m", "g"), ("g", "g"), ("a", "z"), ("q", "q")], "src string, dst string")
    witnesses = spark.createDataFrame([("z", ["a", "z"]), ("q", ["q"])], "node_id string, path array<string>")
    got = flows.flow_guarded(witnesses, edges, nodes, nodes.where("node_id in ('g', 'q')")).collect()
    assert [r.node_id for r in got] == ["z"]


def shuffles(spark, df):
    """Exchanges of a plan without broadcasts."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return df().select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rounds_of_a_loop_are_one_table_and_not_shuffled(spark):
    rounds = storage.Growing(frame(spark, ["a", "b"]).withColumn("depth", F.lit(0)), "node_id", "rounds")
    rounds.add(frame(spark, ["c"]).withColumn("depth", F.lit(1)))
    assert sorted(map(tuple, rounds.table().collect())) == [("a", 0), ("b", 0), ("c", 1)]
    found = lambda: frame(spark, ["b", "d"]).distinct().join(rounds.table().select("node_id"), "node_id", "left_anti")
    assert shuffles(spark, found) == 1
    assert [r.node_id for r in found().collect()] == ["d"]


def test_parents_of_a_run_are_shuffled_once(spark):
    sources = spark.createDataFrame([("a", 0), ("x", 2)], "node_id string, rank int")
    r = flows.run(flows.written(edges(spark, "a>b x>y y>b b>c z>c x>a k>c x>k")), {"p": (sources, frame(spark, ["k"]))})
    assert {(p.node_id, p.parent) for p in r.parents("p").collect()} == {("y", "x"), ("a", "x"), ("k", "x"), ("b", "a"), ("c", "b")}
    assert shuffles(spark, lambda: r.parents("p")) == 1


def test_rules_read_only_nodes_that_can_carry_their_concepts(spark):
    g = pruned(rules.graph(spark, "/root/testdata/sf0.001"), [rules.RULES["Near"]], rules.ONTOLOGY)
    parts = Compiler(g, rules.ONTOLOGY, rules.LEVELS).nodes("Part")
    text = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "part.parquet" in text or "p_partkey" in text
    assert "l_orderkey" not in text and "o_orderkey" not in text and "c_custkey" not in text
    every = Compiler(Graph(g.nodes, g.edges, g.labels), rules.ONTOLOGY, rules.LEVELS).nodes("Part")
    assert sorted(r.node_id for r in parts.select("node_id").collect()) == sorted(r.node_id for r in every.select("node_id").collect()) != []


def test_the_kinds_of_a_graph_name_all_its_labels(spark):
    g = rules.graph(spark, "/root/testdata/sf0.001")
    found = g.labels.join(g.nodes.select("node_id", "node_type"), "node_id").select("concept", "node_type").distinct().collect()
    assert {(r.concept, r.node_type) for r in found} == {(c, t) for c, types in g.kinds.items() for t in types}
    assert g.append_labels(g.labels.limit(0)).kinds is None


def test_edges_that_are_dealt_are_not_made_distinct_before(spark):
    d = "/root/testdata/sf0.001"
    assert shuffles(spark, lambda: views.flows(spark, d, True)) == 0 < shuffles(spark, lambda: views.flows(spark, d))
    once, more = (sorted(map(tuple, storage.dealt(views.flows(spark, d, r).select("src", "dst"), "src").collect())) for r in (False, True))
    assert once == more


def test_rounds_by_source_are_not_shuffled_to_tell_what_is_new(spark):
    reached = solve.closure(edges(spark, "a>b b>c c>a d>c"), frame(spark, ["a", "d"]), by_source=True)
    found = lambda: spark.createDataFrame([("a", "c"), ("b", "c")], "source string, node_id string").distinct().join(reached.select("source", "node_id"), ["source", "node_id"], "left_anti")
    assert shuffles(spark, found) == 1
    assert [tuple(r) for r in found().collect()] == [("b", "c")]


def test_the_last_step_of_an_access_is_read_from_the_dealt_steps(spark):
    steps = spark.createDataFrame([("u", "r", "assume"), ("r", "x", "s3:*"), ("r", "x", "s3:Get*"), ("r", "x", "own"), ("r", "y", "own"), ("u", "y", None), ("x", "z", "s3:*")], "src string, dst string, ability string")
    access = lambda: solve.can_access(steps, frame(spark, ["u"]), frame(spark, ["x", "y", "z"]), "s3:GetObject")
    assert sorted(map(tuple, access().collect())) == [("u", "x", 2), ("u", "z", 3)]
    # what was reached, the resources, the steps that fit (by dst and src, as the resources go down to them), the result; the steps are not made distinct again
    assert shuffles(spark, access) <= 5


def test_the_run_names_the_parents_of_its_witnesses(spark):
    assert shuffles(spark, lambda: solving_query("witness_depth")(spark, "/root/testdata/sf0.001")) == 0


def test_the_frontier_of_a_trace_is_told_from_the_dealt_flows(spark):
    # calls, labels and the distinct rows; neither flows nor rounds
    assert shuffles(spark, lambda: solving_query("trace_frontier")(spark, "/root/testdata/sf0.001")) <= 3


def solving_query(name):
    from lattica.plans import catalog

    return catalog.queries()[name]
