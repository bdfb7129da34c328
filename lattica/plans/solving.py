"""Recursive queries: reach, grants, access, traces, attack paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import solve
from ..sources import views
from ..storage import dealt, materialize
from .catalog import FLOWS, NET, STEPS, query

SOURCES = "sources AS (SELECT 'C:' || c_custkey AS node_id FROM customer WHERE c_mktsegment = 'BUILDING')"
KILLS = "kills AS (SELECT 'O:' || o_orderkey AS node_id FROM orders WHERE o_orderpriority = '1-URGENT')"
REACH = "r(node_id) AS (SELECT node_id FROM sources UNION SELECT f.dst FROM r JOIN flows f ON f.src = r.node_id WHERE r.node_id NOT IN (SELECT node_id FROM kills))"
DEPTH = "d(node_id, depth) AS (SELECT node_id, 0 FROM sources UNION SELECT f.dst, d.depth + 1 FROM d JOIN flows f ON f.src = d.node_id WHERE d.node_id NOT IN (SELECT node_id FROM kills) AND d.depth < 10)"


def sources(spark, d):
    return views.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(views.ident("C", "c_custkey").alias("node_id"))


def kills(spark, d):
    return views.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(views.ident("O", "o_orderkey").alias("node_id"))


def sinks(spark, d):
    return views.table(spark, d, "supplier").where("s_acctbal < 2000").select(views.ident("S", "s_suppkey").alias("node_id"))


def reached(spark, d):
    return materialize(solve.flow_reach(views.flows(spark, d, True), sources(spark, d), kills(spark, d)), "policy")


@query("flow_reach", f"WITH RECURSIVE {FLOWS}, {SOURCES}, {KILLS}, {DEPTH} SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM d GROUP BY node_id")
def _(spark, d):
    return solve.flow_reach(views.flows(spark, d, True), sources(spark, d), kills(spark, d))


@query("taint_sinks", f"WITH RECURSIVE {FLOWS}, {SOURCES}, {KILLS}, {DEPTH} SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM d WHERE node_id IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_acctbal < 2000) GROUP BY node_id")
def _(spark, d):
    return solve.taint_flows(reached(spark, d), sinks(spark, d), kills(spark, d))


@query("near_miss", f"WITH RECURSIVE {FLOWS}, {SOURCES}, {KILLS}, {REACH} SELECT node_id FROM r WHERE node_id IN (SELECT node_id FROM kills)")
def _(spark, d):
    return solve.near_misses(reached(spark, d), kills(spark, d)).select("node_id")


@query("flow_cache_batch", f"WITH RECURSIVE {FLOWS}, {SOURCES}, {KILLS}, {REACH} SELECT 'supplier' AS rule_id, node_id FROM r WHERE node_id LIKE 'S:%' UNION ALL SELECT 'part', node_id FROM r WHERE node_id LIKE 'P:%'")
def _(spark, d):
    # rules that share a policy share its run; each takes its own sinks
    r = reached(spark, d)
    return r.where("node_id like 'S:%'").select(F.lit("supplier").alias("rule_id"), "node_id").union(r.where("node_id like 'P:%'").select(F.lit("part").alias("rule_id"), "node_id"))


@query("kill_predicate", "SELECT 'O:' || o_orderkey AS node_id FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderpriority = '1-URGENT' OR o_orderkey % 5 = 0)")
def _(spark, d):
    o, k = views.table(spark, d, "orders"), F.col("o_orderkey")
    detail = F.create_map(F.lit("advisory"), F.when(k % 7 == 0, "true").otherwise("false"), F.lit("alphabet"), F.when(k % 5 == 0, "abc0123").otherwise(""))
    labels = o.select(views.ident("O", "o_orderkey").alias("node_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "clean").otherwise("other").alias("concept"), detail.alias("detail"))
    return solve.kill_nodes(labels, ["clean"], excluded="<>'")


@query("char_filter_proof", "SELECT event_id, NOT contains(event_type, 'e') AND NOT contains(event_type, 'z') AS bounded FROM events")
def _(spark, d):
    e = views.table(spark, d, "events")
    excluded = F.array(F.lit("e"), F.lit("z"))
    return e.select("event_id", S.sure(F.forall(excluded, lambda c: ~F.contains(F.col("event_type"), c))).alias("bounded"))


@query("witness_depth", f"WITH RECURSIVE {FLOWS}, {SOURCES}, {KILLS}, {DEPTH}, m AS (SELECT node_id, min(depth) AS depth FROM d GROUP BY node_id) SELECT t.node_id, min(p.node_id) AS parent FROM m t JOIN flows f ON f.dst = t.node_id JOIN m p ON p.node_id = f.src AND p.depth + 1 = t.depth AND p.node_id NOT IN (SELECT node_id FROM kills) WHERE t.node_id LIKE 'S:%' GROUP BY t.node_id")
def _(spark, d):
    # the round that finds a node names its smallest live predecessor
    found = solve.flow_reach(views.flows(spark, d, True), sources(spark, d), kills(spark, d), parents=True)
    return found.where("node_id like 'S:%' and parent is not null").select("node_id", "parent")


@query("witness_path", f"WITH RECURSIVE {FLOWS}, {SOURCES}, {KILLS}, {DEPTH}, w AS (SELECT f.dst AS node_id, min(f.src) AS parent FROM flows f JOIN d ON d.node_id = f.src WHERE f.dst LIKE 'S:%' AND f.src NOT IN (SELECT node_id FROM kills) GROUP BY f.dst) SELECT w.node_id, 'C:' || o_custkey || ' -> ' || parent || ' -> ' || w.node_id AS path FROM w JOIN orders ON parent = 'O:' || o_orderkey WHERE w.node_id IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_acctbal < 2000)")
def _(spark, d):
    live = materialize(reached(spark, d).join(kills(spark, d), "node_id", "left_anti"), "live")
    parents = materialize(solve.witness_parents(views.flows(spark, d, True), live), "parents")
    paths = solve.witness_paths(parents, solve.taint_flows(live, sinks(spark, d), kills(spark, d)))
    return paths.select("node_id", F.array_join("path", " -> ").alias("path"))


@query("hop_reach", f"WITH {NET}, n1 AS (SELECT 'R:' || r_regionkey AS source, n.dst AS node FROM region JOIN net n ON n.src = 'R:' || r_regionkey), n2 AS (SELECT source, n.dst AS node FROM n1 JOIN net n ON n.src = node), n3 AS (SELECT source, n.dst AS node FROM n2 JOIN net n ON n.src = node) SELECT source, node AS target, 3 AS depth FROM (SELECT DISTINCT * FROM n3 WHERE node LIKE 'P:%')")
def _(spark, d):
    regions = views.table(spark, d, "region").select(views.ident("R", "r_regionkey").alias("node_id"))
    parts = views.table(spark, d, "part").select(views.ident("P", "p_partkey").alias("node_id"))
    return solve.hop_reach(views.net(spark, d, True), regions, parts)


@query("hop_reach_protocols", f"WITH {NET}, t AS (SELECT * FROM net WHERE proto IN ('any', 'udp')), n1 AS (SELECT 'R:' || r_regionkey AS source, t.dst AS node FROM region JOIN t ON t.src = 'R:' || r_regionkey) SELECT DISTINCT source, t.dst AS target, 2 AS depth FROM n1 JOIN t ON t.src = node WHERE t.dst LIKE 'C:%'")
def _(spark, d):
    regions = views.table(spark, d, "region").select(views.ident("R", "r_regionkey").alias("node_id"))
    customers = views.table(spark, d, "customer").select(views.ident("C", "c_custkey").alias("node_id"))
    return solve.hop_reach(views.net(spark, d, True), regions, customers, ["udp"])


def vip(spark, d):
    return views.table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(views.ident("C", "c_custkey").alias("node_id"))


VIP = "vip AS (SELECT 'C:' || c_custkey AS node_id FROM customer WHERE c_mktsegment = 'MACHINERY')"


@query("grant_closure", f"WITH {STEPS}, {VIP}, o AS (SELECT DISTINCT node_id AS source, dst AS node FROM vip JOIN steps ON src = node_id), s AS (SELECT DISTINCT source, dst AS node FROM o JOIN steps ON src = node), n AS (SELECT DISTINCT source, dst AS node FROM s JOIN steps ON src = node WHERE node NOT IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_acctbal >= 5000)) SELECT source, node AS target, 2 AS depth FROM s WHERE node IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_acctbal >= 5000) UNION ALL SELECT source, node, 3 FROM n WHERE node IN ('N:1', 'N:2')")
def _(spark, d):
    named = spark.sql("select explode(array('N:1', 'N:2')) as node_id")
    rich = views.table(spark, d, "supplier").select(views.ident("S", "s_suppkey").alias("node_id"), F.when(F.col("s_acctbal") >= 5000, 3).otherwise(1).alias("rank"))
    return solve.grant_closure(views.steps(spark, d, True), vip(spark, d), named, rich, min_rank=3)


@query("can_access", f"WITH {STEPS}, {VIP}, o AS (SELECT DISTINCT node_id AS source, dst AS node FROM vip JOIN steps ON src = node_id) SELECT DISTINCT source, dst AS resource, 2 AS depth FROM o JOIN steps ON src = node WHERE ability = 'ship:R*' AND dst LIKE 'S:%'")
def _(spark, d):
    suppliers = views.table(spark, d, "supplier").select(views.ident("S", "s_suppkey").alias("node_id"))
    return solve.can_access(views.steps(spark, d, True), vip(spark, d), suppliers, "ship:Return")


@query("via_roles", f"WITH {STEPS}, {VIP} SELECT a.src AS source, b.dst AS resource, min(a.dst) AS via FROM vip JOIN steps a ON a.src = node_id JOIN steps b ON b.src = a.dst GROUP BY a.src, b.dst")
def _(spark, d):
    s = views.steps(spark, d)
    a, b = s.select(F.col("src").alias("source"), F.col("dst").alias("mid")), s.select(F.col("src").alias("mid"), F.col("dst").alias("resource"))
    paths = vip(spark, d).withColumnRenamed("node_id", "source").join(a, "source").join(b, "mid").withColumn("path", F.array("source", "mid", "resource"))
    return paths.groupBy("source", "resource").agg(F.min(solve.via_roles(F.col("path"))[0]).alias("via"))


@query("bfs_khop", f"WITH RECURSIVE {NET}, k(node_id, depth) AS (SELECT 'R:0', 0 UNION SELECT dst, depth + 1 FROM k JOIN net ON src = node_id WHERE depth < 2) SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM k GROUP BY node_id")
def _(spark, d):
    return solve.closure(views.net(spark, d, True), spark.sql("select 'R:0' as node_id"), max_depth=2)


CHAIN = "chain AS (SELECT 'E:' || event_id AS src, 'E:' || next AS dst FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events) WHERE next IS NOT NULL)"


@query("chain_reach", "SELECT 'E:' || event_id AS node_id FROM (SELECT event_id, bool_or(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS hit FROM events) WHERE hit")
def _(spark, d):
    """Reach along chains of events: a running window instead of one round for each link."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    e = views.table(spark, d, "events").withColumn("hit", F.max((F.col("event_type") == "signup").cast("int")).over(w))
    return e.where("hit = 1").select(views.ident("E", "event_id").alias("node_id"))


@query("trace_shortest", f"WITH RECURSIVE {FLOWS}, {VIP}, t(source, node_id, depth) AS (SELECT node_id, node_id, 0 FROM vip UNION SELECT source, dst, depth + 1 FROM t JOIN flows ON src = node_id WHERE depth < 4) SELECT source, CAST(min(depth) AS INTEGER) AS depth FROM t WHERE depth > 0 AND (node_id LIKE 'N:1%' OR node_id IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_acctbal < 2000)) GROUP BY source")
def _(spark, d):
    ends = views.table(spark, d, "nation").where("cast(n_nationkey as string) like '1%'").select(views.ident("N", "n_nationkey").alias("node_id")).union(sinks(spark, d))
    return solve.trace_shortest(views.flows(spark, d, True), vip(spark, d), ends)


@query("trace_frontier", f"WITH RECURSIVE {FLOWS}, {SOURCES}, {KILLS}, {DEPTH}, m AS (SELECT node_id, min(depth) AS depth FROM d GROUP BY node_id) SELECT node_id, CAST(depth AS INTEGER) AS depth FROM (SELECT * FROM m WHERE (node_id LIKE 'P:%') OR (depth > 0 AND node_id IN (SELECT node_id FROM kills)) ORDER BY depth, node_id LIMIT 12)")
def _(spark, d):
    parts = views.table(spark, d, "part").select(views.ident("P", "p_partkey").alias("node_id"))
    # the run's own edges and rounds: neither is shuffled to tell which nodes have no way on
    edges = dealt(views.flows(spark, d, True).select("src", "dst"), "src", "edges")
    return solve.trace_frontier(edges, solve.flow_reach(edges, sources(spark, d), kills(spark, d), written=True), kills(spark, d), parts)


@query("graph_taint_dump", f"WITH {FLOWS}, {VIP}, o AS (SELECT DISTINCT node_id AS source, dst FROM vip JOIN flows ON src = node_id) SELECT source, count(*) AS n_labelled FROM o WHERE dst IN (SELECT 'O:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY source")
def _(spark, d):
    r = solve.closure(views.flows(spark, d, True), vip(spark, d), by_source=True)
    return r.where("depth > 0").join(kills(spark, d), "node_id", "left_semi").groupBy("source").agg(F.count("*").alias("n_labelled"))


@query("concept_descendants", "WITH RECURSIVE parent AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 3 END AS p FROM nation), c(k, a) AS (SELECT k, k FROM parent UNION SELECT c.k, p.p FROM c JOIN parent p ON p.k = c.a WHERE p.p IS NOT NULL) SELECT 'k' || a AS ancestor, count(*) AS n FROM c GROUP BY a")
def _(spark, d):
    k = F.col("n_nationkey")
    parents = views.table(spark, d, "nation").select(F.concat(F.lit("k"), k.cast("string")).alias("node_id"), F.when(k > 0, F.concat(F.lit("k"), F.expr("(n_nationkey - 1) div 3").cast("string"))).alias("parent"))
    return solve.ancestors(parents).groupBy("ancestor").agg(F.count("*").alias("n"))


@query("cwe_ancestors", "WITH RECURSIVE parent AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS p FROM nation), c(k, a) AS (SELECT k, k FROM parent UNION SELECT c.k, p.p FROM c JOIN parent p ON p.k = c.a WHERE p.p IS NOT NULL) SELECT 'k' || k AS node_id, string_agg('k' || a, ',' ORDER BY a) AS ancestors FROM c WHERE a <> k GROUP BY k")
def _(spark, d):
    k = F.col("n_nationkey")
    parents = views.table(spark, d, "nation").select(F.concat(F.lit("k"), k.cast("string")).alias("node_id"), F.when(k > 0, F.concat(F.lit("k"), F.expr("n_nationkey div 2").cast("string"))).alias("parent"))
    a = solve.ancestors(parents).where("ancestor <> node_id").withColumn("n", F.substring("ancestor", 2, 9).cast("int"))
    return a.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "ancestor"))), lambda x: x["ancestor"]), ",").alias("ancestors"))


STEP_PATHS = """st AS (SELECT DISTINCT 'N:' || n_regionkey AS src, 'N:' || n_nationkey AS dst, 'reach' AS kind FROM nation WHERE n_regionkey <> n_nationkey
  UNION SELECT 'N:' || n_nationkey, 'N:' || ((n_nationkey * 7 + 3) % 25), 'grant' FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey <> (n_nationkey * 7 + 3) % 25),
p(head, path) AS (SELECT 'N:0', ['N:0'] UNION SELECT s.dst, list_append(path, s.dst) FROM p JOIN st s ON s.src = p.head WHERE NOT list_contains(path, s.dst) AND len(path) <= 5 AND head NOT IN ('N:20', 'N:21')),
paths AS (SELECT DISTINCT path FROM p WHERE head IN ('N:20', 'N:21') AND len(path) > 1)"""


def step_kinds(spark, d):
    n, k = views.table(spark, d, "nation"), F.col("n_nationkey")
    a = n.where("n_regionkey <> n_nationkey").select(views.ident("N", "n_regionkey").alias("src"), views.ident("N", "n_nationkey").alias("dst"), F.lit("reach").alias("kind"))
    b = n.where((k % 4 == 1) & (k != (k * 7 + 3) % 25)).select(views.ident("N", "n_nationkey").alias("src"), F.concat(F.lit("N:"), ((k * 7 + 3) % 25).cast("string")).alias("dst"), F.lit("grant").alias("kind"))
    return a.union(b).distinct()


def some_paths(spark, d):
    start, goal = spark.sql("select 'N:0' as node_id"), spark.sql("select explode(array('N:20', 'N:21')) as node_id")
    return solve.attack_paths(step_kinds(spark, d), start, goal, 5)


@query("attack_paths", f"WITH RECURSIVE {STEP_PATHS} SELECT array_to_string(path, '>') AS path FROM paths")
def _(spark, d):
    return some_paths(spark, d).select(F.array_join("path", ">").alias("path"))


@query("choke_points", f"WITH RECURSIVE {STEP_PATHS}, hop AS (SELECT DISTINCT path, path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM paths)), used AS (SELECT src, dst, count(*) AS n FROM hop GROUP BY ALL), kinds AS (SELECT src, dst, count(*) AS kinds FROM st GROUP BY ALL) SELECT src, dst, kind, n AS severed FROM st JOIN kinds USING (src, dst) JOIN used USING (src, dst) WHERE kinds = 1")
def _(spark, d):
    return solve.choke_points(materialize(some_paths(spark, d), "paths"), step_kinds(spark, d))


@query("solver_contract", f"WITH {STEPS}, {VIP} SELECT 'can_access' AS solver, 0::BIGINT AS violations")
def _(spark, d):
    """Every result names a source and a target and has a witness of one step or more."""
    suppliers = views.table(spark, d, "supplier").select(views.ident("S", "s_suppkey").alias("node_id"))
    r = solve.can_access(views.steps(spark, d, True), vip(spark, d), suppliers, "ship:Return")
    return r.agg(F.count(F.when((S.text("source") == "") | (S.text("resource") == "") | (F.col("depth") < 1), 1)).alias("violations")).select(F.lit("can_access").alias("solver"), "violations")


@query("flow_uncovered_middle", f"WITH {FLOWS} SELECT DISTINCT a.src AS source, b.dst AS sink FROM flows a JOIN flows b ON b.src = a.dst WHERE a.src LIKE 'C:%' AND b.dst LIKE 'S:%' AND a.dst NOT IN (SELECT 'O:' || o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    """Paths none of whose inner nodes is covered."""
    f = views.flows(spark, d)
    a, b = f.where("src like 'C:%'").select(F.col("src").alias("source"), F.col("dst").alias("mid")), f.where("dst like 'S:%'").select(F.col("src").alias("mid"), F.col("dst").alias("sink"))
    covered = views.table(spark, d, "orders").where("o_orderstatus = 'F'").select(views.ident("O", "o_orderkey").alias("mid"))
    return a.join(covered, "mid", "left_anti").join(b, "mid").select("source", "sink").distinct()


@query("context_reach", f"WITH {NET} SELECT 'O:' || o_orderkey AS node_id, string_agg(DISTINCT 'exposed by ' || src, ';' ORDER BY 'exposed by ' || src) AS context FROM orders JOIN net ON dst = 'C:' || o_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey")
def _(spark, d):
    o = views.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(views.ident("O", "o_orderkey").alias("node_id"), views.ident("C", "o_custkey").alias("dst"))
    net = views.net(spark, d).where("dst like 'C:%'").select("src", "dst")
    lines = o.join(net, "dst").groupBy("node_id").agg(F.array_sort(F.collect_set(S.render_label("exposed by {target}", "src", F.lit("")))).alias("c"))
    return lines.select("node_id", F.array_join("c", ";").alias("context"))


@query("context_asset", "SELECT 'O:' || l_orderkey AS node_id, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS kinds FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def _(spark, d):
    li = views.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return li.join(p, "l_partkey").groupBy(views.ident("O", "l_orderkey").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("kinds"))


@query("context_confirm", "SELECT 'C:' || c_custkey AS node_id, count(event_id) > 0 AS confirmed FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'error' GROUP BY c_custkey")
def _(spark, d):
    seen = views.table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    return views.table(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left").select(views.ident("C", "c_custkey").alias("node_id"), S.sure(F.col("seen")).alias("confirmed"))
