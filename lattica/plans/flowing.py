"""Queries on taint flows in code: ranked witnesses, guards on a flow, whole findings, many policies in one loop."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import report
from ..graph import Graph
from ..operators import flows, solve
from ..sources import views
from ..storage import dealt, materialize
from . import lang
from .catalog import CFG, FLOWS, STEPS, query
from .compile import Compiler
from .joins import DOMINATES
from .solving import vip

TEXT = """
module flow;
threat Delay;
concept audit { kind: source, taint: [Delay] }
concept outer { kind: source, refines: audit, taint: [Delay], source_condition: "{param} is set from outside", source_assumption: "callers are not trusted", source_confidence: medium }
concept candidate { kind: sink, vulnerable_to: [Delay] }
concept gate { kind: check, neutralizes: [Delay] }
concept clean { kind: check, neutralizes: [Delay] }

rule Leak { meta { id: "F-1", severity: high } taint audit -> candidate unless path coveredBy clean unless endpoint coveredBy gate }
"""
MODULE = lang.parse(TEXT)
RULES = {r.name: r for r in MODULE.rules}


def line_flows(spark, d):
    """src, dst: each call of an order flows to the next two."""
    w = Window.partitionBy("okey").orderBy("ord", "node_id")
    # dealt by order while they are narrow, which serves the distinct rows and the window
    rows = views.cfg_rows(spark, d).repartition("l_orderkey").distinct()
    c = views.cfg(spark, d, rows).select("node_id", F.array(F.lead("node_id", 1).over(w), F.lead("node_id", 2).over(w)).alias("next"))
    return c.select("node_id", F.explode("next").alias("dst")).where("dst is not null").select(F.lit("FLOWS").alias("edge_type"), F.col("node_id").alias("src"), "dst")


def code_labels(spark, d, rows=None):
    """Flag A is a source (``outer`` from line 5 on), R a sink, N a gate at even lines and, in every third order, clean."""
    plain = views.cfg_labels(spark, d, rows).where("concept <> 'check'").withColumn("line", F.split("node_id", ":")[2].cast("int"))
    plain = plain.withColumn("concept", F.when((F.col("concept") == "audit") & (F.col("line") >= 5), "outer").otherwise(F.col("concept"))).drop("line")
    n = views.cfg(spark, d, rows).where("flag = 'N'")
    detail = F.create_map(F.lit("coverage"), F.lit("endpoint"), F.lit("advisory"), F.when(F.col("okey") % 7 == 0, "true").otherwise("false"))
    of = lambda rows, concept, detail: rows.select("node_id", F.lit(concept).alias("concept"), F.lit("high").alias("confidence"), F.lit("semantic").alias("fidelity"), detail.alias("detail"))
    return plain.unionByName(of(n.where("ord % 2 = 0"), "gate", detail)).unionByName(of(n.where("okey % 3 = 0"), "clean", F.create_map().cast("map<string,string>")))


def code(spark, d) -> Graph:
    """Nodes and labels are made from narrow rows that are dealt by node once, and not shuffled again in joins by node."""
    rows = dealt(views.cfg_rows(spark, d).select(views.call_id().alias("node_id"), "*"), "node_id", "lines")
    nodes = views.cfg(spark, d, rows).drop("flag", "line", "okey").withColumn("props", F.create_map().cast("map<string,string>"))
    return Graph(nodes, line_flows(spark, d), code_labels(spark, d, rows))


LINES = f"""{CFG}, l AS (SELECT *, row_number() OVER (PARTITION BY okey ORDER BY ord, node_id) AS pos FROM cfg),
f AS (SELECT a.node_id AS src, b.node_id AS dst FROM l a JOIN l b ON a.okey = b.okey AND b.pos - a.pos IN (1, 2)),
k AS (SELECT node_id FROM l WHERE flag = 'N' AND okey % 3 = 0),
s AS (SELECT node_id, CASE fidelity WHEN 'semantic' THEN 3 ELSE 1 END AS rank FROM l WHERE flag = 'A'),
d(node_id, rank, depth) AS (SELECT node_id, rank, 0 FROM s UNION SELECT f.dst, d.rank, d.depth + 1 FROM d JOIN f ON f.src = d.node_id WHERE d.node_id NOT IN (SELECT node_id FROM k)),
m AS (SELECT node_id, rank, min(depth) AS depth FROM d JOIN (SELECT node_id, max(rank) AS rank FROM d GROUP BY node_id) USING (node_id, rank) GROUP BY ALL),
par AS (SELECT t.node_id, min(p.node_id) AS parent FROM m t JOIN f ON f.dst = t.node_id JOIN m p ON p.node_id = f.src AND p.rank = t.rank AND p.depth + 1 = t.depth WHERE p.node_id NOT IN (SELECT node_id FROM k) GROUP BY t.node_id),
w(sink, head, path) AS (SELECT node_id, node_id, [node_id] FROM m JOIN l USING (node_id) WHERE flag = 'R' UNION ALL SELECT sink, parent, list_prepend(parent, path) FROM w JOIN par ON par.node_id = head),
wit AS (SELECT sink, head AS source, path FROM w WHERE head NOT IN (SELECT node_id FROM par))"""
GUARDED = f"""{LINES}, g AS (SELECT * FROM l WHERE flag = 'N' AND ord % 2 = 0 AND NOT advisory),
pl AS (SELECT sink, i AS place, path[i] AS node_id, len(path) AS n FROM (SELECT sink, path, unnest(range(1, len(path) + 1)) AS i FROM wit)),
near AS (SELECT src AS node_id, dst AS guard FROM f UNION SELECT a.src, b.dst FROM f a JOIN f b ON b.src = a.dst),
covered AS (SELECT DISTINCT sink AS node_id FROM pl JOIN g USING (node_id) WHERE place < n
  UNION SELECT DISTINCT p.sink FROM pl p JOIN near USING (node_id) JOIN g ON g.node_id = guard JOIN pl q ON q.sink = p.sink AND q.place > p.place AND q.node_id <> guard JOIN l c ON c.node_id = q.node_id WHERE c.okey = g.okey AND {DOMINATES})"""


def leaks(spark, d):
    """The run of the rule's policy, and the graph."""
    g = code(spark, d)
    c = Compiler(g, lang.ontology(MODULE))
    c.prepare([RULES["Leak"]])
    return g, c


@query("witness_ranked", f"WITH RECURSIVE {LINES} SELECT sink AS node_id, array_to_string(path, ' -> ') AS path, CAST(rank AS INTEGER) AS rank FROM wit JOIN m ON m.node_id = sink")
def _(spark, d):
    """Paths of any length from the best source, which may be farther than another."""
    _, c = leaks(spark, d)
    runs, name = next(iter(c.runs.values()))
    return runs.witnesses(name, c.ids("candidate")).select("node_id", F.array_join("path", " -> ").alias("path"), "rank")


@query("guard_flow", f"WITH RECURSIVE {GUARDED} SELECT node_id FROM covered")
def _(spark, d):
    """Sinks whose witness passes a guard, or flows to one that dominates a later node of it."""
    g, c = leaks(spark, d)
    runs, name = next(iter(c.runs.values()))
    return flows.flow_guarded(runs.witnesses(name, c.ids("candidate")), runs.edges, g.nodes, c.guards("gate", "endpoint"))


_RANK = "CASE WHEN fidelity = 'syntactic' OR confidence = 'medium' THEN 2 ELSE 3 END"


@query(
    "taint_evidence",
    f"""WITH RECURSIVE {GUARDED}, miss AS (SELECT d.node_id, min(depth) AS depth FROM d JOIN k USING (node_id) GROUP BY d.node_id),
    said AS (SELECT CASE WHEN count(*) = 0 THEN 'none on any flow' ELSE count(*) || ' on other paths, the nearest at ' || (SELECT node_id FROM miss ORDER BY depth, node_id LIMIT 1) END AS said FROM miss)
    SELECT 'F-1' AS rule_id, wit.source, c.node_id, array_to_string(path, ' -> ') AS path, CASE least({_RANK.replace('fidelity', 'c.fidelity').replace('confidence', 'c.confidence')}, {_RANK.replace('fidelity', 'o.fidelity').replace('confidence', 'o.confidence')}, CASE WHEN o.ord >= 5 THEN 2 ELSE 3 END) WHEN 3 THEN 'high' ELSE 'medium' END AS confidence,
      'path coveredBy clean: ' || said || '; endpoint coveredBy gate: no control of this part covers it' AS evidence, CASE WHEN o.ord >= 5 THEN ' is set from outside' ELSE '' END AS review
    FROM wit JOIN l c ON c.node_id = wit.sink JOIN l o ON o.node_id = wit.source, said
    WHERE c.node_id NOT IN (SELECT node_id FROM covered) AND NOT EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND ({DOMINATES} OR (g.ord % 3 = 2 AND g.ord < c.ord AND (c.region = '/fn' || c.okey OR c.region = g.region))))""",
)
def _(spark, d):
    """Whole findings of a taint rule: source, path, confidence of both ends, what its exceptions found, what to review."""
    _, c = leaks(spark, d)
    rows = c.explain(RULES["Leak"])
    clauses = F.array_join(F.transform("evidence", lambda e: F.concat(e["clause"], F.lit(": "), e["detail"])), "; ")
    return rows.select("rule_id", "source", "node_id", F.array_join("path", " -> ").alias("path"), "confidence", clauses.alias("evidence"), F.coalesce(F.col("review")[0]["condition"], F.lit("")).alias("review"))


@query(
    "proof_tree",
    f"""WITH RECURSIVE {GUARDED}, miss AS (SELECT d.node_id, min(depth) AS depth FROM d JOIN k USING (node_id) GROUP BY d.node_id),
    said AS (SELECT CASE WHEN count(*) = 0 THEN 'none on any flow' ELSE count(*) || ' on other paths, the nearest at ' || (SELECT node_id FROM miss ORDER BY depth, node_id LIMIT 1) END AS said FROM miss),
    found AS (SELECT c.*, wit.source, path, o.ord AS o_ord, CASE least({_RANK.replace('fidelity', 'c.fidelity').replace('confidence', 'c.confidence')}, {_RANK.replace('fidelity', 'o.fidelity').replace('confidence', 'o.confidence')}, CASE WHEN o.ord >= 5 THEN 2 ELSE 3 END) WHEN 3 THEN 'high' ELSE 'medium' END AS conf, substr(sha256('rule=F-1|loc=' || c.loc || '|concept=candidate'), 1, 16) AS fp
      FROM wit JOIN l c ON c.node_id = wit.sink JOIN l o ON o.node_id = wit.source
      WHERE c.node_id NOT IN (SELECT node_id FROM covered) AND NOT EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND ({DOMINATES} OR (g.ord % 3 = 2 AND g.ord < c.ord AND (c.region = '/fn' || c.okey OR c.region = g.region)))))
    SELECT fp, '[HIGH] F-1  (conf=' || conf || ', fp=' || fp || ')' || chr(10) || '    source: ' || source || chr(10) || '    sink: ' || node_id || ' @ ' || loc || chr(10) || '    taint path: ' || array_to_string(path, ' -> ') || chr(10)
      || '    unless path coveredBy clean: not satisfied — ' || said || chr(10) || '    unless endpoint coveredBy gate: not satisfied — no control of this part covers it'
      || CASE WHEN o_ord >= 5 THEN chr(10) || '    review condition:  is set from outside — advisory: callers are not trusted — conf=medium' ELSE '' END AS text FROM found, said""",
)
def _(spark, d):
    """The text report of whole findings."""
    _, c = leaks(spark, d)
    return report.proof_tree(c.explain(RULES["Leak"]))


# ---- many policies

#: name: sources (a customer's segment, or all suppliers), kills (an order's priority or status, or none)
POLICIES = {"building": ("c_mktsegment = 'BUILDING'", "o_orderpriority = '1-URGENT'"), "machinery": ("c_mktsegment = 'MACHINERY'", "o_orderstatus = 'F'"), "all": ("true", "false")}


def _policy_sql(name: str, source: str, kill: str) -> str:
    return f"""SELECT '{name}' AS policy, node_id, CAST(min(depth) AS INTEGER) AS depth FROM (
      SELECT 'C:' || c_custkey AS node_id, 0 AS depth FROM customer WHERE {source}
      UNION ALL SELECT 'O:' || o_orderkey, 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE {source}
      UNION ALL SELECT f.dst, 2 FROM flows f JOIN orders ON f.src = 'O:' || o_orderkey JOIN customer ON o_custkey = c_custkey WHERE {source} AND NOT ({kill})
      UNION ALL SELECT n.dst, 3 FROM flows f JOIN orders ON f.src = 'O:' || o_orderkey JOIN customer ON o_custkey = c_custkey JOIN flows n ON n.src = f.dst WHERE {source} AND NOT ({kill})) GROUP BY node_id"""


@query("flow_policies", f"WITH {FLOWS} " + " UNION ALL ".join(_policy_sql(n, s, k) for n, (s, k) in POLICIES.items()))
def _(spark, d):
    """Three policies in one loop over the same edges."""
    t = lambda name, where, kind, key: views.table(spark, d, name).where(where).select(views.ident(kind, key).alias("node_id"))
    runs = flows.run(flows.written(views.flows(spark, d, True)), {n: (t("customer", s, "C", "c_custkey"), t("orders", k, "O", "o_orderkey")) for n, (s, k) in POLICIES.items()})
    out = None
    for n in POLICIES:
        one = runs.reached(n).select(F.lit(n).alias("policy"), "node_id", "depth")
        out = one if out is None else out.union(one)
    return out


@query("grant_chain", f"WITH {STEPS}, vip AS (SELECT 'C:' || c_custkey AS node_id FROM customer WHERE c_mktsegment = 'MACHINERY'), c AS (SELECT a.src AS source, z.dst AS resource, a.dst AS r1, b.dst AS r2 FROM vip JOIN steps a ON a.src = node_id JOIN steps b ON b.src = a.dst JOIN steps z ON z.src = b.dst WHERE z.dst LIKE 'N:%'), best AS (SELECT source, resource, min(r1) AS r1 FROM c GROUP BY ALL) SELECT source, resource, r1 || ',' || min(r2) AS via FROM c JOIN best USING (source, resource, r1) GROUP BY source, resource, r1")
def _(spark, d):
    """The roles between principals and nations that they come to, from both ends."""
    nations = views.table(spark, d, "nation").select(views.ident("N", "n_nationkey").alias("node_id"))
    chains = solve.grant_chains(views.steps(spark, d, True), vip(spark, d), nations, 4)
    return chains.select("source", "resource", F.array_join(solve.via_roles(F.col("path")), ",").alias("via"))


# ---- context


CONTEXT = lang.parse("""
module around;
concept Zone { kind: exposure, context_reach_source: true, context_reach_target_prop: customer, context_reach_label: "exposed" }
concept Vault { kind: asset, context_asset_target_prop: customer, context_asset_label: "{target} keeps [{kinds}]" }
concept Probe { kind: fact, context_confirm_dst_prop: customer, context_confirm_flag_prop: status, context_confirm_flag_value: F, context_confirm_label: "seen open" }
concept Buyer { kind: fact }
""")


@query(
    "finding_context",
    """WITH probe AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
    SELECT 'O:' || o_orderkey AS node_id, 'C:' || c_custkey || ' is exposed (via nation-customer)' || CASE WHEN c_custkey IN (SELECT k FROM probe) THEN ' — seen open' ELSE '' END
      || CASE WHEN c_acctbal >= 5000 AND c_mktsegment = 'BUILDING' THEN '; C:' || c_custkey || ' keeps [building gold]' WHEN c_acctbal >= 5000 THEN '; C:' || c_custkey || ' keeps [gold]' ELSE '' END AS context
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def _(spark, d):
    """Lines about the customers that urgent orders belong to: from where they are reached, what confirms it, what they hold."""
    nodes = views.nodes(spark, d)
    rich = (F.col("node_type") == "party.Customer") & (F.col("props")["balance"].cast("int") >= 5)
    kinds = F.when(rich & (F.col("props")["segment"] == "BUILDING"), "gold, building,gold").when(rich, "gold")
    nodes = nodes.withColumn("props", F.when(kinds.isNotNull(), F.map_concat("props", F.create_map(F.lit("asset_kinds"), kinds))).otherwise(F.col("props")))
    of = lambda where, concept: nodes.where(where).select("node_id", F.lit(concept).alias("concept"))
    labels = of("node_type = 'org.Region'", "Zone").union(of("node_type = 'party.Customer'", "Vault")).union(of("node_type = 'event.Order' and props['priority'] = '1-URGENT'", "Probe"))
    edges = views.net(spark, d).select("edge_type", "src", "dst", "rule")
    found = nodes.where("node_type = 'event.Order' and props['priority'] in ('1-URGENT', '2-HIGH')")
    lines = Compiler(Graph(nodes, edges, labels), lang.ontology(CONTEXT)).context(found)
    return lines.select("node_id", F.array_join("context", "; ").alias("context"))


@query("sarif_code_flows", f"WITH RECURSIVE {LINES} SELECT sink AS node_id, (SELECT string_agg(c.loc, ' > ' ORDER BY i) FROM (SELECT unnest(range(1, len(path) + 1)) AS i) JOIN l c ON c.node_id = path[i]) AS flow FROM wit WHERE len(path) > 1")
def _(spark, d):
    """Where the witness of each sink runs, read back from the SARIF results."""
    g, c = leaks(spark, d)
    runs, name = next(iter(c.runs.values()))
    w = runs.witnesses(name, c.ids("candidate")).select(F.col("node_id").alias("fp"), "path", F.lit("F-1").alias("rule_id"), F.lit("high").alias("severity"))
    w = w.join(g.nodes.select(F.col("node_id").alias("fp"), "loc"), "fp")
    results = report.sarif_results(report.path_locations(w, g.nodes))
    kind = "array<struct<location:struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>"
    steps = F.from_json(F.get_json_object("result", "$.codeFlows[0].threadFlows[0].locations"), kind)
    at = lambda x: F.concat(x["location"]["physicalLocation"]["artifactLocation"]["uri"], F.lit(":"), x["location"]["physicalLocation"]["region"]["startLine"].cast("string"))
    return results.select(F.col("fp").alias("node_id"), F.array_join(F.transform(steps, at), " > ").alias("flow")).where("flow is not null")
