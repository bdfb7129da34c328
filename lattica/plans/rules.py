"""Rules written in the rule language, over the graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import Graph
from ..sources import views
from ..storage import dealt
from . import lang
from .catalog import CFG, FLOWS, NET, STEPS, guards, query
from .compile import Compiler, needed_concepts, pruned
from .joins import DOMINATES

TEXT = """
module demo;
threat Delay;
concept candidate { kind: issue }
concept urgent { kind: issue, refines: candidate }
concept check { kind: check, neutralizes: [Delay] }
concept audit { kind: fact }
concept Buyer { kind: source, taint: [Delay] }
concept Blocked { kind: check, neutralizes: [Delay] }
concept Vendor { kind: sink, vulnerable_to: [Delay] }
concept Zone { kind: exposure }
concept Part { kind: asset }
concept User { kind: principal }
concept Rich { kind: privilege, grant_min_level: gold }

rule Issue { meta { id: "D-1", severity: high } issue candidate as c where c.callee_path ~= "m3" and not c.method == "n" unless dominates coveredBy check }
rule Fact { meta { id: "D-2" } fact audit as a where a.region contains "loop" }
rule Floor { meta { id: "D-3", severity: low } issue candidate with confidence >= high }
rule Scope { meta { id: "D-4", severity: low } issue candidate unless sameScope coveredBy check unless postDominates coveredBy check }
rule Taint { meta { id: "D-5", severity: critical } taint Buyer -> Vendor unless path coveredBy Blocked }
rule Reach { meta { id: "D-6", severity: high } reach Zone -> Part as p where holdsAssetKind(p, "PROMO", "SMALL") }
rule Grant { meta { id: "D-7", severity: high } grant User -> Rich }
rule Order { meta { id: "D-8" } query concept as a where a.concept == check reaches concept as b where b.concept == candidate select b }
rule Refs { meta { id: "D-9" } query concept as o where o.concept == Order references concept as u where u.concept == Buyer and u.id == o.customer select o }
rule Both { meta { id: "D-10" } query concept as c where c.concept == candidate labeledAs concept as d where d.concept == late select c }
rule Move { meta { id: "D-11" } query state as t where t.machine == chat and t.to == assistant select t }
rule Near { meta { id: "D-12" } issue Part as p where reach(Zone, p) and p.size >= 40 }
rule Can { meta { id: "D-13" } issue User as u where grant(u, Rich) }
rule After { meta { id: "D-14" } issue candidate as c where dominates(check, c) }
rule Semantic { meta { id: "D-15" } query principal as a where a.concept == Zone reaches asset as b where b.concept == Part select b }
"""
MODULE = lang.parse(TEXT)
RULES = {r.name: r for r in MODULE.rules}
ONTOLOGY = lang.ontology(MODULE)
LEVELS = {"bronze": 1, "silver": 2, "gold": 3}
CALLS = ("candidate", "check", "audit", "late")
KINDS = {c: ("code.Call",) for c in CALLS} | {"Zone": ("org.Region",), "Buyer": ("party.Customer",), "User": ("party.Customer",), "Vendor": ("party.Supplier",), "Part": ("asset.Part",), "Order": ("event.Order",), "Blocked": ("event.Order",)}


def graph(spark, d, calls: bool = False) -> Graph:
    """All views as one graph; transitions are the turns of conversations. ``calls``: calls are looked at, and dealt by node before."""
    rows = dealt(views.cfg_rows(spark, d).select(views.call_id().alias("node_id"), "*"), "node_id", "lines") if calls else None
    base = views.nodes(spark, d).withColumn("ord", F.lit(None).cast("int"))
    for c in ("region", "scope", "method", "callee_path"):
        base = base.withColumn(c, F.lit(""))
    level = F.when(F.col("props")["balance"].cast("int") >= 5, "gold").otherwise("bronze")
    extra = F.when(F.col("node_type") == "party.Supplier", F.create_map(F.lit("priv_level"), level)).when(F.col("node_type") == "asset.Part", F.create_map(F.lit("asset_kinds"), F.col("props")["kind"]))
    base = base.withColumn("props", F.map_concat("props", F.coalesce(extra, F.create_map().cast("map<string,string>"))))
    code = views.cfg(spark, d, rows).drop("flag", "line", "okey").withColumn("props", F.create_map().cast("map<string,string>"))
    turns = views.table(spark, d, "conversations")
    state = turns.select(F.concat_ws(":", F.lit("T"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node_id"), F.lit("analysis.Transition").alias("node_type"), F.lit("").alias("loc"), F.create_map(F.lit("machine"), F.lit("chat"), F.lit("to"), F.col("role")).alias("props"))
    nodes = base.unionByName(code).unionByName(state, allowMissingColumns=True)
    kind = F.create_map(*(F.lit(x) for kv in {"org.Region": "Zone", "party.Customer": "Buyer", "party.Supplier": "Vendor", "asset.Part": "Part", "event.Order": "Order"}.items() for x in kv))
    typed = base.select("node_id", kind[F.col("node_type")].alias("concept")).where("concept is not null")
    users = base.where("node_type = 'party.Customer' and props['segment'] = 'MACHINERY'").select("node_id", F.lit("User").alias("concept"))
    blocked = base.where("node_type = 'event.Order' and props['priority'] = '1-URGENT'").select("node_id", F.lit("Blocked").alias("concept"))
    late = views.cfg(spark, d, rows).where("ord >= 4").select("node_id", F.lit("late").alias("concept"))
    plain = typed.union(users).union(blocked).union(late).select("*", F.lit("high").alias("confidence"), F.lit("semantic").alias("fidelity"), F.create_map().cast("map<string,string>").alias("detail"))
    edges = views.net(spark, d, True).select("edge_type", "src", "dst", "proto").unionByName(views.steps(spark, d, True), allowMissingColumns=True).unionByName(views.flows(spark, d, True), allowMissingColumns=True)
    return Graph(nodes, edges, views.cfg_labels(spark, d, rows).unionByName(plain), KINDS)


def findings_of(name: str):
    def run(spark, d):
        calls = not needed_concepts([RULES[name]], ONTOLOGY).isdisjoint(CALLS)
        return Compiler(pruned(graph(spark, d, calls), [RULES[name]], ONTOLOGY), ONTOLOGY, LEVELS).compile(RULES[name]).select("rule_id", "source", "node_id", "confidence", "fp")

    return run


CONF = "CASE WHEN fidelity = 'syntactic' THEN 'medium' ELSE confidence END"


def _sql(rule: str, concept: str, rows: str, source: str = "NULL::VARCHAR", confidence: str = "'high'", loc: str = "loc") -> str:
    return f"SELECT DISTINCT '{rule}' AS rule_id, {source} AS source, node_id, {confidence} AS confidence, substr(sha256('rule={rule}|loc=' || {loc} || '|concept={concept}'), 1, 16) AS fp FROM ({rows})"


query("rule_issue", f"WITH {CFG}, {guards('dominates')} " + _sql("D-1", "candidate", f"SELECT * FROM cfg c WHERE concept = 'candidate' AND okey % 50 = 3 AND NOT EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND {DOMINATES})", confidence=CONF))(findings_of("Issue"))
query("rule_fact", f"WITH {CFG} " + _sql("D-2", "audit", "SELECT * FROM cfg WHERE concept = 'audit' AND contains(region, 'loop')", confidence=CONF))(findings_of("Fact"))
query("clause_with_confidence", f"WITH {CFG} " + _sql("D-3", "candidate", "SELECT * FROM cfg WHERE concept = 'candidate' AND confidence = 'high' AND fidelity <> 'syntactic'"))(findings_of("Floor"))
query("rule_two_exceptions", f"WITH {CFG}, {guards('sameScope')}, p AS (SELECT * FROM cfg WHERE concept = 'check' AND NOT advisory AND coverage = 'postDominates') " + _sql("D-4", "candidate", "SELECT * FROM cfg c WHERE concept = 'candidate' AND NOT EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND (c.region = g.region OR starts_with(c.region, g.region || '/'))) AND NOT EXISTS (SELECT 1 FROM p WHERE p.okey = c.okey AND (c.region = p.region OR starts_with(c.region, p.region || '/')) AND p.ord > c.ord)", confidence=CONF))(findings_of("Scope"))
_TAINT = "o AS (SELECT dst AS node_id, min(src) AS parent FROM flows WHERE dst LIKE 'S:%' AND src NOT IN (SELECT 'O:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY dst)"
query("rule_taint", f"WITH {FLOWS}, {_TAINT} " + _sql("D-5", "Vendor", "SELECT node_id, 'party.Supplier:' || substr(node_id, 3) AS loc, 'C:' || o_custkey AS source FROM o JOIN orders ON parent = 'O:' || o_orderkey", source="source"))(findings_of("Taint"))
_R3 = "n1 AS (SELECT 'R:' || r_regionkey AS source, n.dst AS node FROM region JOIN net n ON n.src = 'R:' || r_regionkey), n2 AS (SELECT source, n.dst AS node FROM n1 JOIN net n ON n.src = node), n3 AS (SELECT DISTINCT source, n.dst AS node_id, 'asset.Part:' || substr(n.dst, 3) AS loc, CAST(substr(n.dst, 3) AS BIGINT) AS k FROM n2 JOIN net n ON n.src = node WHERE n.dst LIKE 'P:%')"
query("rule_reach", f"WITH {NET}, {_R3} " + _sql("D-6", "Part", "SELECT n3.* FROM n3 JOIN part ON p_partkey = k WHERE p_type IN ('PROMO', 'SMALL')", source="source"))(findings_of("Reach"))
query("rule_grant", f"WITH {STEPS}, o AS (SELECT DISTINCT 'C:' || c_custkey AS source, dst AS node FROM customer JOIN steps ON src = 'C:' || c_custkey WHERE c_mktsegment = 'MACHINERY') " + _sql("D-7", "Rich", "SELECT source, dst AS node_id, 'party.Supplier:' || substr(dst, 3) AS loc FROM o JOIN steps ON src = node WHERE dst IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_acctbal >= 5000)", source="source"))(findings_of("Grant"))
query("rule_order", f"WITH {CFG} " + _sql("D-8", "", "SELECT * FROM cfg b WHERE concept = 'candidate' AND EXISTS (SELECT 1 FROM cfg a WHERE a.concept = 'check' AND a.okey = b.okey AND a.ord < b.ord AND (a.region = b.region OR starts_with(a.region, b.region || '/') OR starts_with(b.region, a.region || '/')))"))(findings_of("Order"))
query("rule_references", _sql("D-9", "", "SELECT 'O:' || o_orderkey AS node_id, 'event.Order:' || o_orderkey AS loc FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"))(findings_of("Refs"))
query("rule_labeledAs", f"WITH {CFG} " + _sql("D-10", "", "SELECT * FROM cfg WHERE concept = 'candidate' AND ord >= 4"))(findings_of("Both"))
query("rule_transition", _sql("D-11", "", "SELECT 'T:' || conv_id || ':' || turn AS node_id, '' AS loc FROM conversations WHERE role = 'assistant'"))(findings_of("Move"))
query("solver_call_reach", f"WITH {NET}, {_R3} " + _sql("D-12", "Part", "SELECT n3.* FROM n3 JOIN part ON p_partkey = k WHERE p_size >= 40"))(findings_of("Near"))
query("solver_call_grant", f"WITH {STEPS}, o AS (SELECT DISTINCT c_custkey, dst AS node FROM customer JOIN steps ON src = 'C:' || c_custkey WHERE c_mktsegment = 'MACHINERY') " + _sql("D-13", "User", "SELECT DISTINCT 'C:' || c_custkey AS node_id, 'party.Customer:' || c_custkey AS loc FROM o JOIN steps ON src = node WHERE dst IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_acctbal >= 5000)"))(findings_of("Can"))
query("solver_call_dominates", f"WITH {CFG}, g AS (SELECT * FROM cfg WHERE concept = 'check') " + _sql("D-14", "candidate", f"SELECT * FROM cfg c WHERE concept = 'candidate' AND EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND {DOMINATES})", confidence=CONF))(findings_of("After"))
query("rule_reach_semantic", f"WITH {NET}, {_R3} " + _sql("D-15", "", "SELECT * FROM n3"))(findings_of("Semantic"))
