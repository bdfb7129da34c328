"""Queries on bindings: requirements of modules, selectors of all families, pruning, declared policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings, requirements
from ..sources import views
from . import bindings as B
from . import policies
from .catalog import CFG, query
from .ranking import F_SQL, order_findings

TEXT = """
binding urgent { emits hot requires { import("1-URGENT") } }
binding legacy { emits old requires { dependency("F", "<1.3") } }
binding risky  { emits risk confidence medium requires { project.has(hot) any(project.has(old), import("2-HIGH")) } }
binding calm   { emits quiet requires { language("building") not(project.has(risk)) } }
binding silent { emits still requires { project.has(quiet) not(any(import("5-LOW"), all(dependency("P"), import("3-MEDIUM")))) soft(import("4-NOT SPECIFIED")) soft(any(dependency("O", "==1.5"), dependency("F"))) } }
"""
BINDINGS = B.parse(TEXT)


def module_facts(spark, d):
    """Customers as modules: their segment is the language, their orders' priorities are imports, statuses dependencies with versions."""
    o, c = views.table(spark, d, "orders"), views.table(spark, d, "customer")
    none = F.lit("").alias("version")
    imports = o.select(views.ident("C", "o_custkey").alias("module"), F.lit("import").alias("kind"), F.col("o_orderpriority").alias("name"), none)
    depends = o.select(views.ident("C", "o_custkey").alias("module"), F.lit("dependency").alias("kind"), F.col("o_orderstatus").alias("name"), F.concat(F.lit("1."), (F.col("o_orderkey") % 10).cast("string")).alias("version"))
    return imports.union(depends).union(c.select(views.ident("C", "c_custkey").alias("module"), F.lit("language").alias("kind"), F.col("c_mktsegment").alias("name"), none)).distinct()


_FACTS = """o AS (SELECT o_custkey AS k, bool_or(o_orderpriority = '1-URGENT') AS hot, bool_or(o_orderpriority = '2-HIGH') AS high, bool_or(o_orderpriority = '3-MEDIUM') AS med, bool_or(o_orderpriority = '4-NOT SPECIFIED') AS unsaid, bool_or(o_orderpriority = '5-LOW') AS low,
  bool_or(o_orderstatus = 'F' AND o_orderkey % 10 < 3) AS old, bool_or(o_orderstatus = 'P') AS p, bool_or(o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 10 = 5)) AS fo FROM orders GROUP BY o_custkey),
f AS (SELECT 'C:' || coalesce(c_custkey, k) AS module, coalesce(hot, false) AS hot, coalesce(high, false) AS high, coalesce(med, false) AS med, coalesce(unsaid, false) AS unsaid, coalesce(low, false) AS low, coalesce(old, false) AS old, coalesce(p, false) AS p, coalesce(fo, false) AS fo, coalesce(c_mktsegment = 'BUILDING', false) AS building FROM o FULL JOIN customer ON k = c_custkey),
g AS (SELECT *, hot AND (old OR high) AS risk FROM f), q AS (SELECT *, building AND NOT risk AS quiet FROM g)"""


@query(
    "bind_requires",
    f"WITH {_FACTS} SELECT module, 'urgent' AS binding, 'hot' AS emits, 'high' AS confidence FROM q WHERE hot UNION ALL SELECT module, 'legacy', 'old', 'high' FROM q WHERE old UNION ALL SELECT module, 'risky', 'risk', 'medium' FROM q WHERE risk UNION ALL SELECT module, 'calm', 'quiet', 'high' FROM q WHERE quiet UNION ALL SELECT module, 'silent', 'still', CASE WHEN unsaid AND fo THEN 'high' ELSE 'medium' END FROM q WHERE quiet AND NOT low AND NOT (p AND med)",
)
def _(spark, d):
    return requirements.applicable(module_facts(spark, d), BINDINGS, B.strata(BINDINGS))


# ---- selectors of all families

SELECTORS = [
    ("call", "r", "any_r", "sink"), ("call", "m3.r", "m3_r", "candidate"), ("call", "svc.m4.r", "m4_r", "audit"), ("call", "m4.r", "m4_less", "sink"), ("call", "m4.n", "m4_n", "check"),
    ("param", "small", "size", "source"), ("param", "TIN.small", "tin", "asset"), ("memberAccess", "balance", "balance", "fact"), ("literal", "click", "clicks", "issue"), ("literal", "web.click", "never", "issue"),
]


def family_nodes(spark, d):
    """Calls of code, parts as parameters, suppliers as members, events as literals."""
    calls = views.cfg(spark, d).select("node_id", F.lit("call").alias("family"), F.col("callee_path").alias("path"))
    size = F.when(F.col("p_size") < 10, "small").otherwise("large")
    params = views.table(spark, d, "part").select(views.ident("P", "p_partkey").alias("node_id"), F.lit("param").alias("family"), F.concat_ws(".", "p_type", size).alias("path"))
    members = views.table(spark, d, "supplier").select(views.ident("S", "s_suppkey").alias("node_id"), F.lit("memberAccess").alias("family"), F.lit("account.balance").alias("path"))
    literals = views.table(spark, d, "events").select(views.ident("E", "event_id").alias("node_id"), F.lit("literal").alias("family"), F.col("event_type").alias("path"))
    return calls.union(params).union(members).union(literals)


@query(
    "bind_families",
    f"""WITH {CFG}, n AS (SELECT node_id, 'call' AS family, callee_path AS path FROM cfg UNION ALL SELECT 'P:' || p_partkey, 'param', p_type || '.' || CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END FROM part
      UNION ALL SELECT 'S:' || s_suppkey, 'memberAccess', 'account.balance' FROM supplier UNION ALL SELECT 'E:' || event_id, 'literal', event_type FROM events),
    s(family, selector, binding, concept) AS (VALUES {", ".join(str(x) for x in SELECTORS)}),
    m AS (SELECT node_id, binding, concept, rank() OVER (PARTITION BY node_id ORDER BY len(string_split(selector, '.')) DESC) AS place FROM n JOIN s ON n.family = s.family AND (path = selector OR ends_with(path, '.' || selector)))
    SELECT DISTINCT node_id, binding, concept FROM m WHERE place = 1""",
)
def _(spark, d):
    selectors = spark.createDataFrame(SELECTORS, "family string, selector string, binding string, concept string")
    return requirements.bind_selectors(family_nodes(spark, d), selectors)


# ---- policies

CORE = policies.parse(policies.CORE)


@query(
    "policy_priority",
    f"""WITH {F_SQL}, x AS (SELECT *, seq % 2 = 0 AS net, seq % 4 = 0 AS run, seq % 3 = 0 AS asset, seq % 5 = 0 AS exploit, seq % 7 = 0 AS near FROM f),
    t AS (SELECT seq, CASE p WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END + CASE WHEN net THEN 2 ELSE 0 END + CASE WHEN net AND run THEN 3 ELSE 0 END + CASE WHEN asset THEN 2 ELSE 0 END + CASE WHEN exploit THEN 1 ELSE 0 END - CASE WHEN near THEN 1 ELSE 0 END - CASE c WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS total,
      concat_ws(',', CASE WHEN net THEN 'exposure' END, CASE WHEN net AND run THEN 'runtimeExposure' END, CASE WHEN asset THEN 'assetProximity' END, CASE WHEN exploit THEN 'exploitLikelihood' END, CASE WHEN near THEN 'controlPressure' END, CASE WHEN c = 1 THEN 'confidenceLow' END, CASE WHEN c = 2 THEN 'confidenceMedium' END) AS factors FROM x)
    SELECT seq, CAST(total AS INTEGER) AS total, CASE WHEN total >= 8 THEN 'P0' WHEN total >= 6 THEN 'P1' WHEN total >= 4 THEN 'P2' WHEN total >= 2 THEN 'P3' ELSE 'P4' END AS band, factors FROM t""",
)
def _(spark, d):
    k = F.col("seq")
    context = F.struct((k % 2 == 0).alias("internetReachable"), (k % 4 == 0).alias("runtimeConfirmed"), (k % 3 == 0).alias("holdsAsset"))
    f = order_findings(spark, d).withColumn("context", context).withColumn("exploitSignal", k % 5 == 0).withColumn("nearMissControl", k % 7 == 0)
    return policies.prioritise(f, CORE["priority"]).select("seq", "total", "band", F.array_join("factors", ",").alias("factors"))


@query("policy_confidence", f"WITH {F_SQL} SELECT seq, CASE greatest(c - CASE witness_length WHEN 3 THEN 0 ELSE 1 END, 1) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, CASE witness_length WHEN 1 THEN 'uninspected evidence' WHEN 2 THEN 'conflicting evidence' ELSE '' END AS note FROM f")
def _(spark, d):
    state = F.element_at(F.array(*map(F.lit, ("missing", "unknown", "conflicting", "satisfied"))), F.col("witness_length") + 1)
    return policies.soften(order_findings(spark, d).withColumn("requirement_state", state), CORE["confidence"]).select("seq", "confidence", "note")


@query("confidence_unset", f"WITH {F_SQL} SELECT seq, CASE WHEN witness_length = 0 AND p % 2 = 1 THEN 2 WHEN witness_length = 0 THEN 3 WHEN p % 2 = 1 THEN least(c, 2) ELSE c END AS confidence_rank FROM f")
def _(spark, d):
    """A label without a confidence is as sure as its fidelity lets it be."""
    f = order_findings(spark, d)
    confidence = F.when(F.col("witness_length") > 0, F.col("confidence"))
    fidelity = F.when(F.col("severity").isin("critical", "medium", "info"), "syntactic").otherwise("semantic")
    return f.select("seq", findings.ceiling(confidence, fidelity).alias("confidence_rank"))
