"""Code frontend, patterns and the code map."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import report
from ..functions import patterns
from ..graph import Graph
from ..operators import bind, solve
from ..sources import pyast, views
from ..storage import materialize
from .catalog import query


def modules(spark, d):
    """A small module for each supplier: the value of a parameter goes to a call, cleaned or not."""
    s, k = views.table(spark, d, "supplier"), F.col("s_suppkey")
    clean = F.when(k % 2 == 0, "shlex.quote(x)").otherwise("x.strip()")
    body = F.concat(F.lit("import os, shlex\n\ndef run"), k.cast("string"), F.lit("(x):\n    y = "), clean, F.lit("\n    if y:\n        os.system(y)\n    return y\n\nrun"), k.cast("string"), F.lit("(input('cmd'))\n"))
    return s.select(F.concat(F.lit("pkg/m"), k.cast("string"), F.lit(".py")).alias("path"), body.alias("content"))


@query("code_frontend", "SELECT 'pkg.m' || s_suppkey AS module, callee_path, n FROM supplier, LATERAL (VALUES ('os.system', 1), (CASE WHEN s_suppkey % 2 = 0 THEN 'shlex.quote' ELSE 'x.strip' END, 1), ('input', 1), ('pkg.m' || s_suppkey || '.run' || s_suppkey, 1)) v(callee_path, n)")
def _(spark, d):
    nodes, _ = pyast.extract(modules(spark, d))
    return nodes.where("node_type = 'code.Call'").groupBy("module", "callee_path").agg(F.count("*").cast("int").alias("n"))


@query("import_nodes", "SELECT 'pkg.m' || s_suppkey AS module, package FROM supplier, (VALUES ('os'), ('shlex')) v(package)")
def _(spark, d):
    nodes, _ = pyast.extract(modules(spark, d))
    return nodes.where("node_type = 'code.Import'").select("module", F.element_at("props", F.lit("package")).alias("package"))


@query("code_taint", "SELECT 'pkg.m' || s_suppkey AS module FROM supplier WHERE s_suppkey % 2 = 1")
def _(spark, d):
    """From source text to findings: input() reaches os.system() unless shlex.quote() lies between."""
    nodes, edges = (materialize(x, "code") for x in pyast.extract(modules(spark, d)))
    calls = nodes.where("node_type = 'code.Call'")
    pick = lambda p: bind.bind_by_path(calls, p, "k")
    kills = pick("shlex.quote")
    hit = solve.taint_flows(solve.flow_reach(Graph(nodes, edges, None).out_edges("FLOWS"), pick("input"), kills), pick("os.system"), kills)
    return nodes.join(hit, "node_id", "left_semi").select("module")


@query("regex_ambiguous", "SELECT p_partkey, p_partkey % 4 < 2 AS slow FROM part")
def _(spark, d):
    texts = F.array(*map(F.lit, (r"^(a+)+$", r"(\wx|a\w)*z", r"^[a-z]+\d+$", r"(?:ab)*c")))
    p = views.table(spark, d, "part").select("p_partkey", F.element_at(texts, (F.col("p_partkey") % 4 + 1).cast("int")).alias("pattern"))
    judged = p.select("pattern").distinct().select("pattern", patterns.ambiguous_column(F.col("pattern")).alias("slow"))
    return p.join(judged, "pattern").select("p_partkey", "slow")


@query("char_class_expand", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '0123456789' WHEN 1 THEN 'abc' ELSE '' END AS chars FROM part")
def _(spark, d):
    texts = F.array(*map(F.lit, (r"\d", "[a-c]", "[")))
    p = views.table(spark, d, "part").select("p_partkey", F.element_at(texts, (F.col("p_partkey") % 3 + 1).cast("int")).alias("pattern"))
    found = p.select("pattern").distinct().select("pattern", patterns.class_chars_column(F.col("pattern")).alias("chars"))
    return p.join(found, "pattern").select("p_partkey", "chars")


@query("sink_graph_json")
def _(spark, d):
    nodes, edges = (materialize(x, "code") for x in pyast.extract(modules(spark, d)))
    fn = F.element_at("props", F.lit("fn"))
    of = lambda t: nodes.where(F.col("node_type").isin(*t)).select("node_id", fn.alias("fn"))
    calls = bind.call_edges(of(["code.Arg", "code.Call"]), of(["code.Param"]), of(["code.Return"]), edges)
    none = nodes.limit(0).select(F.lit("").alias("fp"), F.lit("").alias("rule_id"), F.array(fn).alias("fns"))
    return report.graph_json(nodes.where("node_type = 'code.Function'").select(fn.alias("fn"), "loc"), calls, none)
