"""Exceptions (``unless .. coveredBy``) as anti joins.

Candidates and guards are rows (node_id, region, ord, loc, scope, callee_path,
..); a guard counts if its label names the control, is not advisory and has
the coverage of the exception's part. Region predicates are joined on the
function's root, and ancestors of scopes are exploded, so every join has an
equality key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions as R
from ..functions import scalars as S
from ..storage import materialize

PARTS = ("path", "endpoint", "sameReceiver", "sameScope", "dominates", "postDominates", "global")


def guards(nodes: DataFrame, labels: DataFrame, control: str, part: str) -> DataFrame:
    """Nodes with a concrete label of the control for the part."""
    detail = lambda k: F.coalesce(F.element_at("detail", F.lit(k)), F.lit(""))
    concrete = labels.where((F.col("concept") == control) & (detail("advisory") != "true") & (detail("coverage") == part))
    return nodes.join(concrete.select("node_id").distinct(), "node_id", "left_semi")


def has_cfg(row: str = "region") -> Column:
    return S.text(row) != ""


def _g(guards: DataFrame) -> DataFrame:
    return guards.select(*(F.col(c).alias(f"g_{c}") for c in guards.columns))


def _rooted(candidates: DataFrame, guards: DataFrame, predicate: Column) -> Column:
    """Join condition: other node, same function root, predicate."""
    return (R.function_root(F.col("region")) == R.function_root(F.col("g_region"))) & (F.col("g_node_id") != F.col("node_id")) & predicate


def uncovered_dominates(candidates: DataFrame, guards: DataFrame) -> DataFrame:
    g = _g(guards.where(has_cfg()))
    rule = has_cfg() & R.dominates(F.col("g_region"), F.col("g_ord"), F.col("region"), F.col("ord"))
    return candidates.join(g, _rooted(candidates, g, rule), "left_anti")


def uncovered_post_dominates(candidates: DataFrame, guards: DataFrame) -> DataFrame:
    """A check that runs later on every path covers; where either side has no regions, any check does."""
    guards = materialize(guards.select("node_id", "region", "ord"), "guards")  # read three times
    bare = guards.where(~has_cfg()).select(F.col("node_id").alias("b_id"))
    some = guards.select(F.col("node_id").alias("b_id"))
    g = _g(guards.where(has_cfg()))
    rule = has_cfg() & R.post_dominates(F.col("g_region"), F.col("g_ord"), F.col("region"), F.col("ord"))
    left = candidates.join(g, _rooted(candidates, g, rule), "left_anti")
    # two ids are enough to know whether any other node than the candidate is a check
    two = lambda d: d.orderBy("b_id").limit(2)
    left = left.join(F.broadcast(two(bare)), F.col("b_id") != F.col("node_id"), "left_anti")
    return left.join(F.broadcast(two(some)), ~has_cfg() & (F.col("b_id") != F.col("node_id")), "left_anti")


def uncovered_same_scope(candidates: DataFrame, guards: DataFrame) -> DataFrame:
    """A guard's lexical scope equals the candidate's or one above it."""
    scopes = guards.select(S.lexical_scope_key("scope", "region").alias("scope_key")).where("scope_key <> ''").distinct()
    above = candidates.select("node_id", F.explode(S.scope_ancestors(S.lexical_scope_key("scope", "region"))).alias("scope_key"))
    return candidates.join(above.join(scopes, "scope_key", "left_semi").select("node_id").distinct(), "node_id", "left_anti")


def uncovered_same_receiver(candidates: DataFrame, guards: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """A guard on the candidate's receiver: a guard with the same receiver path, or the receiver node itself (``recv``) being one.

    ``targets`` (node_id), if given, are the only candidates that such a guard can cover.
    """
    receivers = guards.select(S.receiver_prefix("callee_path").alias("receiver")).where("receiver <> ''").distinct()
    covered = candidates.join(receivers, S.receiver_prefix("callee_path") == F.col("receiver"), "left_semi").select("node_id")
    if "recv" in candidates.columns:
        nodes = guards.select(F.col("node_id").alias("guard")).distinct()
        covered = covered.union(candidates.join(nodes, F.col("recv") == F.col("guard"), "left_semi").select("node_id"))
    if targets is not None:
        covered = covered.join(targets.select("node_id").distinct(), "node_id", "left_semi")
    return candidates.join(covered.distinct(), "node_id", "left_anti")


def uncovered_global(candidates: DataFrame, guards: DataFrame) -> DataFrame:
    """Any guard at all covers everything: one row decides."""
    return candidates.join(F.broadcast(guards.select("node_id").limit(1).select(F.lit(1).alias("one"))), F.lit(1) == F.col("one"), "left_anti")


def uncovered_endpoint(candidates: DataFrame, guards: DataFrame, edges: DataFrame) -> DataFrame:
    """Four ways to be covered: a PROTECTS or CHECKS edge (from a dominating guard where both have regions), a guard in the same function's context, a dominating guard, or a guard in a loop that precedes."""
    g = _g(guards)
    linked = edges.where(F.col("edge_type").isin("PROTECTS", "CHECKS")).select("src", "dst")
    by_edge = candidates.join(linked, F.col("dst") == F.col("node_id")).join(g, F.col("src") == F.col("g_node_id"))
    dominated = R.dominates(F.col("g_region"), F.col("g_ord"), F.col("region"), F.col("ord"))
    by_edge = by_edge.where(~(has_cfg() & has_cfg("g_region")) | dominated).select("node_id")
    context = g.where("g_callee_path = 'analysis.function.context'").select("g_node_id", S.function_scope_key("g_scope", "g_region").alias("g_fn")).where("g_fn <> ''")
    by_context = candidates.join(context, (S.function_scope_key("scope", "region") == F.col("g_fn")) & (F.col("g_node_id") != F.col("node_id"))).select("node_id")
    parent = S.nearest_loop_parent("g_region")
    loop = parent.isNotNull() & R.inside(S.text("region"), parent) & R.may_precede(F.col("g_region"), F.col("g_ord"), F.col("g_loc"), F.col("region"), F.col("ord"), F.col("loc"))
    with_cfg = g.where(has_cfg("g_region"))
    by_region = candidates.where(has_cfg()).join(with_cfg, _rooted(candidates, with_cfg, dominated | S.sure(loop))).select("node_id")
    return candidates.join(by_edge.union(by_context).union(by_region).distinct(), "node_id", "left_anti")


def order_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id): all pairs in which the first may run before the second.

    Regions are joined on the root of the outermost function of their chains of
    inline bodies; nodes without regions on their file.
    """
    key = lambda p: F.when(has_cfg(f"{p}_region"), R.function_root(F.col(f"{p}_region"))).otherwise(F.concat(F.lit("file:"), S.loc_file(f"{p}_loc")))
    x = a.select(*(F.col(c).alias(f"a_{c}") for c in ("node_id", "region", "ord", "loc")))
    y = b.select(*(F.col(c).alias(f"b_{c}") for c in ("node_id", "region", "ord", "loc")))
    rule = R.may_precede(F.col("a_region"), F.col("a_ord"), F.col("a_loc"), F.col("b_region"), F.col("b_ord"), F.col("b_loc"))
    return x.join(y, (key("a") == key("b")) & (F.col("a_node_id") != F.col("b_node_id")) & rule).select(F.col("a_node_id").alias("a_id"), F.col("b_node_id").alias("b_id"))


def evidence(clause: str, candidates: DataFrame, uncovered: DataFrame, detail: str = "") -> DataFrame:
    """(node_id, clause, satisfied, detail): what an exception found for each candidate."""
    open_ = uncovered.select("node_id", F.lit(True).alias("open"))
    return candidates.select("node_id").join(open_, "node_id", "left").select("node_id", F.lit(clause).alias("clause"), F.col("open").isNull().alias("satisfied"), F.lit(detail).alias("detail"))
