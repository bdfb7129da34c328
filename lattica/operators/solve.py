"""Recursive operators as frontier loops over DataFrames.

Every loop joins the frontier with narrow edges (src, dst, ..), removes what
was visited, and writes the round's rows to the shared folder, so that plans
stay flat and a lost executor costs one round. Reach is keyed by node (or by
source and node), never by path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import action_matches
from ..storage import Growing, bucketed, dealt, materialize
from .flows import witness_paths


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame, seeds: DataFrame, stop: DataFrame | None = None, max_depth: int | None = None, by_source: bool = False, stop_seeds: bool = True, parents: bool = False, written: bool = False) -> DataFrame:
    """(node_id, depth), or (source, node_id, depth), of all nodes reached; seeds have depth 0.

    ``edges``: src, dst. Nodes in ``stop`` (node_id) are reached but not passed
    through; with stop_seeds False that does not hold for seeds themselves.
    With parents there is also the smallest node one step before (null for
    seeds): the round that finds a node has all of them, so that no node is
    joined with the edges that lead to it. Edges that are ``written`` come from
    storage.dealt, by src, and are not written again; others may repeat. Rounds
    are written in buckets of the node (of source and node, so that one node
    with very many sources is not one task), so that what is visited is not
    shuffled again; ``stop`` is made once.
    """
    key = ["source", "node_id"] if by_source else ["node_id"]
    start = seeds.select(*((F.col("node_id").alias("source"),) if by_source else ()), "node_id").distinct().withColumn("depth", F.lit(0))
    if parents:
        start = start.withColumn("parent", F.lit(None).cast("string"))
    whole = Growing(start, key, "reach")
    edges = edges if written else dealt(edges.select("src", "dst"), "src", "edges")
    halted = bucketed(stop.select("node_id").distinct(), "node_id", "stop") if stop is not None else None
    depth = 0
    while max_depth is None or depth < max_depth:
        seen = whole.table()
        frontier = seen.where(F.col("depth") == depth)
        if halted is not None and (depth or stop_seeds):
            frontier = frontier.join(halted, "node_id", "left_anti")
        depth += 1
        steps = frontier.join(edges, frontier.node_id == edges.src).select(*((F.col("source"),) if by_source else ()), F.col("dst").alias("node_id"), F.col("src").alias("parent"))
        found = steps.groupBy(*key).agg(F.min("parent").alias("parent")) if parents else steps.select(*key).distinct()
        whole.add(found.join(seen.select(*key), key, "left_anti").select(*key, F.lit(depth).alias("depth"), *(("parent",) if parents else ())))
        if whole.table().where(F.col("depth") == depth).isEmpty():
            break
    return whole.table()


def flow_reach(edges: DataFrame, sources: DataFrame, kills: DataFrame, parents: bool = False, written: bool = False) -> DataFrame:
    """Multi-source reach over flows. A kill node is reached, not passed, also where it is a source itself."""
    return closure(edges, sources, kills, parents=parents, written=written)


def taint_flows(reached: DataFrame, sinks: DataFrame, kills: DataFrame) -> DataFrame:
    """One row for each tainted sink that is no kill: node_id, depth."""
    return reached.join(sinks.select("node_id").distinct(), "node_id", "left_semi").join(kills.select("node_id"), "node_id", "left_anti")


def near_misses(reached: DataFrame, kills: DataFrame) -> DataFrame:
    """The kill nodes that a run reached."""
    return reached.join(kills.select("node_id").distinct(), "node_id", "left_semi")


def kill_nodes(labels: DataFrame, concepts: list[str], excluded: str = "") -> DataFrame:
    """Nodes whose label is not advisory and either carries a kill concept or proves that no excluded character passes.

    The proof: the label's output alphabet holds none of the characters, or the
    characters that it removes are all of them.
    """
    detail = lambda k: F.coalesce(F.element_at("detail", F.lit(k)), F.lit(""))
    chars = F.array(*(F.lit(c) for c in excluded)).cast("array<string>")
    bounded = (detail("alphabet") != "") & F.forall(chars, lambda c: F.instr(detail("alphabet"), c) == 0) if excluded else F.lit(False)
    removed = (detail("removed") != "") & F.forall(chars, lambda c: F.instr(detail("removed"), c) > 0) if excluded else F.lit(False)
    return labels.where((detail("advisory") != "true") & (F.col("concept").isin(*concepts) | bounded | removed)).select("node_id").distinct()


def witness_parents(edges: DataFrame, reached: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(node_id, parent): of the predecessors one level nearer to a source the one of the highest rank, then the smallest id.

    ``ranks``: node_id, rank (of the best source behind a node). The nearest
    sources come first here; flows.Runs has the witnesses of the best sources.
    """
    near = reached.select(F.col("node_id").alias("parent"), F.col("depth").alias("above"))
    if ranks is not None:
        near = near.join(ranks.withColumnRenamed("node_id", "parent"), "parent", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    else:
        near = near.withColumn("rank", F.lit(0))
    steps = edges.select("src", "dst").join(near, F.col("src") == F.col("parent")).join(reached, F.col("dst") == F.col("node_id")).where("depth = above + 1")
    return steps.groupBy("node_id").agg(F.min(F.struct((-F.col("rank")).alias("r"), F.col("parent").alias("p"))).alias("best")).select("node_id", F.col("best.p").alias("parent"))


def hop_reach(edges: DataFrame, sources: DataFrame, targets: DataFrame, protocols: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(source, target, depth): targets at one hop or more; the search does not pass through a target. ``edges``: src, dst, proto."""
    if protocols:
        edges = edges.where(F.col("proto").isin("any", *protocols))
    targets = materialize(targets.select("node_id").distinct(), "targets")
    reached = closure(edges, sources, targets, max_depth, by_source=True, stop_seeds=False)
    return reached.where("depth > 0").join(targets, "node_id", "left_semi").select("source", F.col("node_id").alias("target"), "depth")


def grant_closure(steps: DataFrame, sources: DataFrame, targets: DataFrame, levels: DataFrame | None = None, min_rank: int = 0, max_depth: int | None = None) -> DataFrame:
    """(source, target, depth) over escalation steps. A target is named, or holds a privilege of the rank or above (``levels``: node_id, rank)."""
    if levels is not None and min_rank > 0:
        targets = targets.select("node_id").union(levels.where(F.col("rank") >= min_rank).select("node_id")).distinct()
    return hop_reach(steps, sources, targets, None, max_depth)


def can_access(steps: DataFrame, principals: DataFrame, resources: DataFrame, action: str, max_depth: int | None = None) -> DataFrame:
    """(source, resource, depth): the last step's ability covers the action. The search goes on through resources. ``steps``: src, dst, ability."""
    # dealt once with what the last step needs; a step of several abilities is met more than once and found once
    steps = dealt(steps.select("src", "dst", action_matches(F.col("ability"), F.lit(action)).alias("fits")), "src", "edges")
    reached = closure(steps, principals, None, max_depth, by_source=True, written=True)
    last = steps.where("fits").select("src", "dst")
    if max_depth is not None:
        reached = reached.where(F.col("depth") < max_depth)
    hit = reached.join(last, F.col("node_id") == F.col("src")).join(resources.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi")
    return hit.groupBy("source", F.col("dst").alias("resource")).agg((F.min("depth") + 1).alias("depth"))


def via_roles(path: Column) -> Column:
    """The nodes between the ends of a grant chain."""
    return F.slice(path, F.lit(2), F.greatest(F.size(path) - 2, F.lit(0)))


def on_the_way(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int) -> DataFrame:
    """src, dst of the edges that are on a way of up to max_depth steps from a start to an end."""
    edges = dealt(edges.select("src", "dst"), "src", "edges")
    near = closure(edges, starts, max_depth=max_depth - 1, written=True).select(F.col("node_id").alias("src"), F.col("depth").alias("above"))
    ahead = materialize(edges.join(near, "src"), "ahead")
    back = closure(ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends, max_depth=max_depth - 1)
    left = back.select(F.col("node_id").alias("dst"), F.col("depth").alias("left"))
    return materialize(ahead.join(left, "dst").where(F.col("above") + F.col("left") < max_depth).select("src", "dst"), "steps")


def _ways(edges: DataFrame, starts: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """By start: (source, node_id, depth) within max_depth, and (source, node_id, parent) of the smallest node before each."""
    reached = closure(edges, starts, None, max_depth, by_source=True, parents=True)
    return reached.drop("parent"), reached.where("parent is not null").select("source", "node_id", "parent")


def _ways_to(parents: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, node_id, path) from the source to each of the ends (source, node_id)."""
    key = lambda node: F.struct(F.col("source").alias("source"), F.col(node).alias("node"))
    paths = witness_paths(parents.select(key("node_id").alias("node_id"), key("parent").alias("parent")), ends.select(key("node_id").alias("node_id")))
    return paths.select("node_id.source", F.col("node_id.node").alias("node_id"), F.transform("path", lambda p: p["node"]).alias("path"))


def grant_chains(steps: DataFrame, principals: DataFrame, resources: DataFrame, max_depth: int) -> DataFrame:
    """(source, resource, path): a shortest chain of up to max_depth steps of every pair that has one, with the smallest node in its middle.

    Forward from the principals and backward from the resources, half the
    steps each, and joined where they meet, so that neither side holds all
    that the other one reaches. Steps that are on no chain of that length are
    taken out first, by each node's distance from the nearest ends. Chains of
    no step are left out.
    """
    steps = on_the_way(steps, principals, resources, max_depth)
    ahead, up = _ways(steps, principals, -(-max_depth // 2))
    back, down = _ways(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")), resources, max_depth // 2)
    back = back.select(F.col("source").alias("resource"), F.col("node_id").alias("mid"), F.col("depth").alias("rest"))
    met = ahead.join(back, F.col("node_id") == F.col("mid")).where("source <> resource")
    met = materialize(met.groupBy("source", "resource").agg(F.min(F.struct((F.col("depth") + F.col("rest")).alias("n"), F.abs(F.col("depth") - F.col("rest")).alias("skew"), "mid")).alias("m")).select("source", "resource", "m.mid"), "met")
    first = _ways_to(materialize(up, "up"), met.select("source", F.col("mid").alias("node_id")).distinct()).select(F.col("source").alias("s"), F.col("node_id").alias("m1"), F.col("path").alias("first"))
    last = _ways_to(materialize(down, "down"), met.select(F.col("resource").alias("source"), F.col("mid").alias("node_id")).distinct()).select(F.col("source").alias("t"), F.col("node_id").alias("m2"), F.col("path").alias("last"))
    both = met.join(first, (F.col("source") == F.col("s")) & (F.col("mid") == F.col("m1"))).join(last, (F.col("resource") == F.col("t")) & (F.col("mid") == F.col("m2")))
    return both.select("source", "resource", F.concat("first", F.slice(F.reverse("last"), F.lit(2), F.size("last"))).alias("path"))


def trace_shortest(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, depth): steps from each source to the nearest sink other than itself."""
    reached = closure(edges, sources, None, max_depth, by_source=True).where("depth > 0 and node_id <> source")
    return reached.join(sinks.select("node_id").distinct(), "node_id", "left_semi").groupBy("source").agg(F.min("depth").alias("depth"))


def trace_frontier(edges: DataFrame, reached: DataFrame, labelled: DataFrame, calls: DataFrame, limit: int = 12) -> DataFrame:
    """Where a flow stops: reached calls without outgoing flows, and labelled nodes; the first ``limit`` by depth and id."""
    ends = reached.join(edges.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti").join(calls.select("node_id"), "node_id", "left_semi")
    stops = reached.where("depth > 0").join(labelled.select("node_id").distinct(), "node_id", "left_semi")
    return ends.unionByName(stops).distinct().orderBy("depth", "node_id").limit(limit)


def ancestors(parents: DataFrame) -> DataFrame:
    """(node_id, ancestor), each node being its own; ``parents``: node_id, parent."""
    edges = parents.where("parent is not null").select(F.col("node_id").alias("src"), F.col("parent").alias("dst"))
    return closure(edges, parents, by_source=True).select(F.col("source").alias("node_id"), F.col("node_id").alias("ancestor"))


# ---- attack paths


def attack_paths(steps: DataFrame, starts: DataFrame, targets: DataFrame, max_hops: int) -> DataFrame:
    """(path,): node sequences without repeats from a start to a target, where they stop. ``steps``: src, dst.

    Steps back from the targets say how near each node is; a path goes on only
    to nodes from which a target is within the hops left.
    """
    moves = materialize(steps.select("src", "dst").distinct(), "steps")
    near = closure(moves.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets, max_depth=max_hops)
    moves = materialize(moves.join(near.select(F.col("node_id").alias("dst"), F.col("depth").alias("left")), "dst"), "steps")
    goal = targets.select(F.col("node_id").alias("goal")).distinct()
    paths = materialize(starts.select(F.col("node_id").alias("head"), F.array("node_id").alias("path")).distinct(), "paths")
    done = []
    for hop in range(1, max_hops + 1):
        grown = paths.join(moves.where(F.col("left") <= max_hops - hop), F.col("head") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("head"), F.array_append("path", F.col("dst")).alias("path"))
        grown = materialize(grown.join(goal, F.col("head") == F.col("goal"), "left"), "paths")
        if grown.isEmpty():
            break
        done.append(grown.where("goal is not null").select("path"))
        paths = grown.where("goal is null").select("head", "path")
    return _union(done).distinct() if done else paths.select("path").limit(0)


def choke_points(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """(src, dst, kind, severed): how many paths vanish with a step, of the steps with which any does. Parallel steps of another kind keep a path alive."""
    kinds = steps.select("src", "dst", "kind").distinct()
    single = kinds.groupBy("src", "dst").agg(F.count("*").alias("kinds")).where("kinds = 1")
    hops = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    used = paths.where(F.size("path") > 1).select("path", F.explode(hops).alias("hop")).groupBy("hop.src", "hop.dst").agg(F.countDistinct("path").alias("n"))
    out = kinds.join(single, ["src", "dst"]).join(used, ["src", "dst"])
    return out.select("src", "dst", "kind", F.col("n").cast("long").alias("severed"))
