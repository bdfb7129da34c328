"""Taint flows of many policies in one frontier loop, their witnesses, and guards on the witness.

A policy is a set of sources with ranks and a set of kill nodes. Beside each
node stands a bit mask: for every policy one bit for each rank, which says that
a live flow from a source of that rank or a better one reaches the node. A
round joins the frontier with the edges once for all policies, merges masks by
``bit_or``, takes off what the node's kills stop and what it had before, and
writes what is new, in buckets of the node as the edges are, so that a round
shuffles only what it finds. So the depth at which the highest bit of a node came is the
least depth from its best sources, however long the way; a better source wins
over a nearer one.

The edges are written once for a graph and serve all runs on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions as R
from ..functions import scalars as S
from ..storage import Growing, bucketed, dealt, materialize

#: Ranks of a source are 0 to RANKS - 1; policies of a mask column (62 bits at most are used).
RANKS, POLICIES = 4, 15


def written(edges: DataFrame) -> DataFrame:
    """src, dst: distinct, dealt by src and written, for any number of runs."""
    return dealt(edges.select("src", "dst"), "src", "edges")


@dataclass(frozen=True)
class Runs:
    """What all policies reached. ``bits``: node_id, depth, m0, m1, .. with the bits that are new at that depth."""

    edges: DataFrame
    bits: DataFrame
    stops: DataFrame
    names: tuple[str, ...]
    max_depth: int | None = None

    def _at(self, policy: str) -> tuple[str, int]:
        i = self.names.index(policy)
        return f"m{i // POLICIES}", RANKS * (i % POLICIES)

    def _nibble(self, policy: str, column: str = "") -> Column:
        name, shift = self._at(policy)
        return F.shiftright(column or name, shift).bitwiseAND((1 << RANKS) - 1)

    def reached(self, policy: str) -> DataFrame:
        """(node_id, depth) of all nodes that a live flow reaches, at the least depth; kill nodes are reached, not passed."""
        return self.bits.where(self._nibble(policy) != 0).groupBy("node_id").agg(F.min("depth").alias("depth"))

    def best(self, policy: str) -> DataFrame:
        """(node_id, rank, depth): the rank of the best source of each node, and the least depth from such a source."""
        n = self._nibble(policy)
        rank = sum(((n >= 1 << r).cast("int") for r in range(1, RANKS)), F.lit(0))
        top = self.bits.where(n != 0).groupBy("node_id").agg(F.max(F.struct(rank.alias("rank"), (-F.col("depth")).alias("d"))).alias("b"))
        return top.select("node_id", F.col("b.rank").alias("rank"), (-F.col("b.d")).alias("depth"))

    def stopped(self, policy: str) -> DataFrame:
        """(node_id,) of the policy's kill nodes."""
        name, shift = self._at(policy)
        return self.stops.where(F.shiftright(f"s_{name}", shift).bitwiseAND((1 << RANKS) - 1) != 0).select(F.col("stop_id").alias("node_id"))

    def near_misses(self, policy: str) -> DataFrame:
        """(node_id, depth) of the kill nodes that the policy's flows reached."""
        return self.reached(policy).join(self.stopped(policy), "node_id", "left_semi")

    def tainted(self, policy: str, sinks: DataFrame) -> DataFrame:
        """(node_id, rank, depth) of the sinks that a live flow reaches and that are no kill nodes."""
        return self.best(policy).join(sinks.select("node_id").distinct(), "node_id", "left_semi").join(self.stopped(policy), "node_id", "left_anti")

    def parents(self, policy: str) -> DataFrame:
        """(node_id, parent): on the way from the best source, of the nodes before it the smallest id.

        A node's best source is that of a live node before it, of the highest
        rank, then of the least depth; so one grouping by the node finds it.
        """
        best = bucketed(self.best(policy), "node_id", "best")
        before = best.join(self.stopped(policy), "node_id", "left_anti")
        if self.max_depth is not None:
            before = before.where(F.col("depth") < self.max_depth)
        steps = self.edges.join(before, F.col("src") == F.col("node_id")).select("dst", F.struct((-F.col("rank")).alias("r"), F.col("depth").alias("d"), F.col("src").alias("p")).alias("step"))
        first = steps.groupBy("dst").agg(F.min("step").alias("first"))
        found = first.join(best.where("depth > 0"), F.col("dst") == F.col("node_id"))
        # compared as differences, so that they don't become keys of the join, by which both sides would be shuffled
        return found.where("rank + first.r = 0 and depth - first.d = 1").select("node_id", F.col("first.p").alias("parent"))

    def witnesses(self, policy: str, sinks: DataFrame) -> DataFrame:
        """(node_id, path, rank) of each tainted sink: from the best source to the sink."""
        hit = materialize(self.tainted(policy, sinks), "tainted")
        paths = witness_paths(materialize(self.parents(policy), "parents"), hit)
        return paths.join(hit.select("node_id", "rank"), "node_id")


def run(edges: DataFrame, policies: dict[str, tuple[DataFrame, DataFrame]], max_depth: int | None = None) -> Runs:
    """One loop for all policies. ``edges``: as from written(); a policy: sources (node_id and, if they differ, rank), kills (node_id)."""
    if not policies:
        raise ValueError("no policy")
    columns = [f"m{k}" for k in range(-(-len(policies) // POLICIES))]

    def mask(i: int, bits: Column) -> list[Column]:
        return [(F.shiftleft(bits, RANKS * (i % POLICIES)) if k == i // POLICIES else F.lit(0).cast("long")).alias(c) for k, c in enumerate(columns)]

    starts = stops = None
    for i, (sources, kills) in enumerate(policies.values()):
        rank = F.least(F.coalesce("rank", F.lit(0)), F.lit(RANKS - 1)).cast("int") if "rank" in sources.columns else F.lit(0)
        nested = sum((F.when(rank >= r, 1 << r).otherwise(0) for r in range(RANKS)), F.lit(0)).cast("long")
        a = sources.select("node_id", *mask(i, nested))
        b = kills.select("node_id", *mask(i, F.lit((1 << RANKS) - 1).cast("long")))
        starts, stops = (a, b) if starts is None else (starts.union(a), stops.union(b))
    merged = [F.bit_or(c).alias(c) for c in columns]
    stops = bucketed(stops.groupBy(F.col("node_id").alias("stop_id")).agg(*(F.bit_or(c).alias(f"s_{c}") for c in columns)), "stop_id", "kills")
    any_new = lambda: F.greatest(*(F.col(c) != 0 for c in columns)) if len(columns) > 1 else F.col(columns[0]) != 0
    bits = Growing(starts.groupBy("node_id").agg(*merged).select("node_id", F.lit(0).alias("depth"), *columns), "node_id", "flow")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        seen = bits.table()
        live = seen.where(F.col("depth") == depth - 1).join(stops, F.col("node_id") == F.col("stop_id"), "left")
        live = live.select("node_id", *(F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(f"s_{c}", F.lit(0)))).alias(c) for c in columns)).where(any_new())
        found = live.join(edges, F.col("node_id") == F.col("src")).groupBy(F.col("dst").alias("node_id")).agg(*merged)
        known = seen.groupBy(F.col("node_id").alias("known_id")).agg(*(F.bit_or(c).alias(f"k_{c}") for c in columns))
        new = found.join(known, F.col("node_id") == F.col("known_id"), "left")
        new = new.select("node_id", F.lit(depth).alias("depth"), *(F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(f"k_{c}", F.lit(0)))).alias(c) for c in columns)).where(any_new())
        bits.add(new)
        if bits.table().where(F.col("depth") == depth).isEmpty():
            break
    return Runs(edges, bits.table(), stops, tuple(policies), max_depth)


# ---- witness paths


def witness_paths(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """(node_id, path) from the root above each target to the target, of any length, by doubling.

    Ancestors at distances 1, 2, 4, .. are joins of the table with itself;
    from the largest distance down, what is known of a path finds as much again
    (each distance is one sum of powers of two). Parents must not form a circle.
    """
    jumps = [materialize(parents.select("node_id", F.col("parent").alias("up")), "jumps")]
    while True:
        low, high = jumps[-1].withColumnRenamed("up", "mid"), jumps[-1].select(F.col("node_id").alias("m"), "up")
        longer = materialize(low.join(high, F.col("mid") == F.col("m")).select("node_id", "up"), "jumps")
        if longer.isEmpty():
            break
        jumps.append(longer)
    known = targets.select("node_id").distinct().select("node_id", F.col("node_id").alias("at"), F.lit(0).alias("distance"))
    for k in reversed(range(len(jumps))):
        known = materialize(known, "paths") if k < len(jumps) - 1 else known
        hop = jumps[k].select(F.col("node_id").alias("from"), "up")
        known = known.unionByName(known.join(hop, F.col("at") == F.col("from")).select("node_id", F.col("up").alias("at"), (F.col("distance") + (1 << k)).alias("distance")))
    return known.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "at"))), lambda x: x["at"]).alias("path"))


# ---- guards on a witness


def flow_guarded(witnesses: DataFrame, edges: DataFrame, nodes: DataFrame, guards: DataFrame) -> DataFrame:
    """(node_id,) of the sinks whose witness a guard covers.

    That is so if a node before the sink is a guard itself; or if a guard that
    a node of the path flows to, directly or over one node, dominates a later
    node of the path. ``witnesses``: node_id, path; ``nodes``: node_id, region,
    ord; ``guards``: rows of nodes. Only places of paths are joined with edges.
    """
    places = materialize(witnesses.select(F.col("node_id").alias("sink"), F.posexplode("path").alias("at", "node_id"), F.size("path").alias("n")), "places")
    ids = guards.select("node_id").distinct()
    inner = places.where("at < n - 1").join(ids, "node_id", "left_semi").select("sink")
    regions = guards.where(S.text("region") != "").select(F.col("node_id").alias("guard"), F.col("region").alias("g_region"), F.col("ord").alias("g_ord"))
    one = edges.join(regions.select("guard"), F.col("dst") == F.col("guard")).select(F.col("src").alias("near"), "guard")
    two = edges.join(one, F.col("dst") == F.col("near")).select(F.col("src").alias("near"), "guard")
    near = one.union(two).where("near <> guard").distinct()
    met = places.join(near, F.col("node_id") == F.col("near")).groupBy("sink", "guard").agg(F.min("at").alias("since")).join(regions, "guard")
    met = met.withColumnRenamed("sink", "g_sink")
    later = places.join(nodes.where(S.text("region") != "").select("node_id", "region", "ord"), "node_id")
    rule = (F.col("sink") == F.col("g_sink")) & (R.function_root(F.col("region")) == R.function_root(F.col("g_region"))) & (F.col("at") > F.col("since")) & (F.col("node_id") != F.col("guard"))
    outer = later.join(met, rule & R.dominates(F.col("g_region"), F.col("g_ord"), F.col("region"), F.col("ord"))).select("sink")
    return inner.union(outer).distinct().withColumnRenamed("sink", "node_id")
