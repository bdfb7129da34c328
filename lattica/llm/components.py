"""Connected components of a graph given by its links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: No input needs so many; a guard against a loop that doesn't end.
MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (columns a, b); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows these
    pointers by repeated doubling, and contracts the links to the roots; at
    least half of the linked nodes vanish in a round. No group is gathered:
    minima are partial aggregates, and the joins' larger side can be split
    where a root is hot. Tables of each round are written to the shared
    folder. Links with a null end and links of a node to itself are dropped.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    links = materialize(links.union(links.select("b", "a")).distinct(), "links")
    roots = None
    for _ in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        hooks = links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
        hooks = materialize(hooks, "hooks")
        while True:
            up = hooks.select(F.col("node").alias("up"), F.col("root").alias("top"))
            jumped = materialize(hooks.join(up, hooks.root == up.up).select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "jumps")
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        up = hooks.select(F.col("node").alias("up"), F.col("root").alias("top"))
        if roots is None:
            roots = hooks
        else:
            roots = materialize(roots.join(up, roots.root == up.up, "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        a = up.select(F.col("up").alias("ua"), F.col("top").alias("ta"))
        b = up.select(F.col("up").alias("ub"), F.col("top").alias("tb"))
        links = links.join(a, F.col("a") == F.col("ua")).join(b, F.col("b") == F.col("ub"))
        links = materialize(links.where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
