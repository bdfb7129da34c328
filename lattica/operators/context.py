"""What the graph says around a finding: whether what it points to is exposed, confirmed, or holds assets.

Concepts declare it: the property by which a finding names its target, and how
a line reads. All targets of all findings are looked up together: one reach
from each kind of exposed nodes, one join for the labels of targets, one for
nodes that confirm them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import materialize
from .solve import closure


@dataclass(frozen=True)
class Exposure:
    """Targets that nodes of these concepts reach over one hop or more."""

    concepts: tuple[str, ...]
    target_prop: str
    label: str


@dataclass(frozen=True)
class Confirmation:
    """Nodes of these concepts name the target in ``dst_prop``; if ``flag_prop`` is given it has to have the value."""

    concepts: tuple[str, ...]
    dst_prop: str
    label: str
    flag_prop: str = ""
    flag_value: str = ""


@dataclass(frozen=True)
class Holding:
    """Targets of these concepts that hold kinds of assets; the label has {target} and {kinds}."""

    concepts: tuple[str, ...]
    target_prop: str
    label: str = "{target} holds [{kinds}]"


def _with(labels: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    return labels.where(F.col("concept").isin(*concepts)).select("node_id").distinct()


def exposed(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, via): targets (target) reached from a source over one hop or more, and the rule of a shortest way's last hop (the smallest). ``edges``: src, dst, rule."""
    reached = closure(edges, sources)
    last = edges.join(reached, F.col("src") == F.col("node_id")).select("dst", "depth", S.text("rule").alias("rule"))
    last = last.join(targets.select(F.col("target").alias("t")).distinct(), F.col("dst") == F.col("t"), "left_semi")
    return last.groupBy(F.col("dst").alias("target")).agg(F.min(F.struct("depth", "rule"))["rule"].alias("via"))


def confirmed(nodes: DataFrame, labels: DataFrame, specs: list[Confirmation]) -> DataFrame:
    """(target, said): the labels of all confirmations of a target, in the order of the specs, each once."""
    parts = []
    for i, c in enumerate(specs):
        rows = nodes.join(_with(labels, c.concepts), "node_id", "left_semi")
        if c.flag_prop:
            rows = rows.where(S.prop(c.flag_prop) == c.flag_value)
        parts.append(rows.select(S.prop(c.dst_prop).alias("target"), F.lit(i).alias("i"), F.lit(c.label).alias("label")).where("target <> ''").distinct())
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("target").agg(F.transform(F.sort_array(F.collect_set(F.struct("i", "label"))), lambda x: x["label"]).alias("said"))


def enrich(findings: DataFrame, nodes: DataFrame, labels: DataFrame, edges: DataFrame, exposures: list[Exposure], confirmations: list[Confirmation], holdings: list[Holding]) -> DataFrame:
    """(node_id, context): the lines of each finding that has any; exposures first, then assets, each in the order of the specs.

    ``findings``: node_id; their nodes' properties name the targets. A target
    that is no node says nothing. A target's context is the same for all
    findings that name it, and is made once.
    """
    own = nodes.join(findings.select("node_id").distinct(), "node_id", "left_semi")
    props = sorted({x.target_prop for x in [*exposures, *holdings]})
    if not props:
        return findings.select("node_id", F.array().cast("array<string>").alias("context")).limit(0)
    named = own.select("node_id", F.explode(F.array(*(F.struct(F.lit(p).alias("prop"), S.prop(p).alias("target")) for p in props))).alias("n")).select("node_id", "n.*").where("target <> ''")
    named = materialize(named.join(nodes.select(F.col("node_id").alias("t")).distinct(), F.col("target") == F.col("t"), "left_semi"), "targets")
    targets = materialize(named.select("prop", "target").distinct(), "distinct-targets")
    lines = []
    for i, x in enumerate(exposures):
        hit = exposed(edges, _with(labels, x.concepts), targets.where(F.col("prop") == x.target_prop))
        line = F.concat("target", F.lit(f" is {x.label} (via "), "via", F.lit(")"))
        if confirmations:
            said = confirmed(nodes, labels, confirmations).withColumnRenamed("target", "c_target")
            hit = hit.join(said, F.col("target") == F.col("c_target"), "left")
            line = F.concat(line, F.array_join(F.transform(F.coalesce("said", F.array().cast("array<string>")), lambda s: F.concat(F.lit(" — "), s)), ""))
        lines.append(hit.select(F.lit(x.target_prop).alias("prop"), "target", F.lit(i).alias("place"), line.alias("line")))
    for i, x in enumerate(holdings):
        mine = targets.where(F.col("prop") == x.target_prop).join(_with(labels, x.concepts).withColumnRenamed("node_id", "t"), F.col("target") == F.col("t"), "left_semi")
        kinds = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(S.prop("asset_kinds"), ","), lambda k: F.trim(k)), lambda k: k != "")))
        of = nodes.select(F.col("node_id").alias("t"), kinds.alias("kinds"))
        mine = mine.join(of, F.col("target") == F.col("t")).where(F.size("kinds") > 0)
        lines.append(mine.select("prop", "target", F.lit(len(exposures) + i).alias("place"), S.render_label(x.label, "target", F.array_join("kinds", " ")).alias("line")))
    said = materialize(reduce(DataFrame.unionByName, lines), "context")
    met = named.join(said.withColumnsRenamed({"prop": "p", "target": "t"}), (F.col("prop") == F.col("p")) & (F.col("target") == F.col("t")))
    return met.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("place", "line"))), lambda x: x["line"]).alias("context"))
