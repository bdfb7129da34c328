"""A line language for small graphs, and JSON triage files.

node <id> <type> [{ k = v, ... }]      a node, labelled with its type; the properties are the label's details too
label <id> <concept> [{ k = v, ... }]
edge <TYPE> <src> -> <dst> [{ ... }]
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph

_LINE = re.compile(r"^(node|label)\s+(\S+)\s+(\S+)\s*(\{.*\})?$|^edge\s+(\S+)\s+(\S+)\s*->\s*(\S+?)\s*(\{.*\})?$")


def _pairs(text: str | None) -> dict[str, str]:
    out = {}
    for item in (text or "{}").strip()[1:-1].split(","):
        key, eq, value = item.partition("=")
        if eq:
            out[key.strip()] = value.strip()
    return out


def parse(text: str) -> tuple[list, list, list]:
    nodes, edges, labels = [], [], []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        m = _LINE.match(line)
        if not m:
            raise ValueError(f"line {number}: {raw!r}")
        if m[1]:
            props = _pairs(m[4])
            if m[1] == "node":
                order = props.get("order", "")
                nodes.append((m[2], m[3], props.get("loc", m[2]), props.get("region", ""), int(order) if re.fullmatch(r"-?\d+", order) else None, props.get("scope", ""), props.get("method", ""), props.get("callee_path", ""), [], [], props))
            labels.append((m[2], m[3], "dsl", props.get("fidelity", "semantic"), props.get("confidence", "high"), props, number))
        else:
            edges.append((m[5], m[6], m[7], _pairs(m[8]), number))
    return nodes, edges, labels


def load(spark: SparkSession, text: str) -> Graph:
    nodes, edges, labels = parse(text)
    return Graph(spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame(edges, schema.EDGES), spark.createDataFrame(labels, schema.LABELS))


def write_baseline(findings: DataFrame, path: str, verdict: str = "accepted", reason: str = "") -> None:
    """One JSON object for each fingerprint."""
    findings.select(F.lit(1).alias("version"), "fp", F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"), "rule_id").dropDuplicates(["fp"]).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version int, fp string, verdict string, reason string, rule_id string").json(path)
