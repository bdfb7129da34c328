"""Findings as JSON lines, SARIF and text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S


def finding_json(findings: DataFrame) -> DataFrame:
    """(fp, json), by fingerprint."""
    return findings.select("fp", F.to_json(F.struct(*sorted(findings.columns))).alias("json")).orderBy("fp")


API_VERSION = 1


def api_json(findings: DataFrame) -> DataFrame:
    """(fp, json): each finding with all its columns, nested ones included, in a versioned envelope."""
    return findings.select("fp", F.to_json(F.struct(F.lit(API_VERSION).alias("version"), F.struct(*sorted(findings.columns)).alias("finding"))).alias("json"))


def validate_api(text: str) -> list[str]:
    """What an envelope lacks; empty if it is sound."""
    doc = json.loads(text)
    wrong = [] if doc.get("version") == API_VERSION else [f"version {doc.get('version')}"]
    return wrong + [f"no {k}" for k in ("rule_id", "severity", "confidence", "fp") if not doc.get("finding", {}).get(k)]


def path_locations(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """The findings with path_locs: where each node of their path stands; a node without a place is its id."""
    steps = findings.select("fp", F.posexplode("path").alias("at", "node_id"))
    steps = steps.join(nodes.select("node_id", F.coalesce(F.nullif(S.text("loc"), F.lit("")), F.col("node_id")).alias("place")), "node_id", "left")
    locs = steps.groupBy(F.col("fp").alias("p_fp")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("place", "node_id").alias("place")))), lambda x: x["place"]).alias("path_locs"))
    return findings.join(locs, F.col("fp") == F.col("p_fp"), "left").drop("p_fp")


def _physical(loc) -> Column:
    uri = F.coalesce(F.nullif(S.loc_file(loc), F.lit("")), loc if isinstance(loc, Column) else F.col(loc))
    return F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(S.loc_line(loc).alias("startLine")).alias("region"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object for each finding (rule_id, severity, fp, loc); with path_locs its path is a code flow."""
    place = F.struct(F.struct(F.struct(S.loc_file("loc").alias("uri")).alias("artifactLocation"), F.struct(S.loc_line("loc").alias("startLine")).alias("region")).alias("physicalLocation"))
    flows = []
    if "path_locs" in findings.columns:
        steps = F.transform("path_locs", lambda p: F.struct(F.struct(_physical(p).alias("physicalLocation")).alias("location")))
        flows = [F.when(F.size("path_locs") > 1, F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows")))).alias("codeFlows")]
    result = F.struct(*flows, F.col("rule_id").alias("ruleId"), S.severity_level("severity").alias("level"), F.struct(F.concat(F.lit("finding of "), "rule_id").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fp").alias("primary/v1")).alias("partialFingerprints"))
    return findings.select("fp", "rule_id", "severity", F.to_json(result).alias("result"))


def sarif(findings: DataFrame, tool: str = "lattica") -> DataFrame:
    """One row: the SARIF 2.1.0 document of a bounded report. For large results write sarif_results() as lines."""
    r = sarif_results(findings)
    rules = r.groupBy("rule_id").agg(F.max("severity").alias("severity")).agg(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), F.struct(S.security_severity("severity").alias("security-severity")).alias("properties")))).alias("rules"))
    results = r.agg(F.array_sort(F.collect_list(F.struct("fp", "result"))).alias("results"))
    body = F.concat(
        F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":'), F.lit(json.dumps(tool)), F.lit(',"rules":'), F.to_json("rules"),
        F.lit('}},"results":['), F.array_join(F.transform("results", lambda x: x["result"]), ","), F.lit("]}]}"),
    )
    return results.crossJoin(F.broadcast(rules)).select(body.alias("sarif"))  # one row each


def sarif_lines(findings: DataFrame, tool: str = "lattica") -> DataFrame:
    """(place, line): the same document of any size as lines in order of place, to be written one after another.

    The head has one entry for each rule; each result is a row of its own, made where its finding lies.
    """
    r = sarif_results(findings)
    rules = r.groupBy("rule_id").agg(F.max("severity").alias("severity")).agg(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), F.struct(S.security_severity("severity").alias("security-severity")).alias("properties")))).alias("rules"))
    begin = F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":'), F.lit(json.dumps(tool)), F.lit(',"rules":'), F.to_json("rules"), F.lit('}},"results":['))
    head = rules.select(F.lit("").alias("place"), begin.alias("line"))
    first = r.agg(F.min("fp").alias("first"))
    body = r.crossJoin(F.broadcast(first)).select(F.concat(F.lit("r"), "fp").alias("place"), F.concat(F.when(F.col("fp") == F.col("first"), "").otherwise(","), "result").alias("line"))  # one row
    tail = rules.select(F.lit("s").alias("place"), F.lit("]}]}").alias("line"))
    return head.unionByName(body).unionByName(tail).orderBy("place")


def graph_json(functions: DataFrame, calls: DataFrame, findings: DataFrame) -> DataFrame:
    """(kind, json) rows of a code map: functions (fn, loc), call edges (caller, callee), findings with the functions they pass (fp, rule_id, fns)."""
    f = functions.select(F.lit("function").alias("kind"), F.to_json(F.struct("fn", "loc")).alias("json"))
    c = calls.select(F.lit("call").alias("kind"), F.to_json(F.struct("caller", "callee")).alias("json"))
    return f.union(c).union(findings.select(F.lit("finding").alias("kind"), F.to_json(F.struct("fp", "rule_id", "fns")).alias("json")))


def validate_sarif(text: str) -> list[str]:
    """What a document lacks; empty if it is sound."""
    wrong = []
    doc = json.loads(text)
    if doc.get("version") != "2.1.0":
        wrong.append("version is not 2.1.0")
    for run in doc.get("runs") or [{}]:
        rules = {r.get("id") for r in run.get("tool", {}).get("driver", {}).get("rules", [])}
        if not run.get("tool", {}).get("driver", {}).get("name"):
            wrong.append("a run's tool has no name")
        for r in run.get("results", []):
            if r.get("ruleId") not in rules:
                wrong.append(f"no rule {r.get('ruleId')}")
            if r.get("level") not in ("none", "note", "warning", "error"):
                wrong.append(f"level {r.get('level')}")
    return wrong


def text_report(findings: DataFrame) -> DataFrame:
    """(line,) for each finding, in the order of bands, totals and rules."""
    line = F.format_string("[%s] %s %s (%s)", F.col("band"), F.col("rule_id"), F.col("fp"), F.col("confidence"))
    return findings.orderBy("band", F.col("total").desc(), "rule_id", "fp").select(line.alias("line"))


def proof_tree(findings: DataFrame) -> DataFrame:
    """(fp, text): what speaks for each finding, in lines: its ends, its path, what its exceptions found, its context and what to review.

    ``findings``: as of Compiler.explain; ``context`` (lines) may be added.
    """
    mark = lambda e: F.when(e["satisfied"], "satisfied (suppressed)").otherwise("not satisfied")
    more = lambda x: F.when(S.text(x) != "", F.concat(F.lit(" — "), x)).otherwise("")
    none = F.array().cast("array<string>")
    lines = [
        F.array(F.format_string("[%s] %s  (conf=%s, fp=%s)", F.upper("severity"), F.col("rule_id"), F.col("confidence"), F.col("fp"))),
        F.when(F.col("source").isNotNull(), F.array(F.concat(F.lit("    source: "), "source"))),
        F.array(F.concat(F.lit("    sink: "), "node_id", F.lit(" @ "), S.text("loc"))),
        F.when(F.size("path") > 0, F.array(F.concat(F.lit("    taint path: "), F.array_join("path", " -> ")))),
        F.transform("evidence", lambda e: F.concat(F.lit("    unless "), e["clause"], F.lit(": "), mark(e), more(e["detail"]))),
    ]
    if "context" in findings.columns:
        lines.append(F.transform("context", lambda c: F.concat(F.lit("    context: "), c)))
    lines.append(F.transform("review", lambda r: F.concat(F.lit("    review condition: "), r["condition"], F.when(r["assumption"] != "", F.concat(F.lit(" — advisory: "), r["assumption"])).otherwise(""), F.lit(" — conf="), r["confidence"])))
    return findings.select("fp", F.array_join(F.flatten(F.array(*(F.coalesce(x, none) for x in lines))), "\n").alias("text"))
