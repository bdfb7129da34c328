"""Ranking, confidence, identity, priority and comparison of findings and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import policies
from ..plans.policies import Policy

CONFIDENCES = ("low", "medium", "high")
FIDELITIES = ("syntactic", "resolved", "semantic")
ORIGINS = ("generated", "community", "builtin", "tenant")
SEVERITIES = ("info", "low", "medium", "high", "critical")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def per_sink(findings: DataFrame) -> DataFrame:
    """One finding for each rule and sink: the most confident, then the earliest (``seq``)."""
    return first_by(findings, ["rule_id", "sink"], S.rank("confidence", CONFIDENCES).desc(), F.col("seq"))


def dedup(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The representative of each identity: confidence, severity, then the shortest witness, then the fingerprint."""
    return first_by(findings, keys, S.rank("confidence", CONFIDENCES).desc(), S.rank("severity", SEVERITIES).desc(), F.col("witness_length"), F.col("fp"))


# ---- labels


def ranked_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals with their place among those of one node and concept: specificity, fidelity, origin, then the earlier applicator."""
    order = [F.col("specificity").desc(), S.rank("fidelity", FIDELITIES).desc(), S.rank("origin", ORIGINS).desc(), F.col("app_seq")]
    return proposals.withColumn("place", F.row_number().over(Window.partitionBy("node_id", "concept").orderBy(*order)))


def resolve(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, suppressed). Proposals: node_id, concept, negative, specificity, fidelity, origin, app_seq, confidence.

    The best negative claim beats the best positive one if it ranks above it.
    A tenant's negative suppresses all others, its positive attaches always.
    """
    key = ["node_id", "concept"]
    power = F.struct(F.col("specificity"), S.rank("fidelity", FIDELITIES).alias("f"), S.rank("origin", ORIGINS).alias("o"), (-F.col("app_seq")).alias("s"))
    sides = proposals.groupBy(*key).agg(F.max(F.when(~F.col("negative"), power)).alias("yes"), F.max(F.when(F.col("negative"), power)).alias("no"), F.max(F.when(F.col("origin") == "tenant", F.col("negative"))).alias("tenant"))
    # a tenant's positive override has tenant = false, its negative one true
    attach = F.when(F.col("tenant").isNotNull(), ~F.col("tenant")).otherwise(F.col("no").isNull() | (F.col("yes") > F.col("no")))
    decided = sides.select(*key, S.sure(F.col("yes").isNotNull() & attach).alias("attached"))
    best = ranked_proposals(proposals.where(~F.col("negative"))).where("place = 1")
    won = best.join(decided.where("attached"), key, "left_semi").drop("place")
    lost = proposals.where(~F.col("negative")).join(won.select(*key, "app_seq"), [*key, "app_seq"], "left_anti")
    return won, lost


def ceiling(confidence: Column, fidelity: Column) -> Column:
    """Rank of the confidence, of an unset or unknown one the highest; a syntactic label is medium at most."""
    r = F.when(S.rank(confidence, CONFIDENCES) == 0, len(CONFIDENCES)).otherwise(S.rank(confidence, CONFIDENCES))
    return F.when(fidelity == "syntactic", F.least(r, F.lit(2))).otherwise(r)


def node_confidence(labels: DataFrame, concept: str) -> DataFrame:
    """(node_id, confidence_rank) over the labels of one concept alone."""
    return labels.where(F.col("concept") == concept).groupBy("node_id").agg(F.min(ceiling(F.col("confidence"), F.col("fidelity"))).alias("confidence_rank"))


def first_label(labels: DataFrame, names: list[str]) -> DataFrame:
    """(node_id, concept): of the labels that name one of the concepts the first (by ``seq``, if there is one)."""
    seq = F.col("seq") if "seq" in labels.columns else F.lit(0)
    return labels.where(F.col("concept").isin(*names)).groupBy("node_id").agg(F.min(F.struct(seq.alias("seq"), "concept"))["concept"].alias("concept"))


def provenance_pick(labels: DataFrame) -> DataFrame:
    """Of each node's labels the one with the highest provenance priority, else the first."""
    return first_by(labels, ["node_id"], F.coalesce(F.col("provenance_priority"), F.lit(0)).desc(), F.col("seq"))


# ---- priority


def priority(findings: DataFrame, factors: dict[str, int], policy: Policy | None = None) -> DataFrame:
    """total and band: the severity's weight and those of the factors (boolean columns) that hold. Weights and bands are a declared policy's, or the built-in one's."""
    policy = policy or policies.parse(policies.BUILTIN)["priority"]
    weights, bands = policy.scores["severity"], policy.bands
    severity = F.lit(weights.get("default", 0))
    for name, w in weights.items():
        if name != "default":
            severity = F.when(F.col("severity") == name, w).otherwise(severity)
    total = sum((F.when(S.sure(F.col(c)), w).otherwise(0) for c, w in factors.items()), severity)
    band = F.lit(bands[-1][1])
    for least, name in reversed(bands):
        band = F.when(F.col("total") >= least, name).otherwise(band)
    return findings.withColumn("total", total).withColumn("band", band)


def gate(findings: DataFrame, threshold: str) -> DataFrame:
    """(n_at_or_above, max_rank) for a severity threshold."""
    r = S.rank("severity", SEVERITIES)
    return findings.agg(F.sum((r >= SEVERITIES.index(threshold) + 1).cast("long")).alias("n_at_or_above"), F.max(r).alias("max_rank"))


# ---- comparison


def baseline_split(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fp, status): reported, covered or stale."""
    reported = findings.join(baseline, "fp", "left_anti").select("fp", F.lit("reported").alias("status"))
    covered = findings.join(baseline, "fp", "left_semi").select("fp", F.lit("covered").alias("status"))
    stale = baseline.join(findings, "fp", "left_anti").select("fp", F.lit("stale").alias("status"))
    return reported.union(covered).union(stale)


def scan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(fp, change): added, removed or unchanged."""
    both = before.select(F.col("fp").alias("old")).distinct().join(after.select(F.col("fp").alias("new")).distinct(), F.col("old") == F.col("new"), "full_outer")
    return both.select(F.coalesce("old", "new").alias("fp"), F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("unchanged").alias("change"))


# ---- measures


def youden(cases: DataFrame, category: str, truth: str, found: str) -> DataFrame:
    """TP, FN, FP, TN and J = TPR - FPR of each category."""
    t, f = S.sure(F.col(truth)), S.sure(F.col(found))
    n = lambda c: F.sum(c.cast("long"))
    out = cases.groupBy(category).agg(n(t & f).alias("tp"), n(t & ~f).alias("fn"), n(~t & f).alias("fp"), n(~t & ~f).alias("tn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(F.lit(0.0))
    return out.withColumn("j", rate("tp", "fn") - rate("fp", "tn"))
