"""Patterns that attach concepts to nodes, and packages, versions and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def bind_by_method(calls: DataFrame, matchers: DataFrame) -> DataFrame:
    """calls (node_id, method, callee_path, n_args) by matchers (method, concept, min_args, max_args, receiver): equality on the method, then the rest.

    An empty receiver asks for nothing; else the callee's path ends in it before the method.
    """
    met = calls.join(matchers.withColumnRenamed("method", "m"), F.col("method") == F.col("m"))
    receiver = (S.text("receiver") == "") | S.path_suffix_matches(S.receiver_prefix("callee_path"), F.col("receiver"))
    return met.where(receiver & (F.col("n_args") >= F.coalesce("min_args", F.lit(0))) & (F.col("n_args") <= F.coalesce("max_args", F.lit(1 << 30)))).select("node_id", "concept").distinct()


def bind_by_path(calls: DataFrame, value: str, concept: str, mode: str = "segments") -> DataFrame:
    return calls.where(S.segments_match(F.col("callee_path"), F.lit(value), mode)).select("node_id", F.lit(concept).alias("concept"))


def bind_presence(nodes: DataFrame, tokens: str, any_of: list[str] | None = None, all_of: list[str] | None = None, none_of: list[str] | None = None) -> DataFrame:
    """Nodes whose tokens fit: one of, all of, none of."""
    has = lambda names: F.arrays_overlap(F.col(tokens), F.array(*map(F.lit, names)))
    keep = F.lit(True)
    if any_of:
        keep &= has(any_of)
    if all_of:
        keep &= F.size(F.array_intersect(F.col(tokens), F.array(*map(F.lit, all_of)))) == len(set(all_of))
    if none_of:
        keep &= ~has(none_of)
    return nodes.where(S.sure(keep))


def literals(value: Column, must: list[str], absent: list[str]) -> Column:
    keep = F.lit(True)
    for x in must:
        keep &= F.instr(S.text(value), x) > 0
    for x in absent:
        keep &= F.instr(S.text(value), x) == 0
    return keep


def emit_labels(bound: DataFrame, args: str | None = None, index: int | None = None) -> DataFrame:
    """The labelled node: the call itself, its argument ``index``, or every argument."""
    if args is None:
        return bound.select("node_id", "concept")
    if index is not None:
        return bound.select(F.try_element_at(args, F.lit(index + 1)).alias("node_id"), "concept").where("node_id is not null")
    return bound.select(F.explode(args).alias("node_id"), "concept")


def soften(confidence: Column, requirement_met: Column) -> Column:
    """One confidence lower where a soft requirement is missing or unknown."""
    lower = F.when(confidence == "high", "medium").otherwise("low")
    return F.when(S.sure(requirement_met), confidence).otherwise(lower)


def call_edges(args: DataFrame, params: DataFrame, returns: DataFrame, flows: DataFrame) -> DataFrame:
    """(caller, callee): an argument flows to a parameter, or a return value to a call; distinct pairs.

    ``args``: node_id, fn (whose call it is); ``params`` and ``returns``: node_id, fn.
    """
    a, p = args.select(F.col("node_id").alias("src"), F.col("fn").alias("caller")), params.select(F.col("node_id").alias("dst"), F.col("fn").alias("callee"))
    down = flows.select("src", "dst").join(a, "src").join(p, "dst").select("caller", "callee")
    r, c = returns.select(F.col("node_id").alias("src"), F.col("fn").alias("callee")), args.select(F.col("node_id").alias("dst"), F.col("fn").alias("caller"))
    up = flows.select("src", "dst").join(r, "src").join(c, "dst").select("caller", "callee")
    return down.union(up).where("caller <> callee").distinct()


# ---- packages


def package_gate(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """evidence (name) that provides a wanted package: equal, or below it at a dot or slash, by exploded stems."""
    stems = evidence.select("name", F.explode(S.package_stems("name")).alias("stem"))
    return stems.join(wanted.select(S.normalize_package("package").alias("stem"), "package"), "stem").select("name", "package").distinct()


def package_pairs(evidence: DataFrame, wanted: DataFrame, aliases: bool = False) -> DataFrame:
    """(name, package) of all nine ways of package_matches, as one equality join of both sides' names, ancestors and segments.

    With ``aliases`` an import also stands for the packages that it comes from.
    """
    name = F.explode(F.array_append(S.import_aliases("name"), F.col("name"))).alias("as_name") if aliases else F.col("name").alias("as_name")
    own = evidence.select("name").distinct().select("name", name).select("name", F.explode(S.package_keys("as_name", False)).alias("k"))
    want = wanted.select("package").distinct().select("package", F.explode(S.package_keys("package", True)).alias("w"))
    return own.join(want, F.col("k") == F.col("w")).select("name", "package").distinct()


def advisory_matches(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """packages (eco, name, version) by advisories (eco, name, id, exact, min_safe, max_safe): an exact version, or below the first safe one, or up to the last bad one."""
    a = advisories.select(*(F.col(c).alias(f"a_{c}") for c in advisories.columns))
    met = packages.join(a, (F.col("eco") == F.col("a_eco")) & (S.normalize_package("name") == S.normalize_package("a_name")))
    have = S.version_key("version")
    hit = F.when(F.col("a_exact").isNotNull(), (F.col("a_exact") == "*") | (have == S.version_key("a_exact"))).otherwise(
        (F.col("a_min_safe").isNotNull() & (have < S.version_key("a_min_safe"))) | (F.col("a_max_safe").isNotNull() & (have < S.version_key("a_max_safe")))
    )
    return met.where(S.sure(hit)).select("eco", "name", "version", F.col("a_id").alias("id"))


def typosquats(names: DataFrame, popular: DataFrame, least: int = 4) -> DataFrame:
    """(name, near): names at edit distance 1 from a popular one that are not popular themselves, by shared deletions."""
    one = names.where(F.length("name") >= least).select("name").distinct().join(popular.select("name").distinct(), "name", "left_anti")
    a = one.select("name", F.explode(S.deletions("name")).alias("cut"))
    b = popular.where(F.length("name") >= least).select(F.col("name").alias("near")).distinct().select("near", F.explode(S.deletions("near")).alias("cut"))
    return a.join(b, "cut").select("name", "near").distinct().where(S.edit_distance_le1("name", "near"))


def malware_verdicts(packages: DataFrame, known: DataFrame) -> DataFrame:
    """malicious at a known bad version (* is all of them), suspicious at another version of a package with bad ones.

    Packages whose ``trusted`` column holds, if there is one, are taken at their word.
    """
    if "trusted" in packages.columns:
        packages = packages.where(~S.sure(F.col("trusted")))
    bad = known.select(F.col("name").alias("b_name"), F.col("version").alias("b_version")).distinct()
    met = packages.join(bad, F.col("name") == F.col("b_name")).groupBy("name", "version").agg(F.max(((F.col("version") == F.col("b_version")) | (F.col("b_version") == "*")).cast("int")).alias("hit"))
    return met.select("name", "version", F.when(F.col("hit") == 1, "malicious").otherwise("suspicious").alias("verdict"))


def name_verdicts(packages: DataFrame, known: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, version, verdict, near): malware_verdicts, and typosquats among the packages without any bad version on record."""
    found = malware_verdicts(packages, known).withColumn("near", F.lit(None).cast("string"))
    left = packages.where(~S.sure(F.col("trusted"))) if "trusted" in packages.columns else packages
    left = left.select("name", "version").distinct().join(known.select("name").distinct(), "name", "left_anti")
    near = typosquats(left, popular).groupBy("name").agg(F.min("near").alias("near"))
    return found.unionByName(left.join(near, "name").select("name", "version", F.lit("suspicious").alias("verdict"), "near"))
