"""Which bindings apply to which modules, and which nodes they select.

Requirements are looked up, not scanned: all primitives that any binding names
are one table, facts meet it in one join, and a module's row is the set of
those that hold. A binding comes to a module by the literals of one of its
positive clauses, and its other clauses are checked on the set. What bindings
emit are facts for others; a stratum is repeated until it emits nothing new,
and absence is only asked of finished strata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..storage import materialize

CONFIDENCES = ("low", "medium", "high")


def applicable(facts: DataFrame, bindings: list, strata: list[list], emitted: str = "project.has") -> DataFrame:
    """(module, binding, emits, confidence) of all bindings whose requirements hold.

    ``facts``: module, kind, name, version (empty if there is none);
    ``strata``: the bindings in finished groups (plans.bindings.strata). A soft
    requirement that fails makes the confidence one lower.
    """
    spark = facts.sparkSession
    leaves = sorted({leaf for b in bindings for c in [*b.clauses, *b.soft] for leaf, _ in c} | {(emitted, b.emits, "") for b in bindings if b.emits})
    number = {leaf: i for i, leaf in enumerate(leaves)}
    known = spark.createDataFrame([(i, *leaf) for leaf, i in number.items()], "leaf int, l_kind string, l_name string, spec string")
    met = facts.join(known.where(F.col("l_kind") != emitted), (F.col("kind") == F.col("l_kind")) & (F.lower("name") == F.lower("l_name")))
    base = met.where((F.col("spec") == "") | S.specifier_allows("spec", "version")).select("module", "leaf").distinct()
    base = materialize(base, "requirements")
    modules = materialize(facts.select("module").distinct(), "modules")
    row = lambda b: (b.name, b.emits, b.confidence, number.get((emitted, b.emits, "")), *([[(number[leaf], absent) for leaf, absent in sorted(c)] for c in cs] for cs in (b.clauses, b.soft)))
    kind = "binding string, emits string, confidence string, gives int, clauses array<array<struct<leaf:int,absent:boolean>>>, soft array<array<struct<leaf:int,absent:boolean>>>"
    holds = None
    for stratum in strata:
        table = spark.createDataFrame([row(b) for b in stratum], kind)
        plain = {b.name: next((c for c in sorted(b.clauses, key=len) if not any(absent for _, absent in c)), None) for b in stratum}
        triggers = [(b.name, number[leaf]) for b in stratum if plain[b.name] for leaf, _ in plain[b.name]]
        triggers = spark.createDataFrame(triggers, "t_binding string, t_leaf int")
        always = [n for n, c in plain.items() if c is None]
        done = None
        while True:
            emits = [h.where("gives is not null").select("module", F.col("gives").alias("leaf")) for h in (holds, done) if h is not None]
            have = base
            for e in emits:
                have = have.union(e)
            have = have.distinct()
            sets = have.groupBy("module").agg(F.collect_set("leaf").alias("has"))  # at most as many as the bindings name
            come = have.join(triggers, F.col("leaf") == F.col("t_leaf")).select("module", F.col("t_binding").alias("binding")).distinct()
            if always:
                come = come.union(modules.select("module", F.explode(F.array(*map(F.lit, always))).alias("binding")))
            if done is not None:
                come = come.join(done.select("module", "binding"), ["module", "binding"], "left_anti")
            rows = come.join(sets, "module", "left").withColumn("has", F.coalesce("has", F.array().cast("array<int>"))).join(table, "binding")
            one_of = lambda c: F.exists(c, lambda x: F.array_contains(F.col("has"), x["leaf"]) != x["absent"])
            good = rows.where(F.forall("clauses", one_of)).withColumn("softened", ~F.forall("soft", one_of))
            good = materialize(good.select("module", "binding", "emits", "confidence", "gives", "softened"), "applied")
            if good.isEmpty():
                break
            done = good if done is None else done.unionByName(good)
        if done is not None:
            holds = done if holds is None else holds.unionByName(done)
    if holds is None:
        return modules.select("module", *(F.lit("").alias(c) for c in ("binding", "emits", "confidence"))).limit(0)
    names = F.array(*map(F.lit, CONFIDENCES))
    lower = F.element_at(names, F.greatest(F.array_position(names, F.col("confidence")) - 1, F.lit(1)).cast("int"))
    return holds.select("module", "binding", "emits", F.when(F.col("softened"), lower).otherwise(F.col("confidence")).alias("confidence"))


def file_facts(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(module, kind, name, version) of the file requirements that a module's paths meet: files (module, path) in one scan; * is any run of characters."""
    regex = lambda p: "(^|/)" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in p) + "$"
    hit = F.array_compact(F.array(*(F.when(F.col("path").rlike(regex(p)), F.lit(p)) for p in patterns)))
    return files.select("module", F.lit("file").alias("kind"), F.explode(hit).alias("name"), F.lit("").alias("version")).distinct()


def bind_selectors(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """(node_id, binding, concept): of the selectors of the node's family that its path ends in, the longest ones.

    ``nodes``: node_id, family, path; ``selectors``: family, selector, binding,
    concept. All families meet all selectors in one join, on the family and the
    last segment; of a node only matches are ranked. Selectors are part of the
    rules and go to all tasks: a few segments have most of the nodes, which a
    shuffle by segment would bring into one task.
    """
    wanted = selectors.select(F.col("family").alias("s_family"), F.col("selector"), "binding", "concept", S.last_segment("selector").alias("s_last"), F.size(F.split("selector", r"\.")).alias("segments"))
    met = nodes.withColumn("last", S.last_segment("path")).join(F.broadcast(wanted), (F.col("family") == F.col("s_family")) & (F.col("last") == F.col("s_last"))).where(S.path_suffix_matches("path", "selector"))
    best = met.withColumn("place", F.rank().over(Window.partitionBy("node_id").orderBy(F.desc("segments"))))
    return best.where("place = 1").select("node_id", "binding", "concept").distinct()
