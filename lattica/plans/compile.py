"""Rules as DataFrame plans.

A rule becomes a label scan with filters and anti joins, a reach over flows,
hops or steps, or pairs of nodes. Concepts are expanded to all that refine
them before the plan is made; rules with the same taint policy share one run.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import Graph
from ..operators import context, coverage, findings, flows, solve
from ..storage import materialize
from .lang import Call, Ontology, Op, Ref, Rule, RuleError, Step

#: Columns of a node that a reference can name; other names are properties.
INLINE = ("node_type", "loc", "region", "scope", "method", "callee_path")


class Compiler:
    def __init__(self, graph: Graph, ontology: Ontology, levels: dict[str, int] | None = None):
        self.graph, self.ontology, self.levels = graph, ontology, levels or {}
        self.runs: dict[tuple, tuple[flows.Runs, str]] = {}
        self._edges: DataFrame | None = None

    # ---- candidates

    def ids(self, concept: str) -> DataFrame:
        return self.graph.nodes_with_concept(*self.ontology.descendants(concept))

    def nodes(self, concept: str) -> DataFrame:
        return self.holders(concept).join(self.ids(concept), "node_id", "left_semi")

    def holders(self, concept: str) -> DataFrame:
        """The nodes that can carry the concept or one that refines it."""
        return self.graph.nodes_for(*self.ontology.descendants(concept))

    def guards(self, control: str, part: str) -> DataFrame:
        names = self.ontology.descendants(control)
        labels = self.graph.labels.withColumn("concept", F.when(F.col("concept").isin(*names), control).otherwise(F.lit(None)))
        return coverage.guards(self.holders(control), labels, control, part)

    # ---- expressions

    def property(self, ref: str, aliases: set[str]) -> Column:
        first, _, rest = ref.partition(".")
        name = (rest if first in aliases else ref).split(".")[0]  # only the first segment is used
        if name in INLINE:
            return S.text(name)
        return F.col("node_id") if name == "id" else S.prop(name)

    def operand(self, x, aliases: set[str]) -> Column:
        return self.property(x.name, aliases) if isinstance(x, Ref) and x.name.partition(".")[0] in aliases else F.lit(x.name if isinstance(x, Ref) else x)

    def predicate(self, x, aliases: set[str]) -> Column:
        if isinstance(x, Op) and x.name in ("and", "or"):
            a, b = (self.predicate(y, aliases) for y in x.args)
            return a & b if x.name == "and" else a | b
        if isinstance(x, Op) and x.name == "not":
            return ~self.predicate(x.args[0], aliases)
        if isinstance(x, Call):
            return self.call(x, aliases)
        if not isinstance(x, Op):
            raise RuleError(f"{x!r} is no predicate")
        left, right = x.args[0], x.args[1] if len(x.args) > 1 else None
        value = self.operand(left, aliases)
        if x.name == "exists":
            return value != ""
        if x.name in ("in", "not in"):
            found = S.text(value).isin(*[str(v) for v in right])
            return found if x.name == "in" else ~found
        if isinstance(right, int) and not isinstance(right, bool):
            return S.compare_int(value, x.name, right)
        want = self.operand(right, aliases)
        text = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike}
        if x.name in text:
            return S.sure(text[x.name](value, want))
        if x.name == "~=":
            return S.segments_match(value, want)
        if x.name in ("==", "is"):
            return S.text(value) == S.text(want)
        if x.name == "!=":
            return S.text(value) != S.text(want)
        return F.lit(False)

    def call(self, x: Call, aliases: set[str]) -> Column:
        if x.name == "holdsAssetKind":
            wanted = [str(a.name if isinstance(a, Ref) else a) for a in x.args if not (isinstance(a, Ref) and a.name in aliases)]
            kinds = F.transform(F.split(S.prop("asset_kinds"), ","), lambda k: F.trim(k))
            return F.arrays_overlap(kinds, F.array(*map(F.lit, wanted)))
        raise RuleError(f"{x.name} stands alone in a where clause, or not at all")

    def where(self, rows: DataFrame, clauses: list, aliases: set[str]) -> DataFrame:
        """Conjunctions are split, so that solver calls become semi joins."""
        todo = list(clauses)
        while todo:
            x = todo.pop(0)
            if isinstance(x, Op) and x.name == "and":
                todo = [*x.args, *todo]
            elif isinstance(x, Call) and x.name in ("reach", "grant", "dominates"):
                rows = self.solver(rows, x, aliases)
            else:
                rows = rows.where(self.predicate(x, aliases))
        return rows

    def solver(self, rows: DataFrame, x: Call, aliases: set[str]) -> DataFrame:
        """reach(X, a.p), grant(a, Q), dominates(X, a): a call that mentions the row keeps rows for which a path exists."""
        a, b = x.args
        own = lambda r: isinstance(r, Ref) and r.name.partition(".")[0] in aliases
        if x.name == "dominates":
            g = self.nodes(a.name)
            left = coverage.uncovered_dominates(rows, g)
            return rows.join(left.select("node_id"), "node_id", "left_anti")
        ends = [rows.select(self._id(r, aliases).alias("node_id")) if own(r) else self.ids(r.name) for r in (a, b)]
        found = self._hops("NET", *ends) if x.name == "reach" else self._grants(*ends, None if own(b) else b.name)
        at = ("source", a) if own(a) else ("target", b)
        return rows.join(found.select(F.col(at[0]).alias("_end")).distinct(), self._id(at[1], aliases) == F.col("_end"), "left_semi")

    def _id(self, r: Ref, aliases: set[str]) -> Column:
        return F.col("node_id") if r.name in aliases else self.property(r.name, aliases)

    def _hops(self, edge_type: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
        return solve.hop_reach(self.graph.out_edges(edge_type), sources, targets)

    def _grants(self, sources: DataFrame, targets: DataFrame, concept: str | None) -> DataFrame:
        c = self.ontology.concepts.get(concept or "")
        least = self.levels.get(c.meta.get("grant_min_level", ""), 0) if c else 0
        level = F.lit(0)
        for name, n in self.levels.items():
            level = F.when(S.prop("priv_level") == name, n).otherwise(level)
        return solve.grant_closure(self.graph.out_edges("STEP"), sources, targets, self.graph.nodes.select("node_id", level.alias("rank")) if least else None, least)

    # ---- rules

    def exceptions(self, rows: DataFrame, unless: list[tuple[str, str]]) -> DataFrame:
        for part, control in unless:
            if part == "path":
                continue  # the kill set of the reach
            g = self.guards(control, part)
            if part == "endpoint":
                rows = coverage.uncovered_endpoint(rows, g, self.graph.edges)
            elif part == "sameReceiver":
                rows = self.same_receiver(rows, g, control)
            else:
                rows = {"dominates": coverage.uncovered_dominates, "postDominates": coverage.uncovered_post_dominates, "sameScope": coverage.uncovered_same_scope, "global": coverage.uncovered_global}[part](rows, g)
        return rows

    def with_role(self, role: str) -> list[str]:
        """Concepts whose declaration names an internal role."""
        return [n for n, c in self.ontology.concepts.items() if role in (c.meta.get("roles") or [])]

    def same_receiver(self, rows: DataFrame, guards: DataFrame, control: str) -> DataFrame:
        """Only where concepts declare roles do they gate: the control has to be a guard on receivers, the row one of their targets."""
        guarding, targets = self.with_role("same_receiver_guard"), self.with_role("same_receiver_guard_target")
        if guarding and control not in guarding:
            return rows
        return coverage.uncovered_same_receiver(rows, guards, self.graph.nodes_with_concept(*targets) if targets else None)

    def policy(self, rule: Rule) -> tuple[str, tuple[str, ...], str]:
        """Source concept, controls on the path and excluded characters: rules with equal ones share a run."""
        sink = self.ontology.concepts.get(self.ontology.canonical(rule.ends[1].concept))
        return rule.ends[0].concept, tuple(sorted(c for p, c in rule.unless if p == "path")), sink.meta.get("excluded_chars", "") if sink else ""

    def prepare(self, rules: list[Rule]) -> None:
        """Run the policies of all taint rules that have not run yet, in one loop."""
        todo = {k for r in rules if r.verb == "taint" and (k := self.policy(r)) not in self.runs}
        if not todo:
            return
        if self._edges is None:
            self._edges = flows.written(self.graph.out_edges("FLOWS"))
        names = {f"p{i}": k for i, k in enumerate(sorted(todo))}
        done = flows.run(self._edges, {n: (self.sources(k[0]), self.kills(k[1], k[2])) for n, k in names.items()})
        self.runs |= {k: (done, n) for n, k in names.items()}

    def sources(self, concept: str) -> DataFrame:
        """(node_id, rank): the best fidelity of the labels that make a node a source."""
        rank = F.coalesce(F.array_position(F.array(*map(F.lit, findings.FIDELITIES)), F.col("fidelity")), F.lit(0))
        labels = self.graph.labels.where(F.col("concept").isin(*self.ontology.descendants(concept)))
        return labels.groupBy("node_id").agg(F.max(rank).cast("int").alias("rank"))

    def kills(self, controls: tuple[str, ...], excluded: str) -> DataFrame:
        names = [n for c in controls for n in self.ontology.descendants(c)]
        return solve.kill_nodes(self.graph.labels, names, excluded)

    def compile(self, rule: Rule) -> DataFrame:
        """rule_id, severity, source (null without one), node_id, loc, confidence, fp of a rule's findings."""
        return self.explain(rule).select("rule_id", "severity", "source", "node_id", "loc", "confidence", "fp")

    def explain(self, rule: Rule) -> DataFrame:
        """The findings with what speaks for them: also path (of a taint rule: from its best source), evidence (clause, satisfied, detail) and review (condition, assumption, confidence)."""
        body = {"issue": self._match, "fact": self._match, "taint": self._taint, "reach": self._reach, "grant": self._grant, "query": self._query}[rule.verb]
        rows = body(rule)
        nothing = {"path": "array<string>", "source_rank": "int", "ceiling": "int", "evidence": "array<struct<clause:string,satisfied:boolean,detail:string>>", "review": "array<struct<condition:string,assumption:string,confidence:string>>"}
        for name, kind in nothing.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        concept = rule.ends[-1].concept if rule.ends else ""
        if concept:
            rows = rows.join(self.confidence(concept), "node_id", "left")
        else:
            rows = rows.withColumn("confidence_rank", F.lit(None).cast("int"))
        rank = F.least(F.coalesce("confidence_rank", F.lit(3)), F.coalesce("source_rank", F.lit(3)), F.coalesce("ceiling", F.lit(3)))
        if rule.confidence:
            rows = rows.where(rank >= findings.CONFIDENCES.index(rule.confidence) + 1)
        name = F.element_at(F.array(*map(F.lit, findings.CONFIDENCES)), F.greatest(rank, F.lit(1)))
        rows = rows.select("source", "node_id", "loc", name.alias("confidence"), "path", "evidence", "review").dropDuplicates(["source", "node_id", "confidence"])
        return rows.select(
            F.lit(rule.id).alias("rule_id"), F.lit(rule.meta.get("severity", "info")).alias("severity"), "source", "node_id", "loc", "confidence",
            S.fingerprint(rule=F.lit(rule.id), loc="loc", concept=F.lit(concept)).alias("fp"), "path", "evidence", "review",
        )

    def context(self, rows: DataFrame) -> DataFrame:
        """(node_id, context) of the findings' nodes, as far as concepts declare any: context_reach_*, context_asset_* and context_confirm_* of their declarations."""
        of = lambda c, k, default="": str(c.meta.get(f"context_{k}", default))
        known = [(tuple(self.ontology.descendants(n)), c) for n, c in sorted(self.ontology.concepts.items())]
        exposures = [context.Exposure(d, of(c, "reach_target_prop"), of(c, "reach_label", c.name)) for d, c in known if c.meta.get("context_reach_source") is True and of(c, "reach_target_prop")]
        holdings = [context.Holding(d, of(c, "asset_target_prop"), of(c, "asset_label", "{target} holds [{kinds}]")) for d, c in known if of(c, "asset_target_prop")]
        confirmations = [context.Confirmation(d, of(c, "confirm_dst_prop"), of(c, "confirm_label", f"confirmed by {c.name}"), of(c, "confirm_flag_prop"), of(c, "confirm_flag_value")) for d, c in known if of(c, "confirm_dst_prop")]
        return context.enrich(rows, self.graph.nodes, self.graph.labels, self.graph.out_edges("NET"), exposures, confirmations, holdings)

    def confidence(self, concept: str) -> DataFrame:
        """(node_id, confidence_rank) over the labels of the concept or one that refines it."""
        names = self.ontology.descendants(concept)
        return findings.node_confidence(self.graph.labels.withColumn("concept", F.when(F.col("concept").isin(*names), concept).otherwise(F.lit(None))), concept)

    def _match(self, rule: Rule) -> DataFrame:
        e = rule.ends[0]
        rows = self.where(self.nodes(e.concept), rule.where, {e.alias} - {""})
        return self.exceptions(rows, rule.unless).withColumn("source", F.lit(None).cast("string"))

    def _taint(self, rule: Rule) -> DataFrame:
        a, b = rule.ends
        self.prepare([rule])
        runs, name = self.runs[self.policy(rule)]
        found = materialize(runs.witnesses(name, self.ids(b.concept)), "witnesses")
        rows = self.holders(b.concept).join(found.select("node_id", "path"), "node_id")
        rows = self.where(rows, rule.where, {b.alias} - {""})
        rows = self.exceptions(rows, rule.unless)
        for part, control in rule.unless:
            if part == "endpoint":
                covered = flows.flow_guarded(found, runs.edges, self.graph.nodes, self.guards(control, part))
                rows = rows.join(covered, "node_id", "left_anti")
        rows = rows.withColumn("source", F.col("path")[0]).withColumn("evidence", self.evidence(rule))
        if any(part == "path" for part, _ in rule.unless):
            near = runs.near_misses(name).agg(F.count("*").alias("near_n"), F.min(F.struct("depth", "node_id")).alias("near_first"))
            rows = rows.crossJoin(F.broadcast(near))  # one row
            said = F.when(F.col("near_n") == 0, "none on any flow").otherwise(F.concat(F.col("near_n").cast("string"), F.lit(" on other paths, the nearest at "), F.col("near_first.node_id")))
            rows = rows.withColumn("evidence", F.transform("evidence", lambda e: F.when(F.startswith(e["clause"], F.lit("path ")), F.struct(e["clause"].alias("clause"), e["satisfied"].alias("satisfied"), said.alias("detail"))).otherwise(e)))
        of = self.confidence(a.concept).select(F.col("node_id").alias("source"), F.col("confidence_rank").alias("source_rank"))
        return self.reviewed(a.concept, rows.join(of, "source", "left"))

    def evidence(self, rule: Rule) -> Column:
        """What the exceptions of a finding that stands found: nothing."""
        each = [F.struct(F.lit(f"{part} coveredBy {control}").alias("clause"), F.lit(False).alias("satisfied"), F.lit("no control of this part covers it").alias("detail")) for part, control in rule.unless]
        return F.array(*each) if each else F.array().cast("array<struct<clause:string,satisfied:boolean,detail:string>>")

    def reviewed(self, concept: str, rows: DataFrame) -> DataFrame:
        """Conditions of the source's concept: what has to be reviewed, and the confidence that a finding has at most."""
        known = {c: self.ontology.concepts[c].meta for c in self.ontology.descendants(concept) if c in self.ontology.concepts and self.ontology.concepts[c].meta.get("source_condition")}
        if not known:
            return rows
        first = findings.first_label(self.graph.labels, self.ontology.descendants(concept)).select(F.col("node_id").alias("source"), F.col("concept").alias("source_concept"))
        named = self.holders(concept).select(F.col("node_id").alias("source"), S.prop("name").alias("source_name"))
        rows = rows.join(first, "source", "left").join(named, "source", "left")
        review, ceiling = F.lit(None), F.lit(None)
        for c, meta in known.items():
            most = meta.get("source_confidence", "medium")
            said = F.replace(F.lit(meta["source_condition"]), F.lit("{param}"), S.text("source_name"))
            one = F.array(F.struct(said.alias("condition"), F.lit(meta.get("source_assumption", "")).alias("assumption"), F.lit(most).alias("confidence")))
            review = F.when(F.col("source_concept") == c, one).otherwise(review)
            ceiling = F.when(F.col("source_concept") == c, findings.CONFIDENCES.index(most) + 1).otherwise(ceiling)
        return rows.withColumn("review", review).withColumn("ceiling", ceiling.cast("int"))

    def _found(self, rule: Rule, found: DataFrame, of_concept: bool = False) -> DataFrame:
        """Nodes found, with their sources; of_concept: all of them carry the rule's second concept."""
        b = rule.ends[1]
        rows = (self.holders(b.concept) if of_concept else self.graph.nodes).join(found.select("source", F.col("target").alias("node_id")), "node_id")
        return self.where(rows, rule.where, {b.alias, b.concept} - {""})

    def _reach(self, rule: Rule) -> DataFrame:
        a, b = (self.ids(e.concept) for e in rule.ends)
        return self._found(rule, self._hops("NET", a, b), of_concept=True)

    def _grant(self, rule: Rule) -> DataFrame:
        a, b = (self.ids(e.concept) for e in rule.ends)
        return self._found(rule, self._grants(a, b, rule.ends[1].concept))

    # ---- queries over several families

    def _split(self, step: Step) -> tuple[str | None, list, list]:
        """The concept that a step's predicate names, its own conditions, and those that mention other aliases."""
        todo, concept, own, other = [step.where] if step.where is not None else [], None, [], []
        while todo:
            x = todo.pop(0)
            if isinstance(x, Op) and x.name == "and":
                todo = [*x.args, *todo]
            elif isinstance(x, Op) and x.name == "==" and isinstance(x.args[0], Ref) and x.args[0].name == f"{step.alias}.concept":
                concept = x.args[1].name if isinstance(x.args[1], Ref) else x.args[1]
            elif isinstance(x, Op) and len(x.args) == 2 and all(isinstance(a, Ref) and "." in a.name for a in x.args) and {a.name.partition(".")[0] for a in x.args} - {step.alias}:
                other.append(x)
            else:
                own.append(x)
        return concept, own, other

    def _side(self, step: Step) -> tuple[DataFrame, list]:
        concept, own, other = self._split(step)
        if step.family == "state":
            rows = self.graph.nodes_of_type("analysis.Transition")
        else:
            rows = self.nodes(concept) if concept else self.graph.nodes
        return self.where(rows, own, {step.alias}), other

    def _query(self, rule: Rule) -> DataFrame:
        rows, _ = self._side(rule.steps[0])
        none = F.lit(None).cast("string")
        if len(rule.steps) == 1:
            rows = self.where(rows, rule.where, {rule.steps[0].alias})
            return self.exceptions(rows, rule.unless).withColumn("source", none)
        for first, step in zip(rule.steps, rule.steps[1:]):
            right, other = self._side(step)
            ids = right.select(F.col("node_id").alias("r_id"))
            last = rule.select == step.alias
            if step.relation == "labeledAs":
                rows = rows.join(ids, F.col("node_id") == F.col("r_id"), "left_semi")
            elif step.relation == "references":
                ref = next(a for x in other for a in x.args if a.name.partition(".")[0] == first.alias)
                rows = rows.join(ids.distinct(), self.property(ref.name, {first.alias}) == F.col("r_id"), "left_semi")
            elif step.relation == "reaches" and first.family in ("principal", "asset") and step.family in ("asset", "principal"):
                found = self._hops("NET", rows.select("node_id"), right.select("node_id"))
                pick = found.select(F.col("target" if last else "source").alias("node_id")).distinct()
                rows = (right if last else rows).join(pick, "node_id", "left_semi")
            elif step.relation in ("reaches", "dominates", "postDominates", "flowsTo", "sameScope", "sameReceiver"):
                rows = self._paired(step.relation, rows, right, last)
            else:
                raise RuleError(f"no plan for the relation {step.relation}")
        return rows.withColumn("source", none)

    def _paired(self, relation: str, rows: DataFrame, right: DataFrame, last: bool) -> DataFrame:
        """Rows, or the right side's rows, that have a partner."""
        if relation == "reaches":
            pairs = coverage.order_pairs(rows, right)
            return (right if last else rows).join(pairs.select(F.col("b_id" if last else "a_id").alias("node_id")).distinct(), "node_id", "left_semi")
        if relation == "flowsTo":
            reached = solve.closure(self.graph.out_edges("FLOWS"), rows if last else right) if last else solve.closure(self.graph.out_edges("FLOWS").select(F.col("src").alias("dst"), F.col("dst").alias("src")), right)
            return (right if last else rows).join(reached.where("depth > 0").select("node_id"), "node_id", "left_semi")
        covered = {"dominates": coverage.uncovered_dominates, "postDominates": coverage.uncovered_post_dominates, "sameScope": coverage.uncovered_same_scope, "sameReceiver": coverage.uncovered_same_receiver}[relation]
        if not last:
            raise RuleError(f"{relation} selects its second family")
        return right.join(covered(right, rows).select("node_id"), "node_id", "left_anti")


def active(rules: list[Rule], profile: str) -> list[Rule]:
    """Rules that ask for no profile, or for this one."""
    return [r for r in rules if not r.profiles or profile in r.profiles]


def needed_concepts(rules: list[Rule], ontology: Ontology) -> set[str]:
    """All concepts that the rules can look at, those in conditions and solver calls included; bindings to others need not be evaluated."""
    names = {e.concept for r in rules for e in r.ends} | {c for r in rules for _, c in r.unless}
    todo = [x for r in rules for x in [*r.where, *(s.where for s in r.steps if s.where is not None)]]
    while todo:
        x = todo.pop()
        if isinstance(x, (Op, Call)):
            todo += x.args
        elif isinstance(x, Ref):
            names.add(x.name)
        elif isinstance(x, list):
            todo += x
    known = {ontology.canonical(n) for n in names} & set(ontology.concepts) | {n for n in names if n not in ontology.concepts and "." not in n and n}
    return {d for n in known for d in ontology.descendants(n)}


def pruned(graph: Graph, rules: list[Rule], ontology: Ontology) -> Graph:
    """The graph with the labels that the rules can look at; the concepts are a filter that reaches the scan, or picks its partitions."""
    return replace(graph, labels=graph.labels.where(F.col("concept").isin(*sorted(needed_concepts(rules, ontology)))))
