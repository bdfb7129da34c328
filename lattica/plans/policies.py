"""Declared policies: how findings are scored, banded and made less sure, as Columns.

    policy priority default {
      score severity { critical: 4 high: 3 default: 1 }
      factor exposure { when context.internetReachable weight: 2 }
      bands: [ { band: "P0", min: 8 }, { band: "P1", min: 0 } ]
    }
    policy confidence default {
      values: [low, medium, high]
      softRequirement missing: downgrade(1)
      softRequirement unknown: downgrade(1) annotate("uninspected evidence")
    }

A factor's condition is an expression of the rule language over columns; a
dotted name is the column of that name with underscores (context_internetReachable)
or a field of a struct column of its first part. A column that is missing or
null does not hold. Other statements of a policy are kept as they were written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .lang import Call, Op, Parser, Ref, RuleError


@dataclass
class Policy:
    kind: str
    name: str
    scores: dict[str, dict[str, int]] = field(default_factory=dict)
    factors: dict[str, tuple[object, int]] = field(default_factory=dict)
    soft: dict[str, tuple[int, str]] = field(default_factory=dict)
    other: dict[str, object] = field(default_factory=dict)

    @property
    def bands(self) -> list[tuple[int, str]]:
        """(least total, band), from the highest."""
        return sorted(((b["min"], b["band"]) for b in self.other.get("bands", ())), reverse=True)


class PolicyParser(Parser):
    def policies(self) -> dict[str, Policy]:
        """By kind; of a kind the last one counts."""
        out = {}
        while self.at < len(self.tokens):
            if self.take("module", "policy").text == "module":
                self.word()
                self.take(";")
                continue
            p = Policy(self.word(), self.word())
            self.take("{")
            while not self.accept("}"):
                self.statement(p)
            out[p.kind] = p
        return out

    def statement(self, p: Policy) -> None:
        head = self.word()
        if head == "score":
            column = self.word()
            p.scores[column] = {k: self.number(v) for k, v in self.block().items()}
        elif head == "factor":
            name = self.word()
            self.take("{")
            self.take("when")
            condition = self.expression()
            self.take("weight")
            self.take(":")
            p.factors[name] = (condition, self.signed())
            self.take("}")
        elif head == "softRequirement":
            state = self.word()
            self.take(":")
            p.soft[state] = self.softening()
        else:
            self.take(":")
            p.other[head] = self.list_of_blocks() if self.peek() == "[" and self.peek(1) == "{" else self.value() if self.peek() == "[" else self.expression()

    def softening(self) -> tuple[int, str]:
        less, note = 0, ""
        if self.accept("keep"):
            return less, note
        while self.peek() in ("downgrade", "annotate"):
            what = self.word()
            self.take("(")
            arg = self.take()
            less, note = (int(arg.text), note) if what == "downgrade" else (less, arg.text)
            self.take(")")
        return less, note

    def list_of_blocks(self) -> list[dict]:
        self.take("[")
        out = []
        while not self.accept("]"):
            out.append({k: v for k, v in self.block().items()})
            self.accept(",")
        return out

    def signed(self) -> int:
        negative = self.accept("-")
        t = self.take()
        return self.number(t.text) * (-1 if negative else 1)

    @staticmethod
    def number(value) -> int:
        try:
            return int(value)
        except (TypeError, ValueError):
            raise RuleError(f"{value!r} is no number") from None


def parse(text: str) -> dict[str, Policy]:
    return PolicyParser(text).policies()


# ---- to columns


def reference(name: str, rows: DataFrame) -> Column:
    """A dotted name: a column with underscores for dots, a field of a struct column, or the last part alone; null where there is none."""
    first, _, rest = name.partition(".")
    flat, last = name.replace(".", "_"), name.rsplit(".", 1)[-1]
    if flat in rows.columns:
        return F.col(flat)
    if rest and first in rows.columns and rest.split(".")[0] in getattr(rows.schema[first].dataType, "names", ()):
        return F.col(first)[rest]
    return F.col(last) if last in rows.columns else F.lit(None)


def condition(x, rows: DataFrame) -> Column:
    """A condition as a boolean that is never null."""
    if isinstance(x, Op) and x.name in ("and", "or"):
        a, b = (condition(y, rows) for y in x.args)
        return a & b if x.name == "and" else a | b
    if isinstance(x, Op) and x.name == "not":
        return ~condition(x.args[0], rows)
    if isinstance(x, Op) and len(x.args) == 2:
        left, right = x.args
        value = (reference(left.name, rows) if isinstance(left, Ref) else F.lit(left)).cast("string")
        if isinstance(right, list):
            found = S.text(value).isin(*map(str, right))
            return found if x.name == "in" else ~found
        if isinstance(right, int) and not isinstance(right, bool):
            return S.compare_int(value, x.name, right)
        want = str(right.name if isinstance(right, Ref) else right)
        if x.name in ("==", "is"):
            return S.text(value) == want
        if x.name == "!=":
            return S.text(value) != want
    if isinstance(x, Ref):
        return S.sure(reference(x.name, rows).cast("boolean"))
    if isinstance(x, bool):
        return F.lit(x)
    raise RuleError(f"{x.name if isinstance(x, (Op, Call)) else x!r} has no meaning in a policy's condition")


def prioritise(findings: DataFrame, policy: Policy) -> DataFrame:
    """With total, band and factors: the scores, the weights of the factors that hold, the band, and the names of these factors."""
    total = F.lit(0)
    for column, scores in policy.scores.items():
        value = reference(column, findings).cast("string")
        score = F.lit(scores.get("default", 0))
        for name, n in scores.items():
            if name != "default":
                score = F.when(S.text(value) == name, n).otherwise(score)
        total = total + score
    holds = {n: condition(c, findings) for n, (c, _) in policy.factors.items()}
    for n, (_, weight) in policy.factors.items():
        total = total + F.when(holds[n], weight).otherwise(0)
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in holds.items()))) if holds else F.array().cast("array<string>")
    band = F.lit(policy.bands[-1][1] if policy.bands else "")
    for least, name in reversed(policy.bands):
        band = F.when(F.col("total") >= least, name).otherwise(band)
    return findings.withColumn("total", total).withColumn("factors", names).withColumn("band", band)


def soften(findings: DataFrame, policy: Policy, state: str = "requirement_state") -> DataFrame:
    """confidence lowered and note set by the state of a finding's soft requirement; the lowest value stays, as does an unknown state's."""
    values = [str(v) for v in policy.other["values"]]
    place = F.array_position(F.array(*map(F.lit, values)), F.col("confidence"))
    less, note = F.lit(0), F.lit("")
    for name, (n, said) in policy.soft.items():
        less, note = F.when(F.col(state) == name, n).otherwise(less), F.when(F.col(state) == name, said).otherwise(note)
    lower = F.element_at(F.array(*map(F.lit, values)), F.greatest(place - less, F.lit(1)).cast("int"))
    return findings.withColumn("confidence", F.when(S.sure(place > 0), lower).otherwise(F.col("confidence"))).withColumn("note", note)


#: Weights, bands and steps of the policies that users of the language know.
CORE = """
policy confidence default {
  values: [low, medium, high]
  order: [low, medium, high]
  softRequirement missing: downgrade(1)
  softRequirement unknown: downgrade(1) annotate("uninspected evidence")
  softRequirement conflicting: downgrade(1) annotate("conflicting evidence")
  softRequirement satisfied: keep
}
policy priority default {
  score severity { critical: 4 high: 3 medium: 2 low: 1 info: 0 default: 1 }
  factor exposure { when context.internetReachable weight: 2 }
  factor runtimeExposure { when context.internetReachable and context.runtimeConfirmed weight: 3 }
  factor assetProximity { when context.holdsAsset weight: 2 }
  factor exploitLikelihood { when finding.exploitSignal weight: 1 }
  factor controlPressure { when finding.nearMissControl weight: -1 }
  factor confidenceLow { when finding.confidence == low weight: -2 }
  factor confidenceMedium { when finding.confidence == medium weight: -1 }
  bands: [ { band: "P0", min: 8 }, { band: "P1", min: 6 }, { band: "P2", min: 4 }, { band: "P3", min: 2 }, { band: "P4", min: 0 } ]
}
"""
#: What findings.priority uses where no policy is given.
BUILTIN = """
policy priority builtin {
  score severity { critical: 4 high: 3 medium: 2 low: 1 default: 0 }
  bands: [ { band: "P1", min: 7 }, { band: "P2", min: 5 }, { band: "P3", min: 3 }, { band: "P4", min: 0 } ]
}
"""
