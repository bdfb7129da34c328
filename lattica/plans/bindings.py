"""Bindings as text: what they select, what they emit, and what a module must have for them.

    binding query {
      call "db.session.execute"
      param "request.args"
      emits Sink confidence high
      requires { language(python) any(import(db), dependency("db", ">=2,<3")) not(framework(safe)) soft(file("settings")) }
    }

A requirement is a primitive of a name (a dependency's second argument is a
version specifier; project.has names a concept that other bindings emit), or
all, any, not or soft of requirements. Before anything runs it is turned into
clauses that must all hold, each of literals of which one must.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from .lang import Parser, RuleError

FAMILIES = ("call", "memberAccess", "assignment", "binaryExpr", "literal", "stringLiteral", "function", "class", "import", "route", "config", "param")
PRIMITIVES = ("language", "dependency", "import", "file", "framework", "schema", "project.has", "content")
#: What other bindings emit.
EMITTED = "project.has"
#: Clauses that one requirement may be turned into.
MOST = 256

#: (kind, name, version specifier), and whether it must be absent.
Leaf = tuple[str, str, str]
Literal = tuple[Leaf, bool]


@dataclass
class Binding:
    name: str
    selectors: list[tuple[str, str]] = field(default_factory=list)
    emits: str = ""
    confidence: str = "high"
    clauses: list[frozenset[Literal]] = field(default_factory=list)
    soft: list[frozenset[Literal]] = field(default_factory=list)

    def needs(self) -> list[tuple[str, bool]]:
        """Concepts of other bindings that it looks at, and whether their absence (or a soft view of them) matters."""
        hard = [(leaf[1], absent) for c in self.clauses for leaf, absent in c if leaf[0] == EMITTED]
        return hard + [(leaf[1], True) for c in self.soft for leaf, _ in c if leaf[0] == EMITTED]


class BindingParser(Parser):
    def bindings(self) -> list[Binding]:
        out = []
        while self.at < len(self.tokens):
            self.take("binding")
            b = Binding(self.word())
            self.take("{")
            while not self.accept("}"):
                head = self.word()
                if head in FAMILIES:
                    b.selectors.append((head, self.take().text))
                elif head == "emits":
                    b.emits = self.word()
                    if self.accept("confidence"):
                        b.confidence = self.word()
                elif head == "requires":
                    self.take("{")
                    while not self.accept("}"):
                        soft, clauses = self.requirement()
                        (b.soft if soft else b.clauses).extend(clauses)
                        self.accept(",")
                else:
                    raise RuleError(f"binding {b.name}: no family or statement {head!r}")
            out.append(b)
        return out

    def requirement(self) -> tuple[bool, list[frozenset[Literal]]]:
        if self.accept("soft"):
            self.take("(")
            out = self.clauses(False)
            self.take(")")
            return True, out
        return False, self.clauses(False)

    def clauses(self, absent: bool) -> list[frozenset[Literal]]:
        """A requirement, or its contrary, as clauses."""
        name = self.word()
        self.take("(")
        if name in ("all", "any", "not"):
            if name == "not":
                absent, name = not absent, "all"
            parts = []
            while not self.accept(")"):
                parts.append(self.clauses(absent))
                self.accept(",")
            if not parts:
                raise RuleError("a combinator of nothing")
            # the contrary of all is any of the contraries
            return [c for p in parts for c in p] if (name == "all") != absent else self.either(parts)
        if name not in PRIMITIVES:
            raise RuleError(f"unknown requirement {name!r}")
        value = self.take().text
        more = self.take().text if self.accept(",") else ""
        if more and name != "dependency":
            raise RuleError(f"{name} takes one argument")
        self.take(")")
        return [frozenset({((name, value, more), absent)})]

    @staticmethod
    def either(parts: list[list[frozenset[Literal]]]) -> list[frozenset[Literal]]:
        out = [frozenset().union(*choice) for choice in product(*parts)]
        if len(out) > MOST:
            raise RuleError(f"a requirement of {len(out)} clauses")
        return out


def parse(text: str) -> list[Binding]:
    return BindingParser(text).bindings()


def strata(bindings: list[Binding]) -> list[list[Binding]]:
    """Bindings in the order in which they can be decided: what is asked to be absent is complete before."""
    level = {b.name: 0 for b in bindings}
    emitters: dict[str, list[str]] = {}
    for b in bindings:
        emitters.setdefault(b.emits, []).append(b.name)
    for _ in range(len(bindings) + 1):
        before = dict(level)
        for b in bindings:
            for concept, absent in b.needs():
                for e in emitters.get(concept, ()):
                    level[b.name] = max(level[b.name], level[e] + absent)
        if level == before:
            break
    else:
        raise RuleError("a binding asks for the absence of what it leads to")
    return [[b for b in bindings if level[b.name] == k] for k in range(max(level.values(), default=-1) + 1) if any(level[b.name] == k for b in bindings)]


def needed(bindings: list[Binding], concepts: set[str]) -> list[Binding]:
    """The bindings that emit one of the concepts, and those that they look at; the others need not be evaluated."""
    wanted, out = set(concepts), []
    while more := [b for b in bindings if b.emits in wanted and b not in out]:
        out += more
        wanted |= {c for b in more for c, _ in b.needs()}
    return [b for b in bindings if b in out]
