"""Regular expressions as data: which backtrack badly, and which characters a class holds."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # before 3.11
    import sre_constants as _c
    import sre_parse as _parser

#: Characters that classes are expanded over.
ALPHABET = "".join(map(chr, range(32, 127)))
_CATEGORIES = {_c.CATEGORY_DIGIT: r"\d", _c.CATEGORY_NOT_DIGIT: r"\D", _c.CATEGORY_WORD: r"\w", _c.CATEGORY_NOT_WORD: r"\W", _c.CATEGORY_SPACE: r"\s", _c.CATEGORY_NOT_SPACE: r"\S"}


def class_chars(pattern: str) -> str:
    """The printable ASCII characters that a one-character pattern (such as ``[^a-z]``) matches; empty if it is none."""
    try:
        p = re.compile(pattern, re.ASCII)
        return "".join(c for c in ALPHABET if p.fullmatch(c))
    except re.error:
        return ""


def strip_delimiters(literal: str) -> tuple[str, str]:
    """(pattern, flags) of ``/pattern/flags`` and the like; a bare pattern has no flags."""
    m = re.fullmatch(r"([/#~!@])(.*)\1([a-zA-Z]*)", literal, re.S)
    return (m[2], m[3]) if m else (literal, "")


def _first(items) -> frozenset:
    """Characters that a sequence can begin with."""
    out: frozenset = frozenset()
    for op, arg in items:
        chars, empty = _single(op, arg)
        out |= chars
        if not empty:
            break
    return out


def _set(members) -> frozenset:
    negate, out = False, set()
    for op, arg in members:
        if op is _c.NEGATE:
            negate = True
        elif op is _c.LITERAL:
            out.add(chr(arg))
        elif op is _c.RANGE:
            out.update(c for c in ALPHABET if arg[0] <= ord(c) <= arg[1])
        elif op is _c.CATEGORY and arg in _CATEGORIES:
            out.update(class_chars(_CATEGORIES[arg]))
    return frozenset(ALPHABET) - out if negate else frozenset(out)


def _single(op, arg) -> tuple[frozenset, bool]:
    """(characters that an item can begin with, whether it can be empty)."""
    if op is _c.LITERAL:
        return frozenset(chr(arg)), False
    if op is _c.NOT_LITERAL:
        return frozenset(ALPHABET) - {chr(arg)}, False
    if op is _c.ANY:
        return frozenset(ALPHABET), False
    if op is _c.IN:
        return _set(arg), False
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        return _first(arg[2]), arg[0] == 0 or _empty(arg[2])
    if op is _c.SUBPATTERN:
        return _first(arg[-1]), _empty(arg[-1])
    if op is _c.BRANCH:
        return frozenset().union(*(_first(b) for b in arg[1])), any(_empty(b) for b in arg[1])
    return frozenset(), True


def _empty(items) -> bool:
    return all(_single(op, arg)[1] for op, arg in items)


def _unbounded(op, arg) -> bool:
    return op is _c.MAX_REPEAT and arg[1] is _c.MAXREPEAT or op is _c.MIN_REPEAT and arg[1] is _c.MAXREPEAT


def _inner(items):
    """An item's contents, without the groups around them."""
    items = list(items)
    while len(items) == 1 and items[0][0] is _c.SUBPATTERN:
        items = list(items[0][1][-1])
    return items


def ambiguous(pattern: str) -> bool:
    """Whether some text can be matched in exponentially or polynomially many ways.

    That is so where a repetition holds one that can begin with the same
    characters, or alternatives that can; and where two repetitions that can
    share characters follow each other with nothing required between.
    """
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return _walk(list(tree))


def _walk(items) -> bool:
    flat = [x for op, arg in items for x in (_inner([(op, arg)]) if op is _c.SUBPATTERN else [(op, arg)])]
    running: frozenset | None = None
    for op, arg in flat:
        if _unbounded(op, arg):
            chars, body = _first(arg[2]), _inner(arg[2])
            if running is not None and running & chars:
                return True
            running = chars if running is None else running | chars
            if any(_unbounded(o, a) for o, a in body) and all(_unbounded(o, a) or _single(o, a)[1] or _single(o, a)[0] & chars for o, a in body):
                return True
            for o, a in body:
                if o is _c.BRANCH:
                    firsts = [_first(b) for b in a[1]]
                    if any(firsts[i] & firsts[j] for i in range(len(firsts)) for j in range(i)):
                        return True
            if _walk(body):
                return True
        else:
            if not _single(op, arg)[1]:
                running = None
            if op is _c.BRANCH and any(_walk(list(b)) for b in arg[1]):
                return True
            if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and _walk(list(arg[2])):
                return True
    return False


def ambiguous_column(pattern):
    """A boolean Column; apply it to distinct patterns."""

    @F.pandas_udf("boolean")
    def run(p):
        return p.map(lambda x: x is not None and ambiguous(x))

    return run(pattern)


def class_chars_column(pattern):
    @F.pandas_udf("string")
    def run(p):
        return p.map(lambda x: "" if x is None else class_chars(x))

    return run(pattern)
