"""Definitions as data: rule files of a folder, filters over them, and checks of command-line names."""

from __future__ import annotations

import difflib
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lang

_SIZES = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "KIB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "MIB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "GIB": 1 << 30, "T": 1 << 40, "TB": 1 << 40, "TIB": 1 << 40}


def load(folder: str, suffix: str = ".rules") -> list[lang.Module]:
    """All rule files below a folder, by name. Definitions are plans, not data: the driver reads them."""
    return [lang.parse(p.read_text(encoding="utf-8")) for p in sorted(Path(folder).rglob(f"*{suffix}"))]


def table(spark: SparkSession, modules: list[lang.Module]) -> DataFrame:
    """(kind, name, module, detail) of concepts and rules."""
    rows = [("concept", c.name, m.name, c.kind) for m in modules for c in m.concepts] + [("rule", r.name, m.name, f"{r.id} {r.verb} {r.meta.get('severity', 'info')}") for m in modules for r in m.rules]
    return spark.createDataFrame(rows, "kind string, name string, module string, detail string")


def find(definitions: DataFrame, kind: str = "", text: str = "", most: int = 0) -> DataFrame:
    """Filters by kind and by a part of the name or detail, in order; ``most`` rows, 0 for all."""
    out = definitions
    if kind:
        out = out.where(F.col("kind") == kind)
    if text:
        out = out.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("detail"), F.lit(text.lower())))
    out = out.orderBy("kind", "module", "name")
    return out.limit(most) if most else out


def references(modules: list[lang.Module], concept: str) -> list[str]:
    """Rules that name a concept."""
    return sorted(f"{m.name}.{r.name}" for m in modules for r in m.rules if concept in {e.concept for e in r.ends} | {c for _, c in r.unless})


def lint(modules: list[lang.Module]) -> list[str]:
    known = lang.ontology(*modules)
    return [w for m in modules for w in lang.check(m, known)]


def known_concepts(wanted: list[str], ontology: lang.Ontology) -> list[str]:
    """The concepts that have a wanted part in their names; a part that none has is an error that names near ones."""
    out = set()
    for part in wanted:
        hits = {n for n in ontology.concepts if part.lower() in n.lower()}
        if not hits:
            near = difflib.get_close_matches(part, ontology.concepts, 3, 0.4)
            raise lang.RuleError(f"no concept has {part!r} in its name" + (f"; near: {', '.join(near)}" if near else ""))
        out |= hits
    return sorted(out)


def parse_bytes(text: str) -> int:
    """Bytes of a size such as 512, 4K, 1.5 GiB."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in _SIZES:
        raise ValueError(f"{text!r} is no size")
    return int(float(m[1]) * _SIZES[m[2].upper()])
