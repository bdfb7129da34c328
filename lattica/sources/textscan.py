"""Line rules over texts: secrets in assignments, configuration lines, manifests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class TextPattern:
    """A direct pattern, or an assignment whose value (group 1) is neither excluded nor too plain."""

    concept: str
    direct: str = ""
    assignment: str = ""
    excluded_values: tuple[str, ...] = ()
    excluded_prefixes: tuple[str, ...] = ()
    excluded_parts: tuple[str, ...] = ()
    min_classes: int = 0
    min_length: int = 0

    def matches(self, line: Column) -> Column:
        if self.direct:
            return S.sure(line.rlike(self.direct))
        value = F.regexp_extract(line, self.assignment, 1)
        keep = (value != "") & (F.length(value) >= self.min_length) & (S.char_classes(value) >= self.min_classes)
        if self.excluded_values:
            keep &= ~F.lower(value).isin(*self.excluded_values)
        for p in self.excluded_prefixes:
            keep &= ~F.startswith(value, F.lit(p))
        for p in self.excluded_parts:
            keep &= F.instr(F.lower(value), p) == 0
        return S.sure(keep)


def scan_lines(lines: DataFrame, patterns: list[TextPattern]) -> DataFrame:
    """The columns of ``lines`` (one is ``line``) and the concept of each pattern that a line fits; one pass over the lines."""
    found = F.filter(F.array(*(F.when(p.matches(F.col("line")), F.lit(p.concept)) for p in patterns)), lambda c: c.isNotNull())
    return lines.withColumn("concept", F.explode(F.array_distinct(found)))


@dataclass(frozen=True)
class LineRule:
    """kind: contains, prefix, compact (white space ignored), directive (key, then value) or file_all (every part somewhere in the text)."""

    concept: str
    kind: str
    value: str = ""
    parts: tuple[str, ...] = field(default=())

    def matches(self, line: Column) -> Column:
        trimmed = F.trim(line)
        if self.kind == "contains":
            return F.instr(line, self.value) > 0
        if self.kind == "prefix":
            return F.startswith(trimmed, F.lit(self.value))
        if self.kind == "compact":
            return F.instr(F.regexp_replace(line, r"\s+", ""), self.value) > 0
        if self.kind == "directive":
            key, _, value = self.value.partition("=")
            return (F.regexp_extract(trimmed, r"^([^\s=:]+)", 1) == key) & (F.regexp_extract(trimmed, r"^[^\s=:]+\s*[\s=:]\s*(.*)$", 1) == value)
        raise ValueError(self.kind)


def config_lines(lines: DataFrame, rules: list[LineRule]) -> DataFrame:
    found = F.filter(F.array(*(F.when(S.sure(r.matches(F.col("line"))), F.lit(r.concept)) for r in rules)), lambda c: c.isNotNull())
    return lines.withColumn("concept", F.explode(F.array_distinct(found)))


def files_with_all(texts: DataFrame, column: str, rule: LineRule) -> DataFrame:
    keep = F.lit(True)
    for p in rule.parts:
        keep &= F.instr(S.text(column), p) > 0
    return texts.where(keep)


def not_binary(column: str) -> Column:
    return F.instr(S.text(column), "\x00") == 0


def properties(lines: DataFrame, key: str) -> DataFrame:
    """(key, name, value) of ``name=value`` or ``name: value`` lines; the last of a name wins; # and ! begin comments."""
    pairs = lines.select(key, "line_no", F.regexp_extract("line", r"^\s*([^\s=:#!][^=:]*?)\s*[=:]\s*(.*?)\s*$", 1).alias("name"), F.regexp_extract("line", r"^\s*([^\s=:#!][^=:]*?)\s*[=:]\s*(.*?)\s*$", 2).alias("value")).where("name <> ''")
    return pairs.groupBy(key, "name").agg(F.max_by("value", "line_no").alias("value"))


def requirements(lines: DataFrame) -> DataFrame:
    """(name, specifier) of requirement lines; options and comments are no packages; a bare name allows every version."""
    line = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    name = F.regexp_extract(line, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(F.substring_index(line, ";", 1), r"^[A-Za-z0-9][A-Za-z0-9._-]*(\[[^\]]*\])?", ""), r"\s+", "")
    return lines.withColumn("name", S.normalize_package(name)).withColumn("specifier", F.when(rest == "", "*").otherwise(rest)).where("name <> ''").drop("line")


def lock_packages(texts: DataFrame, column: str) -> DataFrame:
    """(name, specifier) of the ``dependencies`` object of JSON manifests."""
    deps = F.from_json(F.get_json_object(column, "$.dependencies"), "map<string,string>")
    return texts.select(F.explode(F.map_entries(deps)).alias("e")).select(S.normalize_package(F.col("e.key")).alias("name"), F.col("e.value").alias("specifier"))


#: Extensions and the language they are read as.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rb": "ruby", "php": "php", "cs": "csharp", "rs": "rust", "kt": "kotlin", "scala": "scala", "swift": "swift", "sh": "bash", "yaml": "config", "yml": "config", "tf": "config", "json": "config", "html": "config"}


def route(path: Column, content: Column | None = None) -> Column:
    """The language of a file by its extension, else by its first line's interpreter; empty if none fits."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_ext = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[ext]
    base = F.element_at(F.split(path, "/"), -1)
    by_name = F.when(base.isin("Dockerfile", "Makefile"), "config")
    out = F.coalesce(by_ext, by_name)
    if content is not None:
        shebang = F.regexp_extract(S.text(content), r"^#![^\n]*?\b(python|node|ruby|php|bash|perl|sh)\d*\b", 1)
        out = F.coalesce(out, F.when(shebang == "node", "javascript").when(shebang == "sh", "bash").when(shebang != "", shebang))
    return F.coalesce(out, F.lit(""))


def keep_path(path: Column, excluded: list[str]) -> Column:
    """No whole segment of the path is excluded."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, excluded)))


def read_files(spark, root: str, glob: str = "*") -> DataFrame:
    """(path, content) of a tree of text files, without vendored and minified ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.where(keep_path(F.col("path"), ["node_modules", "vendor", ".git"]) & ~F.col("path").rlike(r"\.min\.(js|css)$")).select("path", F.decode("content", "UTF-8").alias("content")).where(not_binary("content"))
