"""Dependency manifests as DataFrame rules over lines and JSON columns: (key, name, version).

``lines``: key, line_no, line (views.text_lines). What a line means depends on
those before it (a section, a block); that is a running value over a file's
lines, a window partitioned by the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

_OPERATORS = r"(==|>=|<=|~=|!=|>|<|=)"


def _strip(text) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _running(key: str):
    return Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def split_requirement(line: Column) -> tuple[Column, Column]:
    """Name and specifier of ``name>=1``; a bare name allows every version. Operators are looked for in a fixed order, wherever they stand."""
    name, version = line, F.lit("*")
    for op in reversed(("==", ">=", "<=", "~=", "!=", ">", "<", "=")):
        at = F.instr(line, op)
        name = F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(name)
        version = F.when(at > 0, F.concat(F.lit(op), _strip(F.substring(line, at + len(op), F.length(line))))).otherwise(version)
    return S.normalize_package(name), version


def go_mod(lines: DataFrame, key: str) -> DataFrame:
    """``require`` lines and blocks of go.mod; replace and exclude are no dependencies."""
    text = _strip(F.substring_index("line", "//", 1))
    rows = lines.withColumn("text", text).where("text <> ''")
    opens = F.when(F.col("text") == "require (", F.lit(True)).when(F.col("text") == ")", F.lit(False)).when(F.col("text").rlike(r"\($"), F.lit(False))
    inside = F.coalesce(F.last(opens, ignorenulls=True).over(_running(key)), F.lit(False))
    rows = rows.withColumn("inside", inside).where("text <> 'require (' and text <> ')'")
    rest = F.when(F.col("inside"), F.col("text")).when(F.startswith("text", F.lit("require ")), _strip(F.substring("text", 9, 1 << 20)))
    fields = F.transform(F.filter(F.split(rest, r"\s+"), lambda x: x != ""), lambda x: F.regexp_replace(x, '^"+|"+$', ""))
    rows = rows.withColumn("f", fields).where("f is not null and size(f) >= 2").select(key, F.get("f", F.lit(0)).alias("raw"), F.get("f", F.lit(1)).alias("version"))
    return rows.where("raw <> '' and version <> '' and not contains(raw, '=>') and not contains(version, '=>')").select(key, S.normalize_package("raw").alias("name"), "version")


def setup_cfg(lines: DataFrame, key: str) -> DataFrame:
    """``install_requires`` of the [options] section: its own line and the indented ones after it."""
    rows = lines.withColumn("text", _strip("line")).where("text <> '' and not startswith(text, '#')")
    section = F.when(F.col("text").rlike(r"^\[.*\]$"), F.lower("text"))
    indented = F.col("line").rlike(r"^[ \t]")
    entry = F.col("text").rlike(r"(?i)^install_requires\s*=")
    state = F.when(F.col("text").rlike(r"^\[.*\]$"), F.lit(False)).when(entry, F.lit(True)).when(~indented, F.lit(False))
    rows = rows.withColumn("section", F.last(section, ignorenulls=True).over(_running(key))).withColumn("on", F.coalesce(F.last(state, ignorenulls=True).over(_running(key)), F.lit(False)))
    rows = rows.where("section = '[options]' and on and not startswith(text, '[')").withColumn("entry", entry)
    value = F.when(F.col("entry"), _strip(F.regexp_replace("text", r"(?i)^install_requires\s*=", ""))).otherwise(F.col("text"))
    name, version = split_requirement(F.col("value"))
    return rows.select(key, value.alias("value")).where("value <> ''").select(key, name.alias("name"), version.alias("version"))


def normalize_version(version: Column) -> Column:
    """A range as one version: without its prefix, the first of several; * for all and latest."""
    v = F.regexp_replace(_strip(version), r"^[\^~>=< v]+", "")
    return F.when((v == "") | (F.lower(v) == "latest") | F.contains(v, F.lit("*")), "*").otherwise(F.regexp_extract(v, r"^([^ |,;]*)", 1))


def package_json(texts: DataFrame, key: str, column: str) -> DataFrame:
    """dependencies and devDependencies; a text that is no JSON has none."""
    maps = [F.map_entries(F.from_json(F.get_json_object(column, f"$.{k}"), "map<string,string>")) for k in ("dependencies", "devDependencies")]
    each = F.flatten(F.array_compact(F.array(*maps)))
    return texts.select(key, F.explode(each).alias("e")).select(key, S.normalize_package(F.col("e.key")).alias("name"), normalize_version(F.coalesce(F.col("e.value"), F.lit(""))).alias("version"))


def composer_lock(texts: DataFrame, key: str, column: str) -> DataFrame:
    """The pinned packages of a lock file, those for development included."""
    lists = [F.from_json(F.get_json_object(column, f"$.{k}"), "array<struct<name:string,version:string>>") for k in ("packages", "packages-dev")]
    rows = texts.select(key, F.explode(F.flatten(F.array_compact(F.array(*lists)))).alias("p"))
    return rows.select(key, S.normalize_package(F.col("p.name")).alias("name"), F.coalesce(F.nullif(_strip(F.col("p.version")), F.lit("")), F.lit("*")).alias("version")).where("name <> ''")


def git_name(url: Column) -> Column:
    """host/path of a repository's address."""
    u = F.regexp_replace(_strip(F.regexp_replace(url, r"\.git$", "")), "^(https://)?(http://)?(ssh://)?", "")
    return F.when(F.startswith(u, F.lit("git@")), F.regexp_replace(F.substring(u, 5, 1 << 20), "^([^:]*):", "$1/")).otherwise(u)


def cargo_lock_git(lines: DataFrame, key: str) -> DataFrame:
    """Packages whose last source is a git address with a revision."""
    rows = lines.withColumn("text", _strip("line"))
    block = F.sum((F.col("text") == "[[package]]").cast("int")).over(_running(key))
    source = F.regexp_extract("text", r"""^source\s*=\s*["'](.*)["']$""", 1)
    rows = rows.withColumn("block", block).withColumn("source", source).where("source <> ''")
    last = rows.groupBy(key, "block").agg(F.max_by("source", "line_no").alias("source")).where("startswith(source, 'git+') and contains(source, '#')")
    url, revision = F.substring_index(F.substring("source", 5, 1 << 20), "#", 1), _strip(F.regexp_extract("source", "#(.*)$", 1))
    return last.select(key, S.normalize_package(git_name(url)).alias("name"), revision.alias("version")).where("name <> '' and version <> ''")


def gitmodules(lines: DataFrame, key: str, commits: DataFrame) -> DataFrame:
    """Submodules with the commits of their paths. ``commits``: key, path, commit."""
    rows = lines.withColumn("text", _strip("line")).where("text <> '' and not startswith(text, '#')")
    block = F.sum(F.startswith("text", F.lit("[")).cast("int")).over(_running(key))
    pair = lambda k: F.when(F.col("text").rlike(f"^{k}\\s*="), _strip(F.regexp_replace("text", f"^{k}\\s*=", "")))
    rows = rows.withColumn("block", block).select(key, "block", "line_no", pair("path").alias("path"), pair("url").alias("url"))
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    whole = rows.groupBy(key, "block").agg(at("path"), at("url")).where("path <> '' and url <> ''")
    pins = commits.where("commit <> ''").select(F.col(key).alias("c_key"), F.col("path").alias("c_path"), "commit")
    met = whole.join(pins, (F.col(key) == F.col("c_key")) & (F.col("path") == F.col("c_path")))
    return met.select(key, S.normalize_package(git_name(F.col("url"))).alias("name"), F.col("commit").alias("version")).where("name <> ''")


def npmrc(lines: DataFrame, key: str) -> DataFrame:
    """The runtime that a file pins: brave_electron_version, else target, where the runtime is electron."""
    text = _strip(F.substring_index("line", "#", 1))
    rows = lines.withColumn("text", text).where("contains(text, '=') and not startswith(text, ';')")
    rows = rows.select(key, "line_no", F.lower(_strip(F.substring_index("text", "=", 1))).alias("k"), _strip(F.regexp_replace("text", "^[^=]*=", "")).alias("v")).where("k <> '' and v <> ''")
    of = lambda k: F.max_by("v", F.when(F.col("k") == k, F.col("line_no"))).alias(k)
    whole = rows.where(F.col("k").isin("runtime", "brave_electron_version", "target")).groupBy(key).agg(of("runtime"), of("brave_electron_version"), of("target"))
    return whole.where("lower(runtime) = 'electron'").select(key, F.lit("brave/electron").alias("name"), F.coalesce("brave_electron_version", "target").alias("version")).where("version is not null")


def setup_py(texts: DataFrame, key: str, column: str) -> DataFrame:
    """The quoted requirements of literal install_requires lists and tuples; nothing is executed."""
    body = r"""\binstall_requires\s*=\s*[\[(]((?:[^\])"']|"[^"]*"|'[^']*')*)[\])]"""
    bodies = texts.select(key, F.explode(F.regexp_extract_all(S.text(column), F.lit(body), 1)).alias("body"))
    quoted = bodies.select(key, F.explode(F.regexp_extract_all("body", F.lit(r"""("[^"]*"|'[^']*')"""), 1)).alias("q")).select(key, _strip(F.expr("substring(q, 2, length(q) - 2)")).alias("value"))
    name, version = split_requirement(F.col("value"))
    return quoted.where("value <> ''").select(key, name.alias("name"), version.alias("version"))
