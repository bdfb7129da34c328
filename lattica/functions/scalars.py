"""Scalar functions as Column expressions. Absent strings are empty, and predicates are never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sure(predicate: Column) -> Column:
    """Null is false."""
    return F.coalesce(predicate, F.lit(False))


def text(x) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def prop(name: str, props="props", inline: Column | None = None) -> Column:
    """A property: the inline column if it has a value, else the map's, else empty."""
    found = F.element_at(_c(props), F.lit(name))
    return F.coalesce(F.nullif(inline, F.lit("")), found, F.lit("")) if inline is not None else F.coalesce(found, F.lit(""))


def compare_int(value: Column, op: str, literal: int) -> Column:
    """Numeric comparison; false if the value is no integer."""
    v, lit = F.expr("NULL") if value is None else value.try_cast("int"), F.lit(literal)
    return sure({"==": v == lit, "!=": v != lit, ">=": v >= lit, "<=": v <= lit, ">": v > lit, "<": v < lit}[op])


def compare_string(value: Column, op: str, literal: str) -> Column:
    """Only == and != are defined on strings; any other operator is false."""
    v = text(value)
    return {"==": v == literal, "!=": v != literal}.get(op, F.lit(False))


# ---- locations and regions


def loc_file(loc) -> Column:
    """What precedes the last colon; empty without one."""
    return F.regexp_extract(text(loc), r"^(.+):[^:]*$", 1)


def loc_line(loc) -> Column:
    return F.regexp_extract(text(loc), r":(\d+)$", 1).try_cast("int")


def function_scope_key(scope, region) -> Column:
    """The path up to its first segment that begins with fn; what follows an @ is ignored."""
    s = F.substring_index(F.when(text(scope) != "", text(scope)).otherwise(text(region)), "@", 1)
    return F.regexp_extract(s, r"^((?:(?!fn)[^/]*/)*fn[^/]*)", 1)


def lexical_scope_key(scope, region) -> Column:
    s = F.substring_index(F.when(text(scope) != "", text(scope)).otherwise(text(region)), "@", 1)
    return F.regexp_replace(s, "/+$", "")


def scope_ancestors(key) -> Column:
    """A scope and all scopes above it, so that coverage by an ancestor is an equality join."""
    parts = F.split(_c(key), "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), lambda s: s != "")


def nearest_loop_parent(region) -> Column:
    """The region above the innermost segment that begins with loop; null without one."""
    r = text(region)
    parent = F.regexp_extract(r, r"^(.*)/loop[^/]*(?:/(?!loop)[^/]*)*$", 1)
    return F.when(r.rlike(r"(^|/)loop"), F.when(parent == "", "/").otherwise(parent))


def region_scope_chain(region) -> Column:
    """The region, and each region it hangs off as an inline body (#), the outermost last."""
    parts = F.split(text(region), "#")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "#"))


# ---- dotted names


def receiver_prefix(path) -> Column:
    return F.regexp_extract(text(path), r"^(.+)\.[^.]*$", 1)


def last_segment(path) -> Column:
    return F.element_at(F.split(text(path), r"\."), -1)


def segments_match(path, value, mode: str = "segments") -> Column:
    """The value's dotted segments stand together in the path; with mode ``contains`` any substring does."""
    if mode == "contains":
        return sure(F.contains(_c(path), _c(value)))
    return sure(F.contains(F.concat(F.lit("."), _c(path), F.lit(".")), F.concat(F.lit("."), _c(value), F.lit("."))))


def path_suffix_matches(path, value) -> Column:
    return sure((_c(path) == _c(value)) | F.endswith(_c(path), F.concat(F.lit("."), _c(value))))


def callee_key(callee_path, method, node_type) -> Column:
    """The callee's path, else its method with a dot before it, else the node's type."""
    return F.coalesce(F.nullif(_c(callee_path), F.lit("")), F.concat(F.lit("."), F.nullif(_c(method), F.lit(""))), _c(node_type))


# ---- packages and versions


def normalize_package(name) -> Column:
    """Lower case without quotes, white space and extras."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text(name), "[\"']", ""))), r"\[.*$", "")


def package_root(name) -> Column:
    """The first path segment; the first two of a scoped name."""
    n = normalize_package(name)
    return F.when(F.startswith(n, F.lit("@")), F.substring_index(n, "/", 2)).otherwise(F.substring_index(n, "/", 1))


def call_root(path) -> Column:
    """The package-shaped root of a resolved callee: what precedes the first dot or bracket, then its package root."""
    return package_root(F.regexp_extract(normalize_package(path), r"^([^.\[]*)", 1))


#: Import names that differ from the names of the packages they come from.
IMPORT_ALIASES = {
    "yaml": ["pyyaml"],
    "sklearn": ["scikit-learn"],
    "dateutil": ["python-dateutil"],
    "jwt": ["pyjwt"],
    "dotenv": ["python-dotenv"],
    "openssl": ["pyopenssl"],
    "mysqldb": ["mysqlclient"],
    "pil": ["pillow"],
    "cv2": ["opencv-python"],
    "bs4": ["beautifulsoup4"],
    "crypto": ["pycryptodome", "pycrypto"],
    "serial": ["pyserial"],
    "git": ["gitpython"],
    "attr": ["attrs"],
    "dns": ["dnspython"],
    "usb": ["pyusb"],
    "slugify": ["python-slugify"],
    "magic": ["python-magic"],
    "docx": ["python-docx"],
    "jose": ["python-jose"],
    "memcache": ["python-memcached"],
}


def import_aliases(name) -> Column:
    """The packages that an import name stands for, where they are called otherwise; else an empty array."""
    entries = F.create_map(*(x for k, v in IMPORT_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.element_at(entries, normalize_package(name)), F.array().cast("array<string>"))


def package_matches(observed, wanted) -> Column:
    """Nine ways in which evidence meets a wanted package: equal; the root of one is the other; one goes on after the other at a dot or slash; one without dots and slashes is a segment of the other's path."""
    o, w = normalize_package(observed), normalize_package(wanted)
    ahead = lambda a, b: F.startswith(a, F.concat(b, F.lit("."))) | F.startswith(a, F.concat(b, F.lit("/")))
    within = lambda path, x: F.contains(path, F.lit("/")) & ~x.rlike(r"[./]") & F.array_contains(F.split(path, "/"), x)
    some = (o == w) | (package_root(observed) == w) | (package_root(wanted) == o) | ahead(o, w) | ahead(w, o) | within(o, w) | within(w, o)
    return sure((o != "") & (w != "") & some)


def package_keys(name, wanted: bool) -> Column:
    """(way, key) pairs: evidence and a wanted package match if they share one, so that the nine ways are one equality join."""
    n = normalize_package(name)
    pair = lambda way: lambda x: F.struct(F.lit(way).alias("way"), x.alias("key"))
    single = F.when(~n.rlike(r"[./]"), F.array(n)).otherwise(F.array().cast("array<string>"))
    inner = F.filter(F.when(F.contains(n, F.lit("/")), F.split(n, "/")).otherwise(F.array().cast("array<string>")), lambda x: (x != "") & ~F.contains(x, F.lit(".")))
    above, below, of, has = (("own", "stem", "name", "segment") if wanted else ("stem", "own", "segment", "name"))
    sides = {"own": F.array(n), "stem": package_stems(name), "name": single, "segment": inner}
    ways = [("above", above), ("below", below), ("inside", of), ("around", has)]
    return F.when(n != "", F.array_distinct(F.flatten(F.array(*(F.transform(sides[k], pair(way)) for way, k in ways))))).otherwise(F.array().cast("array<struct<way:string,key:string>>"))


def package_stems(name) -> Column:
    """All prefixes at dots and slashes, so that a prefix match is an equality join."""
    n = normalize_package(name)
    cuts = F.filter(F.sequence(F.lit(1), F.length(n) + 1), lambda i: (i == F.length(n) + 1) | n.substr(i, F.lit(1)).isin(".", "/"))
    return F.array_distinct(F.filter(F.transform(cuts, lambda i: n.substr(F.lit(1), i - 1)), lambda s: s != ""))


def version_parts(version) -> Column:
    """The leading dotted integers, each up to its first other character."""
    v = F.regexp_replace(F.trim(text(version)), r"^[vV=<>!~^\s]+", "")
    return F.transform(F.split(v, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d{1,9})", 1).try_cast("int"), F.lit(0)))


def version_key(version, width: int = 6) -> Column:
    """Parts padded with zeros to one width; arrays of it compare like versions."""
    return F.slice(F.concat(version_parts(version), F.array_repeat(F.lit(0), width)), 1, width)


def compare_versions(a, b) -> Column:
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def specifier_allows(specifier, version) -> Column:
    """All clauses (separated by commas, semicolons or bars) of == = != >= > <= < ~= hold; * and empty allow all."""
    clauses = F.filter(F.transform(F.split(text(specifier), r"[,;|]"), lambda c: F.trim(c)), lambda c: (c != "") & (c != "*"))

    def holds(c: Column) -> Column:
        op = F.regexp_extract(c, r"^(==|!=|>=|<=|~=|=|>|<)?", 1)
        want, have = version_key(F.regexp_replace(c, r"^[=!<>~]+", "")), version_key(version)
        n = F.greatest(F.size(version_parts(F.regexp_replace(c, r"^[=!<>~]+", ""))) - 1, F.lit(1))
        return (
            F.when(op == "!=", have != want).when(op == ">=", have >= want).when(op == "<=", have <= want).when(op == ">", have > want).when(op == "<", have < want)
            .when(op == "~=", (have >= want) & (F.slice(have, F.lit(1), n) == F.slice(want, F.lit(1), n))).otherwise(have == want)
        )

    return sure(F.forall(clauses, holds))


def semver_satisfies(wanted, version) -> Column:
    """One of the alternatives (separated by ||) holds: all of its clauses (= >= <= > < ^ ~, separated by blanks; none is equality) on major, minor and patch; an empty one allows all."""
    have = version_key(version, 3)

    def holds(c: Column) -> Column:
        op = F.regexp_extract(c, r"^([=<>^~]*)", 1)
        want = version_key(F.regexp_replace(c, r"^[=<>^~]+", ""), 3)
        same = lambda n: F.slice(have, 1, n) == F.slice(want, 1, n)
        return (
            F.when(op.isin("", "="), have == want).when(op == ">=", have >= want).when(op == "<=", have <= want).when(op == ">", have > want).when(op == "<", have < want)
            .when(op == "^", (have >= want) & same(1)).when(op == "~", (have >= want) & same(2)).otherwise(False)
        )

    clauses = lambda alternative: F.filter(F.split(alternative, r"\s+"), lambda c: ~c.isin("", "*"))
    return sure(F.exists(F.split(text(wanted), r"\|\|"), lambda a: F.forall(clauses(a), holds)))


def edit_distance_le1(a, b) -> Column:
    return sure(F.levenshtein(_c(a), _c(b)) == 1)


def deletions(name) -> Column:
    """The name and all names with one character less: names at distance 1 share one of these."""
    n = _c(name)
    less = F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(n.substr(F.lit(1), i - 1), n.substr(i + 1, F.length(n))))
    return F.array_distinct(F.array_append(F.when(F.length(n) > 0, less).otherwise(F.array().cast("array<string>")), n))


# ---- text


def char_classes(value) -> Column:
    """How many of lower, upper, digit and other characters occur."""
    return sum((text(value).rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), F.lit(0))


def action_matches(ability, action) -> Column:
    """A granted pattern covers an action: * alone, a prefix before *, or equality; an empty action is always covered."""
    a, w = text(ability), text(action)
    prefix = F.regexp_replace(a, r"\*$", "")
    return (w == "") | (a == "*") | (F.endswith(a, F.lit("*")) & F.startswith(w, prefix)) | (a == w)


def template_vars(template) -> Column:
    return F.array_distinct(F.regexp_extract_all(text(template), F.lit(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)"), 1))


def render_label(template: str, target, kinds) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{target}"), text(target)), F.lit("{kinds}"), text(kinds))


def rank(value, names: tuple[str, ...]) -> Column:
    """1 for the first name, and so on; 0 for others."""
    out = F.lit(0)
    for i, n in enumerate(names):
        out = F.when(_c(value) == n, i + 1).otherwise(out)
    return out


def severity_level(severity) -> Column:
    s = text(severity)
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("note")


def security_severity(severity) -> Column:
    s = text(severity)
    return F.when(s == "critical", "9.5").when(s == "high", "8.0").when(s == "medium", "5.5").when(s == "low", "3.0").otherwise("0.0")


def cwe_tag(number) -> Column:
    return F.concat(F.lit("external/cwe/cwe-"), F.lpad(_c(number).cast("string"), 3, "0"))


def hash_id(*parts, width: int = 16) -> Column:
    """A prefix of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\x00", *(text(p) for p in parts)), 256), 1, width)


def map_hash(props) -> Column:
    entries = F.array_sort(F.map_entries(_c(props)))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\x00"), 256)


def fingerprint(**fields) -> Column:
    """16 digits of the SHA-256 of ``name=value|..``."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{n}="), text(v)) for n, v in fields.items())), 256), 1, 16)
