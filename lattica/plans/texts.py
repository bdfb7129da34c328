"""Text, configuration and manifest sources, and the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import report
from ..functions import scalars as S
from ..sources import manifests, textscan, views
from ..streaming import refresh
from .catalog import query
from .ranking import F_SQL, order_findings

PATTERNS = [
    textscan.TextPattern("secret.token", assignment=r"(?i)(?:key|token|secret|password)\s*[=:]\s*['\"]?([A-Za-z0-9_\-/+=]{8,})", excluded_values=("changeme",), excluded_prefixes=("${",), excluded_parts=("example",), min_classes=2, min_length=8),
    textscan.TextPattern("pii.email", direct=r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}"),
    textscan.TextPattern("secret.aws", direct=r"AKIA[0-9A-Z]{16}"),
]
L_SQL = "l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))"


@query("textpattern_scan", rf"""WITH {L_SQL}, v AS (SELECT *, regexp_extract(line, '(?i)(?:key|token|secret|password)\s*[=:]\s*[''"]?([A-Za-z0-9_\-/+=]{{8,}})', 1) AS value FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, 'secret.token' AS concept FROM v WHERE length(value) >= 8 AND lower(value) <> 'changeme' AND NOT contains(lower(value), 'example')
 AND CAST(regexp_matches(value, '[a-z]') AS INT) + CAST(regexp_matches(value, '[A-Z]') AS INT) + CAST(regexp_matches(value, '[0-9]') AS INT) + CAST(regexp_matches(value, '[^a-zA-Z0-9]') AS INT) >= 2
UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), 'pii.email' FROM l WHERE regexp_matches(line, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{{2,}}')
UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), 'secret.aws' FROM l WHERE regexp_matches(line, 'AKIA[0-9A-Z]{{16}}')""")
def _(spark, d):
    return textscan.scan_lines(views.text_lines(spark, d), PATTERNS).select("doc_id", "line_no", "concept")


@query("binary_skip", "SELECT doc_id FROM documents WHERE NOT contains(coalesce(text, ''), chr(0))")
def _(spark, d):
    return views.table(spark, d, "documents").where(textscan.not_binary("text")).select("doc_id")


@query("config_scan", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a [^>]*href')) AS INTEGER) AS links, contains(html, '<script>') AS scripts FROM pages")
def _(spark, d):
    p = views.table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<a [^>]*href")).alias("links"), S.sure(F.contains("html", F.lit("<script>"))).alias("scripts"))


RULES = [textscan.LineRule("shout", "contains", "!!"), textscan.LineRule("article", "prefix", "The "), textscan.LineRule("joined", "compact", "ofthe")]


@query("config_line_rules", f"WITH {L_SQL} SELECT concept, count(*) AS n FROM (SELECT 'shout' AS concept FROM l WHERE contains(line, '!!') UNION ALL SELECT 'article' FROM l WHERE starts_with(trim(line), 'The ') UNION ALL SELECT 'joined' FROM l WHERE contains(regexp_replace(line, '\\s+', '', 'g'), 'ofthe')) GROUP BY concept")
def _(spark, d):
    return textscan.config_lines(views.text_lines(spark, d), RULES).groupBy("concept").agg(F.count("*").alias("n"))


@query("config_file_all", "SELECT page_id FROM pages WHERE contains(html, '<style>') AND contains(html, 'track(')")
def _(spark, d):
    rule = textscan.LineRule("tracked", "file_all", parts=("<style>", "track("))
    return textscan.files_with_all(views.table(spark, d, "pages"), "html", rule).select("page_id")


@query("source_router", "SELECT page_id, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'tf' THEN 'config' ELSE '' END AS language FROM (SELECT page_id, 'src/' || page_id || list_extract(['.py', '.js', '.tf', '.bin'], page_id % 4 + 1) AS path FROM pages)")
def _(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".py", ".js", ".tf", ".bin"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.col("page_id").cast("string"), ext)
    return views.table(spark, d, "pages").select("page_id", textscan.route(path).alias("language"))


@query("exclude_segments", "SELECT page_id FROM pages WHERE NOT list_contains(string_split(url, '/'), 'fr') AND NOT list_contains(string_split(url, '/'), 'de')")
def _(spark, d):
    return views.table(spark, d, "pages").where(textscan.keep_path(F.col("url"), ["fr", "de"])).select("page_id")


@query("properties_source", "SELECT CAST(conv_id AS BIGINT) AS conv_id, 'role' AS name, arg_max(role, turn) AS value FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = views.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.concat(F.lit(" role = "), "role", F.lit(" ")).alias("line"))
    return textscan.properties(c, "conv_id")


@query("manifest_requirements", "SELECT p_partkey, lower(p_brand[1:5]) AS name, CASE p_partkey % 3 WHEN 0 THEN '==1.' || p_size WHEN 1 THEN '*' ELSE '>=2,<3' END AS specifier FROM part WHERE p_partkey % 4 <> 3")
def _(spark, d):
    k = F.col("p_partkey")
    name = F.substring("p_brand", 1, 5)
    line = F.when(k % 4 == 3, F.concat(F.lit("-r "), name, F.lit(".txt"))).when(k % 3 == 0, F.concat(F.lit("  "), name, F.lit(" == 1."), F.col("p_size").cast("string"), F.lit("  # pin"))).when(k % 3 == 1, F.concat(name, F.lit("[extra]"))).otherwise(F.concat(name, F.lit(">=2, <3 ; python_version > '3'")))
    return textscan.requirements(views.table(spark, d, "part").select("p_partkey", line.alias("line")))


@query("manifest_lock_json", "SELECT DISTINCT lower(event_type) AS name, '1.0' AS specifier FROM events")
def _(spark, d):
    doc = F.to_json(F.struct(F.create_map(F.col("event_type"), F.lit("1.0")).alias("dependencies")))
    return textscan.lock_packages(views.table(spark, d, "events").select(doc.alias("j")).distinct(), "j")


@query("event_props_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


MANIFEST = "(SELECT source, substr(sha256(source || chr(0) || n || chr(0) || h0 || chr(0) || h1 || chr(0) || h2 || chr(0) || h3), 1, 16) AS version, n FROM (SELECT source, count(*) AS n, " + ", ".join(f"sum(CAST('0x' || substr(id, {15 * k + 1}, 15) AS HUGEINT)) % 1152921504606846976 AS h{k}" for k in range(4)) + " FROM (SELECT source, sha256(coalesce('=' || doc_id, '0') || chr(0) || coalesce('=' || {text}, '0')) AS id FROM documents WHERE {where}) GROUP BY source))"


@query("sink_changefeed", f"SELECT * FROM {MANIFEST.format(text='text', where='true')}")
def _(spark, d):
    return refresh.manifest(views.table(spark, d, "documents").select("source", "doc_id", "text"), "source", ["doc_id", "text"])


_OLD, _NEW = MANIFEST.format(text="text", where="source <> 'src4'"), MANIFEST.format(text="CASE WHEN source = 'src3' THEN upper(text) ELSE text END", where="source NOT IN ('src1', 'src2')")


@query("changefeed_delta", f"SELECT * FROM (SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.source IS NULL THEN 'added' WHEN b.source IS NULL THEN 'deleted' WHEN a.version <> b.version THEN 'changed' ELSE 'same' END AS op FROM {_OLD} a FULL JOIN {_NEW} b ON a.source = b.source) WHERE op <> 'same'")
def _(spark, d):
    t = views.table(spark, d, "documents").select("source", "doc_id", "text")
    before = refresh.manifest(t.where("source <> 'src4'"), "source", ["doc_id", "text"])
    after = refresh.manifest(t.where("source not in ('src1', 'src2')").withColumn("text", F.when(F.col("source") == "src3", F.upper("text")).otherwise(F.col("text"))), "source", ["doc_id", "text"])
    return refresh.delta(before, after, "source").where("op <> 'same'").select("op", "source")


@query("sink_json", f"WITH {F_SQL} SELECT fp, to_json({{'confidence': confidence, 'fp': fp, 'rule_id': rule_id, 'seq': seq, 'severity': severity, 'sink': sink, 'witness_length': witness_length}})::VARCHAR AS json FROM f")
def _(spark, d):
    return report.finding_json(order_findings(spark, d))


@query("sink_api_json", f"WITH {F_SQL} SELECT fp, to_json({{'version': 1, 'finding': {{'confidence': confidence, 'fp': fp, 'rule_id': rule_id, 'seq': seq, 'severity': severity, 'sink': sink, 'witness_length': witness_length}}}})::VARCHAR AS json FROM f")
def _(spark, d):
    return report.api_json(order_findings(spark, d))


_SARIF = """to_json({'ruleId': rule_id, 'level': CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END, 'message': {'text': 'finding of ' || rule_id},
  'locations': [{'physicalLocation': {'artifactLocation': {'uri': 'orders/o' || seq}, 'region': {'startLine': seq % 90 + 1}}}], 'partialFingerprints': {'primary/v1': fp}})::VARCHAR"""


@query("sink_sarif", f"WITH {F_SQL} SELECT fp, rule_id, severity, {_SARIF} AS result FROM f")
def _(spark, d):
    """One result object a row; report.sarif() puts those of a bounded report into one document."""
    place = F.concat(F.lit("orders/o"), F.col("seq").cast("string"), F.lit(":"), (F.col("seq") % 90 + 1).cast("string"))
    return report.sarif_results(order_findings(spark, d).withColumn("loc", place))


# ---- manifests of several formats


def manifest_files(spark, d):
    """A file of each format for every supplier: (s_suppkey, format, content)."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    files = {
        "go.mod": text("module m\n\nrequire Example.com/a", n, " v1.", k, " // direct\nrequire (\n\t\"github.com/b", k, "\" v0.1.0 // indirect\n\n\tx.org/c v2\n)\nreplace (\n\tz/z v1 => y/y v2\n)\nexclude q/q v1\n"),
        "setup.cfg": text("[metadata]\ninstall_requires = no\n[Options]\npackages = find:\ninstall_requires =\n    Flask>=2.", n, "\n    # none\n    six\n    s", k, "[extra]==1\nzip_safe = no\n    late\n[options.extras]\n    other>1\n"),
        "setup.py": text("setup(name='x', install_requires=['A", k, "[e]>=1.0', \"b\"], extras_require={'t': ['c']})\n"),
        "Cargo.lock": text("[[package]]\nname = \"a\"\nsource = \"registry+https://x\"\n[[package]]\nname = \"b\"\nsource = \"git+https://Host.org/o/r", k, ".git#abc", n, "\"\n[[package]]\nsource = \"git+https://host.org/none\"\n"),
        ".gitmodules": text("[submodule \"a\"]\n\tpath = lib/a\n\turl = git@host.org:o/a", k, ".git\n[submodule \"b\"]\n\tpath = lib/b\n\turl = https://host.org/o/b\n"),
        ".npmrc": text("; runtime=node\nRuntime = Electron # yes\ntarget=1.", k, "\n"),
        "package.json": text('{"dependencies": {"@S/a', k, '": "^1.', n, '.0"}, "devDependencies": {"b": ">=2 <3", "c": "latest", "d": "1.x || *"}}'),
        "composer.lock": text('{"packages": [{"name": "V/a', k, '", "version": " v1.', n, ' "}], "packages-dev": [{"name": "v/b"}, {"name": ""}]}'),
    }
    each = F.array(*(F.struct(F.lit(f).alias("format"), c.alias("content")) for f, c in files.items()))
    return views.table(spark, d, "supplier").select("s_suppkey", F.explode(each).alias("f")).select("s_suppkey", "f.*")


@query(
    "manifest_formats",
    "SELECT s_suppkey, format, name, version FROM (SELECT s_suppkey AS s_suppkey, CAST(s_suppkey AS VARCHAR) AS k, CAST(s_nationkey AS VARCHAR) AS n FROM supplier), LATERAL (VALUES ('go.mod', 'example.com/a' || n, 'v1.' || k), ('go.mod', 'github.com/b' || k, 'v0.1.0'), ('go.mod', 'x.org/c', 'v2'), ('setup.cfg', 'flask', '>=2.' || n), ('setup.cfg', 'six', '*'), ('setup.cfg', 's' || k, '==1'),"
    " ('setup.py', 'a' || k, '>=1.0'), ('setup.py', 'b', '*'), ('Cargo.lock', 'host.org/o/r' || k, 'abc' || n), ('.gitmodules', 'host.org/o/a' || k, 'c' || k), ('.npmrc', 'brave/electron', '1.' || k), ('package.json', '@s/a' || k, '1.' || n || '.0'), ('package.json', 'b', '2'), ('package.json', 'c', '*'), ('package.json', 'd', '*'), ('composer.lock', 'v/a' || k, 'v1.' || n), ('composer.lock', 'v/b', '*')) AS t(format, name, version)",
)
def _(spark, d):
    files = manifest_files(spark, d)
    of = lambda f: files.where(F.col("format") == f)
    lines = lambda f: of(f).select("s_suppkey", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    commits = views.table(spark, d, "supplier").select("s_suppkey", F.lit("lib/a").alias("path"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("commit"))
    found = {
        "go.mod": manifests.go_mod(lines("go.mod"), "s_suppkey"), "setup.cfg": manifests.setup_cfg(lines("setup.cfg"), "s_suppkey"), "setup.py": manifests.setup_py(of("setup.py"), "s_suppkey", "content"),
        "Cargo.lock": manifests.cargo_lock_git(lines("Cargo.lock"), "s_suppkey"), ".gitmodules": manifests.gitmodules(lines(".gitmodules"), "s_suppkey", commits), ".npmrc": manifests.npmrc(lines(".npmrc"), "s_suppkey"),
        "package.json": manifests.package_json(of("package.json"), "s_suppkey", "content"), "composer.lock": manifests.composer_lock(of("composer.lock"), "s_suppkey", "content"),
    }
    out = None
    for name, rows in found.items():
        rows = rows.select("s_suppkey", F.lit(name).alias("format"), "name", "version")
        out = rows if out is None else out.union(rows)
    return out
