"""Semi, anti, theta and ranked joins over the graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bind, coverage, findings
from ..sources import views
from .catalog import CFG, guards, query

DOMINATES = "(c.region = g.region OR starts_with(c.region, g.region || '/')) AND g.ord < c.ord"


def candidates(spark, d):
    c = views.cfg(spark, d)
    return c.join(views.cfg_labels(spark, d).where("concept = 'candidate'").select("node_id"), "node_id", "left_semi")


def checks(spark, d, part):
    return coverage.guards(views.cfg(spark, d), views.cfg_labels(spark, d), "check", part)


@query("label_semi_join", f"WITH {CFG} SELECT node_id, region, CAST(ord AS INTEGER) AS ord FROM cfg WHERE concept = 'candidate'")
def _(spark, d):
    return candidates(spark, d).select("node_id", "region", "ord")


@query("concept_in_set", f"WITH {CFG} SELECT node_id, concept FROM cfg WHERE concept IN ('check', 'audit')")
def _(spark, d):
    return findings.first_label(views.cfg_labels(spark, d), ["check", "audit"])


@query("match_labeledAs", f"WITH {CFG} SELECT node_id FROM cfg WHERE concept = 'candidate' AND ord >= 4")
def _(spark, d):
    late = views.cfg(spark, d).where("ord >= 4").select("node_id", F.lit("late").alias("concept"))
    both = views.cfg_labels(spark, d).select("node_id", "concept").union(late)
    return both.where("concept = 'candidate'").join(both.where("concept = 'late'"), "node_id", "left_semi").select("node_id")


@query("match_references", "SELECT 'O:' || o_orderkey AS node_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def _(spark, d):
    n = views.nodes(spark, d)
    marked = n.where((F.col("node_type") == "party.Customer") & (S.prop("segment") == "MACHINERY")).select(F.col("node_id").alias("ref"))
    return n.where("node_type = 'event.Order'").join(marked, S.prop("customer") == F.col("ref"), "left_semi").select("node_id")


@query("order_join", f"WITH {CFG} SELECT a.node_id AS a_id, b.node_id AS b_id FROM cfg a JOIN cfg b ON a.okey = b.okey AND a.ord < b.ord WHERE a.concept = 'check' AND b.concept = 'candidate' AND (a.region = b.region OR starts_with(a.region, b.region || '/') OR starts_with(b.region, a.region || '/'))")
def _(spark, d):
    labels = views.cfg_labels(spark, d)
    of = lambda c: views.cfg(spark, d).join(labels.where(F.col("concept") == c).select("node_id"), "node_id", "left_semi")
    return coverage.order_pairs(of("check"), of("candidate"))


@query("guard_dominates", f"WITH {CFG}, {guards('dominates')} SELECT node_id FROM cfg c WHERE concept = 'candidate' AND NOT EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND {DOMINATES})")
def _(spark, d):
    return coverage.uncovered_dominates(candidates(spark, d), checks(spark, d, "dominates")).select("node_id")


@query("guard_post_dominates", f"WITH {CFG}, {guards('postDominates')} SELECT node_id FROM cfg c WHERE concept = 'candidate' AND NOT EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND (c.region = g.region OR starts_with(c.region, g.region || '/')) AND g.ord > c.ord)")
def _(spark, d):
    return coverage.uncovered_post_dominates(candidates(spark, d), checks(spark, d, "postDominates")).select("node_id")


@query("guard_same_scope", f"WITH {CFG}, {guards('sameScope')} SELECT node_id FROM cfg c WHERE concept = 'candidate' AND NOT EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND (c.region = g.region OR starts_with(c.region, g.region || '/')))")
def _(spark, d):
    return coverage.uncovered_same_scope(candidates(spark, d), checks(spark, d, "sameScope")).select("node_id")


@query("guard_same_receiver", f"WITH {CFG}, {guards('sameReceiver')} SELECT node_id FROM cfg WHERE concept = 'candidate' AND okey NOT IN (SELECT okey FROM g)")
def _(spark, d):
    # a receiver for each order: calls of one order are made on one object
    own = lambda df: df.withColumn("callee_path", F.concat(F.lit("svc.o"), F.col("okey").cast("string"), F.lit("."), F.lower("flag")))
    return coverage.uncovered_same_receiver(own(candidates(spark, d)), own(checks(spark, d, "sameReceiver"))).select("node_id")


@query("guard_global", f"WITH {CFG} SELECT node_id FROM cfg WHERE concept = 'candidate' AND NOT EXISTS (SELECT 1 FROM cfg WHERE concept = 'check' AND NOT advisory AND coverage = 'global')")
def _(spark, d):
    return coverage.uncovered_global(candidates(spark, d), checks(spark, d, "global")).select("node_id")


_LINKS = "e AS (SELECT DISTINCT 'L:' || okey || ':' || ord || ':N' AS src, 'L:' || okey || ':' || (ord - 1) || ':R' AS dst FROM cfg WHERE flag = 'N')"


def links(spark, d):
    c = views.cfg(spark, d).where("flag = 'N'")
    name = lambda k, f: F.concat_ws(":", F.lit("L"), F.col("okey").cast("string"), k.cast("string"), F.lit(f))
    return c.select(F.lit("CHECKS").alias("edge_type"), name(F.col("ord"), "N").alias("src"), name(F.col("ord") - 1, "R").alias("dst")).distinct()


@query("guard_endpoint_edge", f"WITH {CFG}, {guards('endpoint')}, {_LINKS} SELECT node_id FROM cfg c WHERE concept = 'candidate' AND NOT EXISTS (SELECT 1 FROM e JOIN g ON e.src = g.node_id WHERE e.dst = c.node_id)")
def _(spark, d):
    # without regions on the candidates a CHECKS edge alone decides
    bare = candidates(spark, d).withColumn("region", F.lit("")).withColumn("scope", F.lit(""))
    return coverage.uncovered_endpoint(bare, checks(spark, d, "endpoint"), links(spark, d)).select("node_id")


@query("guard_endpoint_dominates", f"WITH {CFG}, {guards('endpoint')} SELECT node_id FROM cfg c WHERE concept = 'candidate' AND NOT EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND ({DOMINATES} OR (g.ord % 3 = 2 AND g.ord < c.ord AND (c.region = '/fn' || c.okey OR c.region = g.region))))")
def _(spark, d):
    return coverage.uncovered_endpoint(candidates(spark, d), checks(spark, d, "endpoint"), links(spark, d)).select("node_id")


@query("guard_preflight_loop", f"WITH {CFG}, g AS (SELECT * FROM cfg WHERE flag = 'N' AND NOT advisory AND ord % 3 = 2) SELECT DISTINCT c.node_id FROM cfg c JOIN g ON g.okey = c.okey WHERE c.concept = 'candidate' AND g.ord < c.ord AND (c.region = '/fn' || c.okey OR c.region = g.region)")
def _(spark, d):
    # what the checks in loops cover, whatever their part: a loop over all items that comes before
    c, loops = candidates(spark, d), views.cfg(spark, d).where("flag = 'N' and okey % 7 <> 0 and region like '%/loop%'")
    left = coverage.uncovered_endpoint(c, loops, links(spark, d).limit(0))
    return c.join(left.select("node_id"), "node_id", "left_anti").select("node_id")


@query("guard_endpoint_function_context", f"WITH {CFG} SELECT node_id FROM cfg c WHERE concept = 'candidate' AND NOT EXISTS (SELECT 1 FROM cfg g WHERE g.concept = 'audit' AND g.okey = c.okey AND g.ord = 1)")
def _(spark, d):
    marks = views.cfg(spark, d).where("flag = 'A' and ord = 1").withColumn("callee_path", F.lit("analysis.function.context")).withColumn("region", F.lit(""))
    return coverage.uncovered_endpoint(candidates(spark, d), marks, links(spark, d).limit(0)).select("node_id")


@query("coverage_typing", f"WITH {CFG} SELECT coverage, count(*) AS n FROM cfg WHERE concept = 'check' AND NOT advisory GROUP BY coverage")
def _(spark, d):
    of = lambda k: F.element_at("detail", F.lit(k))
    return views.cfg_labels(spark, d).where((F.col("concept") == "check") & (of("advisory") != "true")).groupBy(of("coverage").alias("coverage")).agg(F.count("*").alias("n"))


@query("negation_evidence", f"WITH {CFG}, {guards('dominates')} SELECT node_id, 'unless dominates' AS clause, EXISTS (SELECT 1 FROM g WHERE g.okey = c.okey AND {DOMINATES}) AS satisfied, 'check' AS detail FROM cfg c WHERE concept = 'candidate'")
def _(spark, d):
    c = candidates(spark, d)
    return coverage.evidence("unless dominates", c, coverage.uncovered_dominates(c, checks(spark, d, "dominates")), "check")


@query("nearby_checks", f"WITH {CFG}, {guards('dominates')} SELECT node_id, check_id, CAST(place AS INTEGER) AS place FROM (SELECT c.node_id, g.node_id AS check_id, row_number() OVER (PARTITION BY c.node_id ORDER BY c.ord - g.ord, g.node_id) AS place FROM cfg c JOIN g ON g.okey = c.okey AND g.ord < c.ord WHERE c.concept = 'candidate') WHERE place <= 2")
def _(spark, d):
    from pyspark.sql import Window

    g = checks(spark, d, "dominates").select(S.function_scope_key("scope", "region").alias("g_fn"), F.col("node_id").alias("check_id"), F.col("ord").alias("g_ord"))
    near = candidates(spark, d).join(g, (S.function_scope_key("scope", "region") == F.col("g_fn")) & (F.col("g_ord") < F.col("ord")))
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.col("ord") - F.col("g_ord"), "check_id"))
    return near.withColumn("place", place).where("place <= 2").select("node_id", "check_id", "place")


# ---- packages


def packages(spark, d):
    p = views.table(spark, d, "part")
    return p.select("p_partkey", F.col("p_brand").alias("eco"), F.col("p_name").alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0")).alias("version"))


@query("package_gate_join", "SELECT s_suppkey, 'acme' AS package FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'acme.core' FROM supplier WHERE s_suppkey % 6 = 0")
def _(spark, d):
    s = views.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("acme.core.x"), k.cast("string"))).when(k % 3 == 0, F.concat(F.lit("Acme/y"), k.cast("string"))).otherwise(F.concat(F.lit("acmeother"), k.cast("string")))
    evidence = s.select(name.alias("name"), "s_suppkey")
    wanted = spark.range(2).select(F.when(F.col("id") == 0, "acme").otherwise("acme.core").alias("package"))
    return bind.package_gate(evidence, wanted).join(evidence, "name").select("s_suppkey", "package")


@query("import_package_link", "SELECT 'page:' || page_id AS src, 'pkg:' || split_part(split_part(split_part(url, '://', 2), '/', 1), '.', -2) AS dst FROM pages WHERE split_part(split_part(split_part(url, '://', 2), '/', 1), '.', -2) = 'example'")
def _(spark, d):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    imports = views.table(spark, d, "pages").select("page_id", F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("name"))
    wanted = spark.sql("select explode(array('net.example', 'com.example', 'org.example')) as package")
    met = bind.package_gate(imports, wanted).join(imports, "name")
    return met.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), F.concat(F.lit("pkg:"), S.last_segment("package")).alias("dst")).distinct()


@query("advisory_match", "SELECT p_partkey, 'A1' AS id FROM part WHERE p_brand = 'Brand#11' AND p_size < 12 UNION ALL SELECT p_partkey, 'A2' FROM part WHERE p_brand = 'Brand#12' AND p_size < 7 UNION ALL SELECT p_partkey, 'A3' FROM part WHERE p_brand = 'Brand#13' AND p_size = 5 UNION ALL SELECT p_partkey, 'A4' FROM part WHERE p_brand = 'Brand#14'")
def _(spark, d):
    p = packages(spark, d)
    rows = p.select("eco", "name").distinct()
    rule = F.expr("CASE eco WHEN 'Brand#11' THEN named_struct('id','A1','exact',CAST(NULL AS STRING),'min_safe','1.12','max_safe',CAST(NULL AS STRING)) WHEN 'Brand#12' THEN named_struct('id','A2','exact',NULL,'min_safe',NULL,'max_safe','1.7.0') WHEN 'Brand#13' THEN named_struct('id','A3','exact','1.5','min_safe',NULL,'max_safe',NULL) WHEN 'Brand#14' THEN named_struct('id','A4','exact','*','min_safe',NULL,'max_safe',NULL) END")
    advisories = rows.withColumn("r", rule).where("r is not null").select("eco", "name", "r.*")
    hits = bind.advisory_matches(p.select("eco", "name", "version").distinct(), advisories)
    return p.join(hits, ["eco", "name", "version"]).select("p_partkey", "id")


@query("advisory_entrypoint", "SELECT 'O:' || l_orderkey || ':' || l_linenumber AS call, 'P:' || l_partkey AS arg0, 'A1' AS id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#11' AND p_size < 12")
def _(spark, d):
    vulnerable = packages(spark, d).where("eco = 'Brand#11'")
    advisory = vulnerable.select("eco", "name").distinct().selectExpr("eco", "name", "'A1' as id", "cast(null as string) as exact", "'1.12' as min_safe", "cast(null as string) as max_safe")
    bad = vulnerable.join(bind.advisory_matches(vulnerable.select("eco", "name", "version").distinct(), advisory), ["eco", "name", "version"]).select(F.col("p_partkey").alias("l_partkey"), "id")
    calls = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    call = F.concat(F.lit("O:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return calls.join(bad, "l_partkey").select(call.alias("call"), views.ident("P", "l_partkey").alias("arg0"), "id")


@query("typosquat_join", "WITH names AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS name FROM part), popular AS (SELECT DISTINCT p_name AS near FROM part) SELECT name, near FROM names, popular WHERE name NOT IN (SELECT near FROM popular) AND length(name) >= 4 AND length(near) >= 4 AND levenshtein(name, near) = 1")
def _(spark, d):
    p = views.table(spark, d, "part")
    names = p.select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("")).alias("name"))
    return bind.typosquats(names, p.select(F.col("p_name").alias("name")))


@query("malware_version_join", "WITH bad AS (SELECT DISTINCT p_name, p_size FROM part WHERE p_size % 10 = 0) SELECT DISTINCT p.p_name AS name, '1.' || p.p_size || '.0' AS version, CASE WHEN EXISTS (SELECT 1 FROM bad b WHERE b.p_name = p.p_name AND b.p_size = p.p_size) THEN 'malicious' ELSE 'suspicious' END AS verdict FROM part p WHERE p.p_name IN (SELECT p_name FROM bad)")
def _(spark, d):
    p = packages(spark, d).select("name", "version").distinct()
    return bind.malware_verdicts(p, p.where(S.version_parts("version")[1] % 10 == 0))


_NAMES = "e AS (SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'acme' WHEN 1 THEN 'acme.core' WHEN 2 THEN 'acme/lib/x' WHEN 3 THEN '@scope/kit/y' WHEN 4 THEN 'github.com/acme/z' WHEN 5 THEN 'acmeother' WHEN 6 THEN '\"Yaml\"' WHEN 7 THEN '@scope' ELSE 'n' || s_suppkey || '[extra]' END AS name FROM supplier), w AS (SELECT 'acme' AS package UNION ALL SELECT 'acme.core.deep' UNION ALL SELECT '@scope/kit' UNION ALL SELECT 'lib' UNION ALL SELECT 'git/acme' UNION ALL SELECT 'pyyaml' UNION ALL SELECT 'n' || n_nationkey || '.x' FROM nation)"
_NORM = "CASE WHEN strpos({0}, '[') > 0 THEN substr({0}, 1, strpos({0}, '[') - 1) ELSE {0} END"
_ROOT = "CASE WHEN starts_with({0}, '@') THEN CASE WHEN contains({0}, '/') THEN split_part({0}, '/', 1) || '/' || split_part({0}, '/', 2) ELSE {0} END ELSE split_part({0}, '/', 1) END"


@query("package_pairs", f"WITH {_NAMES}, o AS (SELECT DISTINCT s_suppkey, name, {_NORM.format('x')} AS a FROM (SELECT s_suppkey, name, lower(trim(name, chr(34) || chr(39))) AS x FROM e UNION ALL SELECT s_suppkey, name, 'pyyaml' FROM e WHERE lower(trim(name, chr(34))) = 'yaml')) SELECT DISTINCT s_suppkey, name, package FROM (SELECT *, package AS b FROM o, w) WHERE a = b OR {_ROOT.format('a')} = b OR {_ROOT.format('b')} = a OR starts_with(a, b || '.') OR starts_with(b, a || '.') OR starts_with(a, b || '/') OR starts_with(b, a || '/') OR (contains(a, '/') AND NOT contains(b, '/') AND NOT contains(b, '.') AND list_contains(string_split(a, '/'), b)) OR (contains(b, '/') AND NOT contains(a, '/') AND NOT contains(a, '.') AND list_contains(string_split(b, '/'), a))")
def _(spark, d):
    """Nine ways as one equality join; the SQL compares all pairs."""
    k = F.col("s_suppkey")
    fixed = F.array(*map(F.lit, ("acme", "acme.core", "acme/lib/x", "@scope/kit/y", "github.com/acme/z", "acmeother", '"Yaml"', "@scope")))
    name = F.coalesce(F.try_element_at(fixed, (k % 9 + 1).cast("int")), F.concat(F.lit("n"), k.cast("string"), F.lit("[extra]")))
    e = views.table(spark, d, "supplier").select("s_suppkey", name.alias("name"))
    wanted = spark.sql("select explode(array('acme', 'acme.core.deep', '@scope/kit', 'lib', 'git/acme', 'pyyaml')) as package").union(views.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".x"))))
    return e.join(bind.package_pairs(e, wanted, aliases=True), "name").select("s_suppkey", "name", "package")


@query("name_verdicts", "WITH p AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS name, '1.' || p_size || '.0' AS version, p_size % 7 = 0 AS trusted FROM part), k AS (SELECT DISTINCT p_name AS name, CASE WHEN p_size % 20 = 0 THEN '*' ELSE '1.' || p_size || '.0' END AS version FROM part WHERE p_size % 10 = 0), t AS (SELECT * FROM p WHERE NOT trusted), hist AS (SELECT DISTINCT name FROM k), pop AS (SELECT DISTINCT p_name AS near FROM part WHERE p_size >= 5) SELECT DISTINCT name, version, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.name = t.name AND k.version IN ('*', t.version)) THEN 'malicious' ELSE 'suspicious' END AS verdict, NULL::VARCHAR AS near FROM t WHERE name IN (SELECT name FROM hist) UNION ALL SELECT name, version, 'suspicious', min(near) FROM (SELECT DISTINCT name, version FROM t WHERE name NOT IN (SELECT name FROM hist) AND name NOT IN (SELECT near FROM pop)) JOIN pop ON levenshtein(name, near) = 1 AND length(name) >= 4 AND length(near) >= 4 GROUP BY name, version")
def _(spark, d):
    """Known bad versions, other versions of the same packages, and look-alikes of popular names without a history."""
    t = views.table(spark, d, "part")
    version = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0"))
    p = t.select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("")).alias("name"), version.alias("version"), (F.col("p_size") % 7 == 0).alias("trusted"))
    known = t.where("p_size % 10 = 0").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 20 == 0, "*").otherwise(version).alias("version"))
    return bind.name_verdicts(p, known, t.where("p_size >= 5").select(F.col("p_name").alias("name")))


@query("fn_package_roots", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '@s/' || lower(o_orderstatus) ELSE lower(o_orderpriority) END AS root, CASE o_orderstatus WHEN 'F' THEN 'pycryptodome,pycrypto' WHEN 'O' THEN 'pyyaml' ELSE '' END AS aliases, o_orderkey % 3 = 0 AND o_orderstatus = 'F' AS matched FROM orders")
def _(spark, d):
    """Roots of callees, what imports stand for, and one pair as a predicate."""
    o = views.table(spark, d, "orders")
    path = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("@S/"), "o_orderstatus", F.lit("/deep.call"))).otherwise(F.concat("o_orderpriority", F.lit(".run[0]")))
    name = F.when(F.col("o_orderstatus") == "F", "'Crypto'").when(F.col("o_orderstatus") == "O", "YAML").otherwise("other")
    return o.select("o_orderkey", S.call_root(path).alias("root"), F.array_join(S.import_aliases(name), ",").alias("aliases"), S.package_matches(path, F.lit("@s/f")).alias("matched"))


# ---- sets


@query("baseline_split", "WITH a AS (SELECT substr(sha256('o=' || o_orderkey), 1, 16) AS fp FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT substr(sha256('o=' || o_orderkey), 1, 16) AS fp FROM orders WHERE o_orderpriority = '1-URGENT') SELECT fp, 'reported' AS status FROM a WHERE fp NOT IN (SELECT fp FROM b) UNION ALL SELECT fp, 'covered' FROM a WHERE fp IN (SELECT fp FROM b) UNION ALL SELECT fp, 'stale' FROM b WHERE fp NOT IN (SELECT fp FROM a)")
def _(spark, d):
    o = views.table(spark, d, "orders").withColumn("fp", S.fingerprint(o=F.col("o_orderkey").cast("string")))
    return findings.baseline_split(o.where("o_orderstatus = 'F'").select("fp"), o.where("o_orderpriority = '1-URGENT'").select("fp"))


@query("diff_scans", "SELECT change, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'unchanged' END AS change FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)) GROUP BY change")
def _(spark, d):
    o = views.table(spark, d, "orders").withColumn("fp", S.fingerprint(o=F.col("o_orderkey").cast("string")))
    out = findings.scan_diff(o.where("o_orderkey % 5 <> 0").select("fp"), o.where("o_orderkey % 7 <> 0").select("fp"))
    return out.groupBy("change").agg(F.count("*").alias("n"))


@query("set_operations", "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS both_, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS idle")
def _(spark, d):
    o, c = views.table(spark, d, "orders").select("o_custkey"), views.table(spark, d, "customer")
    both = o.intersect(c.where("c_acctbal < 0").select("c_custkey")).agg(F.count("*").alias("both_"))
    return both.crossJoin(F.broadcast(c.select("c_custkey").subtract(o).agg(F.count("*").alias("idle"))))  # one row each
