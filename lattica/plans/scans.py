"""Scans, expansions, properties, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import Graph, Recording, flows_if_present, new_labels
from ..sources import views
from .catalog import CFG, FLOWS, NET, NODES, query
from .catalog import STEPS as STEP_SQL


def graph(spark, d, edges=None) -> Graph:
    return Graph(views.nodes(spark, d), views.net(spark, d) if edges is None else edges, views.cfg_labels(spark, d))


@query("scan_nodes_all", f"WITH {NODES} SELECT node_id, node_type, loc FROM nodes")
def _(spark, d):
    return views.nodes(spark, d).select("node_id", "node_type", "loc")


@query("scan_nodes_by_type", "SELECT 'S:' || s_suppkey AS node_id, CAST(floor(s_acctbal / 1000) AS BIGINT)::VARCHAR AS balance FROM supplier")
def _(spark, d):
    return graph(spark, d).nodes_of_type("party.Supplier").select("node_id", S.prop("balance").alias("balance"))


@query("scan_nodes_by_concept", f"WITH {CFG} SELECT DISTINCT node_id FROM cfg WHERE concept IN ('candidate', 'audit')")
def _(spark, d):
    return graph(spark, d).nodes_with_concept("candidate", "audit")


@query("point_get_node", "SELECT 'C:' || c_custkey AS node_id, c_mktsegment AS segment FROM customer WHERE c_custkey = 7")
def _(spark, d):
    return graph(spark, d).node("C:7").select("node_id", S.prop("segment").alias("segment"))


@query("expand_out", f"WITH {NET} SELECT src AS node_id, dst AS next FROM net WHERE src IN (SELECT 'N:' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, d):
    g = graph(spark, d)
    start = g.nodes_of_type("org.Nation").where(S.prop("region") == "R:1")
    return g.expand(start, "NET").select("node_id", "next")


@query("expand_in", f"WITH {NET} SELECT dst AS node_id, count(*) AS n_in FROM net WHERE dst LIKE 'P:%' GROUP BY dst")
def _(spark, d):
    g = graph(spark, d)
    return g.expand(g.nodes_of_type("asset.Part"), "NET", reverse=True).groupBy("node_id").agg(F.count("*").alias("n_in"))


@query("scan_labels", f"WITH {CFG} SELECT node_id, concept, confidence, fidelity, coverage FROM cfg")
def _(spark, d):
    g = graph(spark, d)
    return g.labels_of(views.cfg(spark, d)).select("node_id", "concept", "confidence", "fidelity", F.element_at("detail", F.lit("coverage")).alias("coverage"))


@query("write_node", "SELECT 'S:' || s_suppkey AS node_id, CASE WHEN s_acctbal < 0 THEN 'flagged' ELSE 'kept' END AS state FROM supplier")
def _(spark, d):
    n = graph(spark, d).nodes_of_type("party.Supplier")
    g = Graph(n.select("node_id", F.lit("kept").alias("state")), None, None)
    return g.upsert_nodes(n.where(S.prop("balance").cast("int") < 0).select("node_id", F.lit("flagged").alias("state"))).nodes


@query("write_edge", f"WITH {NET}, {STEP_SQL} SELECT t, count(*) AS n FROM (SELECT 'NET' AS t FROM net UNION ALL SELECT 'STEP' FROM steps) GROUP BY t")
def _(spark, d):
    return graph(spark, d).append_edges(views.steps(spark, d)).edges.groupBy(F.col("edge_type").alias("t")).agg(F.count("*").alias("n"))


@query("write_label", "SELECT 'S:' || s_suppkey AS node_id, 'insolvent' AS concept FROM supplier WHERE s_acctbal < 0")
def _(spark, d):
    n = graph(spark, d).nodes_of_type("party.Supplier")
    before = n.select("node_id", F.lit("vendor").alias("concept"))
    g = Graph(n, None, before).append_labels(n.where(S.prop("balance").cast("int") < 0).select("node_id", F.lit("insolvent").alias("concept")))
    return new_labels(before, g.labels)


@query("add_flow_if_present", "SELECT DISTINCT 'C:' || o_custkey AS src, 'S:' || (o_orderkey % 40) AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_orderkey % 40 IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    o = views.table(spark, d, "orders")
    wanted = o.select(views.ident("C", "o_custkey").alias("src"), F.concat(F.lit("S:"), (F.col("o_orderkey") % 40).cast("string")).alias("dst")).distinct()
    return flows_if_present(wanted, views.nodes(spark, d)).select("src", "dst")


@query("subset_view", f"WITH {NODES} SELECT node_type, count(*) AS n FROM nodes WHERE node_type IN ('org.Region', 'asset.Part') GROUP BY node_type")
def _(spark, d):
    return graph(spark, d).subset(F.col("node_type") == "asset.Part", always=("org.Region",)).nodes.groupBy("node_type").agg(F.count("*").alias("n"))


@query("recording_view", f"WITH {CFG} SELECT node_id, 'risky' AS concept FROM cfg WHERE flag = 'R' AND ord > 4")
def _(spark, d):
    before = views.cfg_labels(spark, d).select("node_id", "concept")
    phase = views.cfg(spark, d).where("flag = 'R' and ord > 4").select("node_id", F.lit("risky").alias("concept"))
    return Recording.of(Graph(None, None, before)).append_labels(phase).written


# ---- properties and predicates


@query("prop_project", "SELECT 'P:' || p_partkey AS node_id, p_brand AS brand, '' AS missing, CAST(p_size AS VARCHAR) AS size FROM part")
def _(spark, d):
    n = graph(spark, d).nodes_of_type("asset.Part")
    return n.select("node_id", S.prop("brand", inline=F.lit("")).alias("brand"), S.prop("nothing").alias("missing"), S.prop("brand", inline=S.prop("size")).alias("size"))


@query("lowered_props", "SELECT event_id, coalesce(split_part(event_type || ',' || user_id, ',', 1), '') AS arg0, CAST(user_id AS VARCHAR) AS arg1, '' AS arg2 FROM events")
def _(spark, d):
    e = views.table(spark, d, "events").withColumn("args", F.array("event_type", F.col("user_id").cast("string")))
    return e.select("event_id", *(S.text(F.try_element_at("args", F.lit(i + 1))).alias(f"arg{i}") for i in range(3)))


@query("where_and", "SELECT 'C:' || c_custkey AS node_id FROM customer WHERE c_mktsegment = 'BUILDING' AND floor(c_acctbal / 1000) >= 5")
def _(spark, d):
    n = graph(spark, d).nodes_of_type("party.Customer")
    return n.where(S.compare_string(S.prop("segment"), "==", "BUILDING") & S.compare_int(S.prop("balance"), ">=", 5)).select("node_id")


@query("where_or", "SELECT 'C:' || c_custkey AS node_id FROM customer WHERE c_mktsegment = 'BUILDING' OR floor(c_acctbal / 1000) < 0")
def _(spark, d):
    n = graph(spark, d).nodes_of_type("party.Customer")
    return n.where(S.compare_string(S.prop("segment"), "==", "BUILDING") | S.compare_int(S.prop("balance"), "<", 0)).select("node_id")


@query("where_not", "SELECT 'C:' || c_custkey AS node_id FROM customer WHERE NOT c_mktsegment = 'BUILDING'")
def _(spark, d):
    return graph(spark, d).nodes_of_type("party.Customer").where(~S.compare_string(S.prop("segment"), "==", "BUILDING")).select("node_id")


@query("cmp_int", "SELECT doc_id, coalesce(TRY_CAST(substr(source, 4) AS INTEGER) >= 7, false) AS ge7, coalesce(TRY_CAST(lang AS INTEGER) != 1, false) AS nonnumeric FROM documents")
def _(spark, d):
    t = views.table(spark, d, "documents")
    return t.select("doc_id", S.compare_int(F.substring("source", 4, 9), ">=", 7).alias("ge7"), S.compare_int(F.col("lang"), "!=", 1).alias("nonnumeric"))


@query("cmp_str", "SELECT doc_id, lang = 'de' AS is_de, lang != 'de' AS not_de, false AS less FROM documents")
def _(spark, d):
    t = views.table(spark, d, "documents")
    return t.select("doc_id", *(S.compare_string(F.col("lang"), op, "de").alias(n) for op, n in (("==", "is_de"), ("!=", "not_de"), ("<", "less"))))


@query("in_list", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent FROM orders")
def _(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", S.text("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent"))


@query("not_in_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def _(spark, d):
    return views.table(spark, d, "orders").where(~S.text("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("is_concept", f"WITH {CFG} SELECT concept = 'audit' AS is_audit, count(*) AS n FROM cfg GROUP BY 1")
def _(spark, d):
    return views.cfg_labels(spark, d).groupBy((F.col("concept") == "audit").alias("is_audit")).agg(F.count("*").alias("n"))


@query("ref_exists", "SELECT 'O:' || o_orderkey AS node_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    g = graph(spark, d)
    return g.nodes_of_type("event.Order").join(g.nodes.select(F.col("node_id").alias("ref")), S.prop("customer") == F.col("ref"), "left_semi").select("node_id")


@query("ref_deref", "SELECT 'O:' || o_orderkey AS node_id, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    g = graph(spark, d)

    def hop(df, prop):
        n = g.nodes.select(F.col("node_id").alias("to"), F.col("props").alias("next"))
        return df.join(n, S.prop(prop) == F.col("to")).select("node_id", F.col("next").alias("props"))

    out = hop(hop(hop(g.nodes_of_type("event.Order").select("node_id", "props"), "customer"), "nation"), "region")
    return out.select("node_id", S.prop("name").alias("region"))


@query("ref_scalar", "SELECT 'O:' || o_orderkey AS node_id, o_orderpriority AS priority FROM orders")
def _(spark, d):
    return graph(spark, d).nodes_of_type("event.Order").select("node_id", S.prop("priority").alias("priority"))


@query("holds_asset_kind", "SELECT 'P:' || p_partkey AS node_id FROM part WHERE list_has_any(['BRASS', 'TIN'], [upper(p_type), upper(p_brand)]) OR p_brand = 'Brand#11'")
def _(spark, d):
    n = graph(spark, d).nodes_of_type("asset.Part")
    kinds = F.transform(F.split(F.concat_ws(", ", S.prop("kind"), S.prop("brand")), ","), lambda x: F.upper(F.trim(x)))
    return n.where(F.arrays_overlap(kinds, F.array(*map(F.lit, ("BRASS", "TIN", "BRAND#11"))))).select("node_id")


@query("expr_operators", "SELECT page_id, url LIKE 'https:%' AS https, contains(url, 'example.net') AS has_net, ends_with(url, '/') AS slash, regexp_matches(url, '[?&]page=[0-9]+') AS paged FROM pages")
def _(spark, d):
    u = F.col("url")
    return views.table(spark, d, "pages").select("page_id", S.sure(F.startswith(u, F.lit("https:"))).alias("https"), S.sure(F.contains(u, F.lit("example.net"))).alias("has_net"), S.sure(F.endswith(u, F.lit("/"))).alias("slash"), S.sure(u.rlike("[?&]page=[0-9]+")).alias("paged"))


@query("named_matcher", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'blue') OR contains(p_name, 'green') OR p_type IN ('TIN') OR regexp_matches(p_brand, '^Brand#1[0-3]$')")
def _(spark, d):
    any_of = F.exists(F.array(F.lit("blue"), F.lit("green")), lambda x: F.contains(F.col("p_name"), x))
    return views.table(spark, d, "part").where(S.sure(any_of | F.col("p_type").isin("TIN") | F.col("p_brand").rlike("^Brand#1[0-3]$"))).select("p_partkey", "p_name")


@query("query_predicates", f"WITH {CFG} SELECT count(*) AS n FROM cfg WHERE contains(callee_path, 'm1') AND contains(loc, ':3') AND contains(concept, 'and')")
def _(spark, d):
    rows = views.cfg(spark, d).join(views.cfg_labels(spark, d).select("node_id", "concept"), "node_id")
    return rows.where(F.contains("callee_path", F.lit("m1")) & F.contains("loc", F.lit(":3")) & F.contains("concept", F.lit("and"))).agg(F.count("*").alias("n"))


@query("callee_key", f"WITH {CFG} SELECT node_id, CASE WHEN ord % 3 = 0 THEN callee_path WHEN ord % 3 = 1 THEN '.' || method ELSE 'code.Call' END AS callee FROM cfg")
def _(spark, d):
    c = views.cfg(spark, d)
    path, method = F.when(F.col("ord") % 3 == 0, F.col("callee_path")).otherwise(""), F.when(F.col("ord") % 3 < 2, F.col("method")).otherwise("")
    return c.select("node_id", S.callee_key(path, method, F.col("node_type")).alias("callee"))


@query("definitions_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND contains(source, '1') ORDER BY doc_id LIMIT 25")
def _(spark, d):
    return views.table(spark, d, "documents").where((F.col("lang") == "fr") & F.contains("source", F.lit("1"))).select("doc_id", "lang").orderBy("doc_id").limit(25)


# ---- scalar functions


@query("fn_locations", f"WITH {CFG} SELECT node_id, regexp_extract(loc, '^(.+):[^:]*$', 1) AS file, CAST(ord AS INTEGER) AS line, '/fn' || okey AS fn, region AS scope FROM cfg")
def _(spark, d):
    return views.cfg(spark, d).select("node_id", S.loc_file("loc").alias("file"), S.loc_line("loc").alias("line"), S.function_scope_key("scope", "region").alias("fn"), S.lexical_scope_key("scope", "region").alias("scope"))


@query("fn_regions", f"WITH {CFG} SELECT node_id, CASE WHEN ord % 3 = 2 THEN '/fn' || okey END AS loop_parent, region || '#fn9' || ';' || region AS chain FROM cfg")
def _(spark, d):
    c = views.cfg(spark, d)
    return c.select("node_id", S.nearest_loop_parent("region").alias("loop_parent"), F.concat_ws(";", S.region_scope_chain(F.concat("region", F.lit("#fn9")))).alias("chain"))


@query("fn_names", f"WITH {CFG} SELECT DISTINCT callee_path, 'svc.m' || (okey % 50) AS receiver, method AS last, okey % 50 = 3 AS seg, contains(callee_path, 'm3') AS sub FROM cfg")
def _(spark, d):
    p = F.col("callee_path")
    return views.cfg(spark, d).select("callee_path", S.receiver_prefix(p).alias("receiver"), S.last_segment(p).alias("last"), S.segments_match(p, F.lit("m3")).alias("seg"), S.segments_match(p, F.lit("m3"), "contains").alias("sub")).distinct()


@query("fn_packages", "SELECT p_partkey, lower(p_brand) AS norm, lower(p_brand) AS root FROM part")
def _(spark, d):
    raw = F.concat(F.lit("\""), F.col("p_brand"), F.lit("[extra]\""))
    return views.table(spark, d, "part").select("p_partkey", S.normalize_package(raw).alias("norm"), S.package_root(F.concat(F.col("p_brand"), F.lit("/x/y"))).alias("root"))


@query("fn_versions", "SELECT p_partkey, CASE WHEN p_size < 20 THEN -1 WHEN p_size > 20 THEN 1 ELSE 0 END AS cmp, p_size >= 10 AND p_size < 30 AS allowed, p_size = 20 OR p_size = 21 AS compatible FROM part")
def _(spark, d):
    v = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0"))
    near = F.concat(F.lit("1.2"), (F.col("p_size") % 10).cast("string"))
    t = views.table(spark, d, "part")
    return t.select("p_partkey", S.compare_versions(v, F.lit("1.20")).alias("cmp"), S.specifier_allows(F.lit(">=1.10, <1.30"), v).alias("allowed"), (S.specifier_allows(F.lit("~=1.20"), F.when(F.col("p_size").isin(20, 21), near).otherwise(F.lit("2.0")))).alias("compatible"))


@query("edit_distance_le1", "SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) = 1")
def _(spark, d):
    names = views.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = names.select("name", F.explode(S.deletions("name")).alias("cut"))
    other = pairs.select(F.col("name").alias("near"), "cut")
    return pairs.join(other, "cut").where("name < near").select("name", "near").distinct().where(S.edit_distance_le1("name", "near")).select(F.col("name").alias("a"), F.col("near").alias("b"))


@query("char_classes", "SELECT doc_id, CAST(regexp_matches(text, '[a-z]') AS INTEGER) + CAST(regexp_matches(text, '[A-Z]') AS INTEGER) + CAST(regexp_matches(text, '[0-9]') AS INTEGER) + CAST(regexp_matches(text, '[^a-zA-Z0-9]') AS INTEGER) AS classes FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", S.char_classes("text").alias("classes"))


@query("action_matches", f"WITH {STEP_SQL} SELECT ability, (ability = 'ship:R*') AS covers, count(*) AS n FROM steps GROUP BY ability")
def _(spark, d):
    s = views.steps(spark, d)
    return s.groupBy("ability").agg(F.count("*").alias("n")).select("ability", S.action_matches("ability", F.lit("ship:Return")).alias("covers"), "n")


@query("template_vars", "SELECT event_id, event_type || ',user' AS vars FROM events")
def _(spark, d):
    e = views.table(spark, d, "events")
    t = F.concat(F.lit("<p>{{ "), F.col("event_type"), F.lit(" }} {{user.name}} {{user}}</p>"))
    return e.select("event_id", F.concat_ws(",", S.template_vars(t)).alias("vars"))


@query("severity_mappings", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'error' WHEN o_orderpriority = '3-MEDIUM' THEN 'warning' ELSE 'note' END AS level, CASE o_orderpriority WHEN '1-URGENT' THEN '9.5' WHEN '2-HIGH' THEN '8.0' WHEN '3-MEDIUM' THEN '5.5' ELSE '0.0' END AS score, 'external/cwe/cwe-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS tag FROM orders")
def _(spark, d):
    p = F.col("o_orderpriority")
    s = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("none")
    return views.table(spark, d, "orders").select("o_orderkey", S.severity_level(s).alias("level"), S.security_severity(s).alias("score"), S.cwe_tag(F.col("o_orderkey") % 1000).alias("tag"))


@query("hash_id", "SELECT doc_id, substr(sha256(lang || chr(0) || source || chr(0) || doc_id), 1, 16) AS id, sha256('lang=' || lang || chr(0) || 'source=' || source) AS props FROM documents")
def _(spark, d):
    t = views.table(spark, d, "documents")
    return t.select("doc_id", S.hash_id("lang", "source", F.col("doc_id").cast("string")).alias("id"), S.map_hash(F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))).alias("props"))


@query("render_context_label", "SELECT o_orderkey, 'reaches O:' || o_orderkey || ' (' || o_orderstatus || ')' AS label FROM orders")
def _(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", S.render_label("reaches {target} ({kinds})", views.ident("O", "o_orderkey"), "o_orderstatus").alias("label"))


@query("graph_stats", f"WITH {FLOWS}, deg AS (SELECT dst, count(*) AS n FROM flows GROUP BY dst) SELECT (SELECT count(*) FROM flows) AS n_edges, (SELECT count(DISTINCT src) FROM flows) AS n_src, (SELECT count(*) FROM deg WHERE n >= 8) AS hubs, (SELECT max(n) FROM deg) AS max_in")
def _(spark, d):
    from ..storage import materialize

    f = materialize(views.flows(spark, d).select("src", "dst"), "flows")
    into = f.groupBy("dst").agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col("n") >= 8, 1).otherwise(0)).alias("hubs"), F.max("n").alias("max_in"))
    return f.agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src")).crossJoin(F.broadcast(into))  # one row each


@query("fn_semver", "SELECT p_partkey, v >= [1, 10, 0] AND v < [1, 40, 0] OR v = [1, 5, 2] AS spread, v[2] >= 10 AS caret, v[2] = 20 AND v[3] >= 1 AS tilde FROM (SELECT p_partkey, [1, p_size, p_partkey % 4] AS v FROM part)")
def _(spark, d):
    """Version ranges with alternatives, carets and tildes."""
    version = F.concat_ws(".", F.lit("v1"), F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("string"))
    of = lambda r: S.semver_satisfies(F.lit(r), version)
    return views.table(spark, d, "part").select("p_partkey", of(">=1.10 <1.40 || 1.5.2").alias("spread"), of("^1.10").alias("caret"), of("~1.20.1").alias("tilde"))


@query("fn_map_hash", "SELECT o_orderkey, sha256('cust=' || o_custkey || chr(0) || 'none=' || chr(0) || 'status=' || o_orderstatus) AS h FROM orders")
def _(spark, d):
    """A hash of properties, whatever their order in the map."""
    props = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    return views.table(spark, d, "orders").select("o_orderkey", S.map_hash(props).alias("h"))
