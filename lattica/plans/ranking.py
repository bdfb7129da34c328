"""Aggregation, ranking, identity, confidence, priority and comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bind, findings
from ..sources import views
from .catalog import CFG, query


def order_findings(spark, d):
    """Orders as findings of a rule for each status."""
    o = views.table(spark, d, "orders")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    confidence = F.when(F.col("o_orderkey") % 3 == 0, "high").when(F.col("o_orderkey") % 3 == 1, "medium").otherwise("low")
    return o.select(F.concat(F.lit("rule-"), "o_orderstatus").alias("rule_id"), F.col("o_custkey").alias("sink"), severity.alias("severity"), confidence.alias("confidence"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 4).cast("int").alias("witness_length"), S.fingerprint(o=F.col("o_orderkey").cast("string")).alias("fp"))


F_SQL = "f AS (SELECT 'rule-' || o_orderstatus AS rule_id, o_custkey AS sink, list_extract(['critical', 'high', 'medium', 'low', 'info'], CAST(substr(o_orderpriority, 1, 1) AS INT)) AS severity, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS c, o_orderkey AS seq, o_orderkey % 4 AS witness_length, substr(sha256('o=' || o_orderkey), 1, 16) AS fp FROM orders)"


@query("finding_per_sink", f"WITH {F_SQL} SELECT rule_id, sink, seq FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, sink ORDER BY c DESC, seq) AS n FROM f) WHERE n = 1")
def _(spark, d):
    return findings.per_sink(order_findings(spark, d)).select("rule_id", "sink", "seq")


@query("finding_dedup", f"WITH {F_SQL} SELECT rule_id, sink, fp FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, sink ORDER BY c DESC, p, witness_length, fp) AS n FROM f) WHERE n = 1")
def _(spark, d):
    return findings.dedup(order_findings(spark, d), ["rule_id", "sink"]).select("rule_id", "sink", "fp")


@query("finding_fingerprint", "SELECT o_orderkey, substr(sha256('rule=' || o_orderstatus || '|loc=O:' || o_orderkey || '|concept='), 1, 16) AS fp FROM orders")
def _(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", S.fingerprint(rule="o_orderstatus", loc=views.ident("O", "o_orderkey"), concept=F.lit(None).cast("string")).alias("fp"))


@query("finding_fingerprint_legacy", "SELECT o_orderkey, substr(sha256(o_orderstatus || '::a=C:' || o_custkey || '|b=O:' || o_orderkey), 1, 16) AS fp FROM orders")
def _(spark, d):
    parts = F.concat(F.col("o_orderstatus"), F.lit("::"), F.concat_ws("|", F.concat(F.lit("a="), views.ident("C", "o_custkey")), F.concat(F.lit("b="), views.ident("O", "o_orderkey"))))
    return views.table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(parts, 256), 1, 16).alias("fp"))


def proposals(spark, d):
    """Orders propose labels on customers."""
    o = views.table(spark, d, "orders")
    k = F.col("o_orderkey")
    pick = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (m + 1).cast("int"))
    return o.select(
        views.ident("C", "o_custkey").alias("node_id"), F.concat(F.lit("k"), "o_orderstatus").alias("concept"), k.alias("app_seq"), (k % 3).cast("int").alias("specificity"),
        pick(findings.FIDELITIES, k % 3).alias("fidelity"), pick(findings.ORIGINS[:3] + ("tenant",), F.when(k % 97 == 0, 3).otherwise(k % 2)).alias("origin"), (k % 11 == 0).alias("negative"), F.lit("high").alias("confidence"),
    )


P_SQL = "p AS (SELECT 'C:' || o_custkey AS node_id, 'k' || o_orderstatus AS concept, o_orderkey AS app_seq, o_orderkey % 3 AS specificity, o_orderkey % 3 + 1 AS fid, CASE WHEN o_orderkey % 97 = 0 THEN 4 ELSE o_orderkey % 2 + 1 END AS org, o_orderkey % 97 = 0 AS tenant, o_orderkey % 11 = 0 AS negative FROM orders)"
R_SQL = """best AS (SELECT *, row_number() OVER (PARTITION BY node_id, concept, negative ORDER BY specificity DESC, fid DESC, org DESC, app_seq) AS n FROM p),
yes AS (SELECT * FROM best WHERE n = 1 AND NOT negative), no AS (SELECT * FROM best WHERE n = 1 AND negative),
ten AS (SELECT node_id, concept, bool_or(negative) AS neg FROM p WHERE tenant GROUP BY ALL),
won AS (SELECT yes.node_id, yes.concept, yes.app_seq FROM yes LEFT JOIN no USING (node_id, concept) LEFT JOIN ten USING (node_id, concept)
  WHERE CASE WHEN ten.neg IS NOT NULL THEN NOT ten.neg ELSE no.node_id IS NULL OR (yes.specificity, yes.fid, yes.org, -yes.app_seq) > (no.specificity, no.fid, no.org, -no.app_seq) END)"""


@query("binding_precedence", f"WITH {P_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY node_id, concept ORDER BY specificity DESC, fid DESC, org DESC, app_seq) AS n FROM p) SELECT node_id, concept, app_seq FROM b WHERE n = 1")
def _(spark, d):
    return findings.ranked_proposals(proposals(spark, d)).where("place = 1").select("node_id", "concept", "app_seq")


@query("negative_claim_resolution", f"WITH {P_SQL}, {R_SQL} SELECT * FROM won")
def _(spark, d):
    return findings.resolve(proposals(spark, d))[0].select("node_id", "concept", "app_seq")


@query("tiered_label_merge", f"WITH {P_SQL}, {R_SQL} SELECT concept, count(*) AS attached FROM won GROUP BY concept")
def _(spark, d):
    return findings.resolve(proposals(spark, d))[0].groupBy("concept").agg(F.count("*").alias("attached"))


@query("tenant_override", f"WITH {P_SQL}, {R_SQL} SELECT p.node_id, p.concept, count(*) AS suppressed FROM p LEFT JOIN won USING (node_id, concept, app_seq) WHERE NOT negative AND won.node_id IS NULL GROUP BY ALL")
def _(spark, d):
    w = findings.resolve(proposals(spark, d))[1]
    return w.groupBy("node_id", "concept").agg(F.count("*").alias("suppressed"))


@query("confidence_min", f"WITH {CFG} SELECT okey, CAST(min(CASE WHEN fidelity = 'syntactic' THEN 2 WHEN confidence = 'high' THEN 3 ELSE 2 END) AS INTEGER) AS confidence_rank FROM cfg WHERE concept = 'candidate' GROUP BY okey")
def _(spark, d):
    ranks = findings.node_confidence(views.cfg_labels(spark, d), "candidate")
    return ranks.join(views.cfg(spark, d).select("node_id", "okey"), "node_id").groupBy("okey").agg(F.min("confidence_rank").alias("confidence_rank"))


@query("confidence_floor", f"WITH {F_SQL} SELECT seq FROM f WHERE c >= 2")
def _(spark, d):
    return order_findings(spark, d).where(S.rank("confidence", findings.CONFIDENCES) >= 2).select("seq")


@query("source_confidence_ceiling", f"WITH {F_SQL} SELECT seq, CAST(CASE WHEN sink % 2 = 0 THEN least(c, 1) ELSE c END AS INTEGER) AS confidence_rank, CASE WHEN sink % 2 = 0 THEN 'base,source' ELSE 'base' END AS review FROM f")
def _(spark, d):
    rank, conditional = S.rank("confidence", findings.CONFIDENCES), F.col("sink") % 2 == 0
    review = F.when(conditional, F.array_append(F.array(F.lit("base")), F.lit("source"))).otherwise(F.array(F.lit("base")))
    return order_findings(spark, d).select("seq", F.when(conditional, F.least(rank, F.lit(1))).otherwise(rank).alias("confidence_rank"), F.concat_ws(",", review).alias("review"))


@query("label_provenance_pick", "SELECT 'C:' || o_custkey AS node_id, arg_min(o_orderkey, (-(o_orderkey % 5)) * 1000000000 + o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def _(spark, d):
    o = views.table(spark, d, "orders").select(views.ident("C", "o_custkey").alias("node_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 5).alias("provenance_priority"))
    return findings.provenance_pick(o).select("node_id", "seq")


@query("review_conditions", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus || '/' || o_orderpriority, ';' ORDER BY o_orderstatus || '/' || o_orderpriority) AS conditions FROM orders GROUP BY o_custkey")
def _(spark, d):
    o = views.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.struct(F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("condition")))).alias("r"))
    return o.select("o_custkey", F.array_join(F.transform("r", lambda x: F.concat(x["category"], F.lit("/"), x["condition"])), ";").alias("conditions"))


PRIORITY = "pr AS (SELECT *, CASE p WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END + CASE WHEN seq % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN seq % 3 = 0 THEN 2 ELSE 0 END AS total FROM f)"


def prioritised(spark, d):
    f = order_findings(spark, d).withColumn("exposed", F.col("seq") % 2 == 0).withColumn("asset", F.col("seq") % 3 == 0)
    return findings.priority(f, {"exposed": 2, "asset": 2})


@query("priority_score", f"WITH {F_SQL}, {PRIORITY} SELECT seq, CAST(total AS INTEGER) AS total, CASE WHEN total >= 7 THEN 'P1' WHEN total >= 5 THEN 'P2' WHEN total >= 3 THEN 'P3' ELSE 'P4' END AS band FROM pr")
def _(spark, d):
    return prioritised(spark, d).select("seq", "total", "band")


@query("priority_sort", f"WITH {F_SQL}, {PRIORITY} SELECT rule_id, seq, CAST(total AS INTEGER) AS total FROM pr ORDER BY total DESC, rule_id, seq LIMIT 50")
def _(spark, d):
    return prioritised(spark, d).orderBy(F.col("total").desc(), "rule_id", "seq").limit(50).select("rule_id", "seq", "total")


@query("gate_count", f"WITH {F_SQL} SELECT CAST(sum(CASE WHEN p <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_at_or_above, CAST(max(6 - p) AS INTEGER) AS max_rank FROM f")
def _(spark, d):
    return findings.gate(order_findings(spark, d), "high")


@query("flag_dedup", f"WITH {CFG} SELECT DISTINCT concept, loc, callee_path, method FROM cfg WHERE concept <> 'audit'")
def _(spark, d):
    c = views.cfg(spark, d).join(views.cfg_labels(spark, d).select("node_id", "concept"), "node_id")
    return c.where("concept <> 'audit'").select("concept", "loc", "callee_path", "method").dropDuplicates()


@query("resolve_stats", f"WITH {CFG} SELECT CAST(sum(CASE WHEN flag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS unresolved, CAST(sum(CASE WHEN flag <> 'A' THEN 1 ELSE 0 END) AS BIGINT) AS resolved FROM cfg")
def _(spark, d):
    c = views.cfg(spark, d)
    known = views.cfg_labels(spark, d).where("concept <> 'audit'").select("node_id", F.lit(1).alias("k"))
    m = c.join(known, "node_id", "left")
    return m.agg(F.sum(F.when(F.col("k").isNull(), 1).otherwise(0)).alias("unresolved"), F.sum(F.when(F.col("k").isNotNull(), 1).otherwise(0)).alias("resolved"))


@query("coverage_stats", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 3")
def _(spark, d):
    return views.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(3)


@query("profile_detect", "WITH s AS (SELECT source, count(*) FILTER (lang = 'en') > 0 AND count(*) FILTER (lang = 'de') = 0 AS eng, count(*) FILTER (lang = 'de') > 0 AS mixed, count(*) > 40 AS big FROM documents GROUP BY source) SELECT source, CASE WHEN mixed AND big THEN 'mixed' WHEN big THEN 'large' WHEN mixed THEN 'mixed' WHEN eng THEN 'english' ELSE 'none' END AS profile FROM s")
def _(spark, d):
    s = views.table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"), F.count("*").alias("n"))
    has = lambda x: F.array_contains("langs", x)
    score = {"english": ((has("en") & ~has("de")).cast("int"), 1), "mixed": (has("de").cast("int") + (has("de") & (F.col("n") > 40)).cast("int"), 2), "large": ((F.col("n") > 40).cast("int"), 3)}
    best = F.array_max(F.array(*(F.struct(v.alias("score"), F.lit(p).alias("priority"), F.lit(k).alias("name")) for k, (v, p) in score.items())))
    return s.select("source", F.when(best["score"] > 0, best["name"]).otherwise("none").alias("profile"))


@query("benchmark_score", "WITH c AS (SELECT lang, quality = 0 AS truth, length(text) - length(replace(text, '!', '')) > 3 OR length(text) < 400 AS found FROM labels JOIN documents USING (doc_id)), m AS (SELECT lang, count(*) FILTER (truth AND found) AS tp, count(*) FILTER (truth AND NOT found) AS fn, count(*) FILTER (NOT truth AND found) AS fp, count(*) FILTER (NOT truth AND NOT found) AS tn FROM c GROUP BY lang) SELECT lang, tp, fn, fp, tn, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END - CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS j FROM m")
def _(spark, d):
    x = views.table(spark, d, "labels").join(views.table(spark, d, "documents"), "doc_id")
    marks = F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))
    return findings.youden(x.select("lang", (F.col("quality") == 0).alias("truth"), ((marks > 3) | (F.length("text") < 400)).alias("found")), "lang", "truth", "found")


@query("fanout_collapse", "SELECT user_id, event_type, CAST(max(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS INTEGER) AS verdict FROM events GROUP BY user_id, event_type")
def _(spark, d):
    return views.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max((F.col("value") > 50).cast("int")).alias("verdict"))


@query("bucket_recall", "SELECT lang, count(DISTINCT CASE WHEN toxic = 1 THEN doc_id END) AS truth, count(DISTINCT CASE WHEN toxic = 1 AND quality = 0 THEN doc_id END) AS found FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def _(spark, d):
    x = views.table(spark, d, "labels").join(views.table(spark, d, "documents"), "doc_id")
    return x.groupBy("lang").agg(F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("truth"), F.countDistinct(F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.col("doc_id"))).alias("found"))


@query("top_kinds", f"WITH {CFG} SELECT concept, callee_path, CAST(n AS BIGINT) AS n FROM (SELECT concept, callee_path, count(*) AS n, row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, callee_path) AS r FROM cfg GROUP BY concept, callee_path) WHERE r <= 3")
def _(spark, d):
    c = views.cfg(spark, d).join(views.cfg_labels(spark, d).select("node_id", "concept"), "node_id").groupBy("concept", "callee_path").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy(F.col("n").desc(), "callee_path"))).where("r <= 3").select("concept", "callee_path", "n")


# ---- binding


def calls(spark, d):
    return views.cfg(spark, d).select("node_id", "method", "callee_path", (F.col("line") % 4).alias("n_args"), F.array(F.concat(F.col("node_id"), F.lit("#0")), F.concat(F.col("node_id"), F.lit("#1"))).alias("args"))


def matchers(spark):
    return spark.sql("select * from values ('r', 'sink', 1, cast(null as int), ''), ('n', 'check', cast(null as int), 2, 'm3'), ('a', 'fact', 0, 0, 'svc.m4') as t(method, concept, min_args, max_args, receiver)")


B_SQL = "b AS (SELECT node_id, 'sink' AS concept FROM cfg WHERE method = 'r' AND ord % 4 >= 1 UNION ALL SELECT node_id, 'check' FROM cfg WHERE method = 'n' AND ord % 4 <= 2 AND okey % 50 = 3 UNION ALL SELECT node_id, 'fact' FROM cfg WHERE method = 'a' AND ord % 4 = 0 AND okey % 50 = 4)"


@query("bind_call_method", f"WITH {CFG}, {B_SQL} SELECT node_id, concept FROM b")
def _(spark, d):
    return bind.bind_by_method(calls(spark, d), matchers(spark))


@query("bind_call_path", f"WITH {CFG} SELECT node_id, 'three' AS concept FROM cfg WHERE okey % 50 = 3 AND method = 'r'")
def _(spark, d):
    return bind.bind_by_path(views.cfg(spark, d), "m3.r", "three")


@query("bind_presence", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src0' AND lang <> 'de'")
def _(spark, d):
    t = views.table(spark, d, "documents").withColumn("tokens", F.array("lang", "source"))
    return bind.bind_presence(t, "tokens", any_of=["en", "fr"], none_of=["src0", "de"]).select("doc_id")


@query("bind_arity", f"WITH {CFG} SELECT node_id FROM cfg WHERE ord % 4 BETWEEN 1 AND 2")
def _(spark, d):
    return calls(spark, d).where("n_args between 1 and 2").select("node_id")


@query("bind_literal", "SELECT page_id FROM pages WHERE contains(url, 'example') AND contains(url, '/en/') AND NOT contains(url, '?')")
def _(spark, d):
    return views.table(spark, d, "pages").where(bind.literals(F.col("url"), ["example", "/en/"], ["?"])).select("page_id")


@query("bind_receiver_type", f"WITH {CFG} SELECT node_id FROM cfg WHERE okey % 50 IN (1, 2) OR ord % 5 = 0")
def _(spark, d):
    # an unresolved receiver still matches
    c = views.cfg(spark, d).withColumn("recv_pkg", F.when(F.col("ord") % 5 == 0, "").otherwise(S.receiver_prefix("callee_path")))
    return c.where((F.col("recv_pkg") == "") | F.array_contains(F.array(F.lit("svc.m1"), F.lit("svc.m2")), F.col("recv_pkg"))).select("node_id")


@query("bind_soft_requirement", f"WITH {CFG} SELECT node_id, CASE WHEN okey % 4 = 0 THEN confidence WHEN confidence = 'high' THEN 'medium' ELSE 'low' END AS confidence FROM cfg")
def _(spark, d):
    c = views.cfg(spark, d).join(views.cfg_labels(spark, d).select("node_id", "confidence"), "node_id")
    return c.select("node_id", bind.soften(F.col("confidence"), F.when(F.col("okey") % 4 == 0, True)).alias("confidence"))


@query("emit_label", f"WITH {CFG}, {B_SQL} SELECT node_id || '#1' AS node_id, concept FROM b")
def _(spark, d):
    c = calls(spark, d)
    return bind.emit_labels(bind.bind_by_method(c, matchers(spark)).join(c.select("node_id", "args"), "node_id"), "args", 1)


@query("emit_label_any", f"WITH {CFG}, {B_SQL} SELECT node_id || '#' || i AS node_id, concept FROM b, (VALUES (0), (1)) v(i)")
def _(spark, d):
    c = calls(spark, d)
    return bind.emit_labels(bind.bind_by_method(c, matchers(spark)).join(c.select("node_id", "args"), "node_id"), "args")


@query("emit_check_coverage", f"WITH {CFG} SELECT node_id, coverage, CASE WHEN advisory THEN 'true' ELSE 'false' END AS advisory FROM cfg WHERE concept = 'check'")
def _(spark, d):
    return views.cfg_labels(spark, d).where("concept = 'check'").select("node_id", F.element_at("detail", F.lit("coverage")).alias("coverage"), F.element_at("detail", F.lit("advisory")).alias("advisory"))


@query("propagate_flow", f"WITH {CFG} SELECT node_id || '#0' AS src, node_id || '#1' AS dst FROM cfg WHERE method = 'r'")
def _(spark, d):
    c = calls(spark, d).where(S.path_suffix_matches("callee_path", F.lit("r")))
    return c.select(F.element_at("args", 1).alias("src"), F.element_at("args", 2).alias("dst"))


@query("path_suffix_match", f"WITH {CFG} SELECT DISTINCT callee_path FROM cfg WHERE callee_path = 'svc.m7.r' OR ends_with(callee_path, '.n')")
def _(spark, d):
    p = F.col("callee_path")
    return views.cfg(spark, d).where(S.path_suffix_matches(p, F.lit("svc.m7.r")) | S.path_suffix_matches(p, F.lit("n"))).select("callee_path").distinct()


@query("call_edges", "SELECT DISTINCT 'fn' || (o_custkey % 20) AS caller, 'fn' || (o_orderkey % 30) AS callee FROM orders WHERE o_custkey % 20 <> o_orderkey % 30")
def _(spark, d):
    o = views.table(spark, d, "orders")
    k, fn = F.col("o_orderkey"), lambda c, m: F.concat(F.lit("fn"), (F.col(c) % m).cast("string"))
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    args = o.select(name("arg").alias("node_id"), fn("o_custkey", 20).alias("fn"))
    params = o.where("o_orderstatus = 'F'").select(name("param").alias("node_id"), fn("o_orderkey", 30).alias("fn"))
    returns = o.where("o_orderstatus <> 'F'").select(name("ret").alias("node_id"), fn("o_orderkey", 30).alias("fn"))
    flows = o.select(name("arg").alias("src"), name("param").alias("dst")).union(o.select(name("ret").alias("src"), name("arg").alias("dst")))
    return bind.call_edges(args, params, returns, flows)
