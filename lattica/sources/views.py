"""The driver's tables as a property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def band(column: str):
    """A balance as an integer: thousands, rounded down."""
    return F.floor(F.col(column) / 1000).cast("string")


def _props(**columns):
    return F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), F.coalesce(v.cast("string") if not isinstance(v, str) else F.col(v).cast("string"), F.lit("")))))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, node_type, loc, props of regions, nations, customers, suppliers, parts and orders."""
    t = lambda n: table(spark, sf_dir, n)
    make = lambda df, prefix, key, node_type, **p: df.select(ident(prefix, key).alias("node_id"), F.lit(node_type).alias("node_type"), F.concat(F.lit(f"{node_type}:"), F.col(key).cast("string")).alias("loc"), _props(**p).alias("props"))
    parts = [
        make(t("region"), "R", "r_regionkey", "org.Region", name="r_name"),
        make(t("nation"), "N", "n_nationkey", "org.Nation", name="n_name", region=ident("R", "n_regionkey")),
        make(t("customer"), "C", "c_custkey", "party.Customer", segment="c_mktsegment", nation=ident("N", "c_nationkey"), balance=band("c_acctbal")),
        make(t("supplier"), "S", "s_suppkey", "party.Supplier", nation=ident("N", "s_nationkey"), balance=band("s_acctbal")),
        make(t("part"), "P", "p_partkey", "asset.Part", brand="p_brand", kind="p_type", size="p_size", name="p_name"),
        make(t("orders"), "O", "o_orderkey", "event.Order", customer=ident("C", "o_custkey"), status="o_orderstatus", priority="o_orderpriority"),
    ]
    return reduce(DataFrame.unionByName, parts)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items have no key: their distinct (order, line, part, supplier, flag)."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()


def _distinct(rows: DataFrame, repeats: bool) -> DataFrame:
    """Line items name an edge more than once; where edges are dealt anyway (storage.dealt), that takes the repeats out."""
    return rows if repeats else rows.distinct()


def net(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """edge_type NET, src, dst, rule, proto: region - nation - customer or supplier - part."""
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, src, dst, rule, proto: df.select(src.alias("src"), dst.alias("dst"), F.lit(rule).alias("rule"), proto.alias("proto"))
    even = lambda c: F.when(F.col(c) % 2 == 0, "tcp").otherwise("udp")
    parts = [
        edge(t("nation"), ident("R", "n_regionkey"), ident("N", "n_nationkey"), "region-nation", even("n_nationkey")),
        edge(t("customer"), ident("N", "c_nationkey"), ident("C", "c_custkey"), "nation-customer", F.when(F.col("c_custkey") % 3 == 0, "any").otherwise("tcp")),
        edge(t("supplier"), ident("N", "s_nationkey"), ident("S", "s_suppkey"), "nation-supplier", F.lit("tcp")),
        edge(_distinct(t("lineitem").select("l_suppkey", "l_partkey"), repeats), ident("S", "l_suppkey"), ident("P", "l_partkey"), "supplier-part", even("l_partkey")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("edge_type", F.lit("NET"))


def steps(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """edge_type STEP, src, dst, ability: customer - order - supplier - nation."""
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, src, dst, ability: df.select(src.alias("src"), dst.alias("dst"), ability.alias("ability"))
    parts = [
        edge(t("orders"), ident("C", "o_custkey"), ident("O", "o_orderkey"), F.concat(F.lit("order:"), F.col("o_orderstatus"))),
        edge(_distinct(t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag"), repeats), ident("O", "l_orderkey"), ident("S", "l_suppkey"), F.concat(F.lit("ship:"), F.col("l_returnflag"), F.lit("*"))),
        edge(t("supplier"), ident("S", "s_suppkey"), ident("N", "s_nationkey"), F.lit("own")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("edge_type", F.lit("STEP"))


def flows(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """edge_type FLOWS, src, dst: customer - order - part or supplier - nation."""
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, src, dst: df.select(src.alias("src"), dst.alias("dst"))
    parts = [
        edge(t("orders"), ident("C", "o_custkey"), ident("O", "o_orderkey")),
        edge(_distinct(t("lineitem").select("l_orderkey", "l_partkey"), repeats), ident("O", "l_orderkey"), ident("P", "l_partkey")),
        edge(_distinct(t("lineitem").select("l_orderkey", "l_suppkey"), repeats), ident("O", "l_orderkey"), ident("S", "l_suppkey")),
        edge(t("supplier"), ident("S", "s_suppkey"), ident("N", "s_nationkey")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("edge_type", F.lit("FLOWS"))


def cfg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of line items that cfg and its labels are made of; rows may repeat."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")


def call_id() -> Column:
    """The node_id of a row of cfg_rows."""
    return F.concat(F.lit("L:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_returnflag"))


def cfg(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Line items as calls in structured code: node_id, region, ord, loc, scope, callee_path, method, flag, line, okey.

    ``rows``: distinct rows of cfg_rows, perhaps with their node_id: where they were dealt by it, joins by node_id use their buckets.
    """
    k, order = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    root = F.concat(F.lit("/fn"), order)
    region = F.when(k % 3 == 0, root).when(k % 3 == 1, F.concat(root, F.lit("/if1.t"))).otherwise(F.concat(root, F.lit("/loop1.b")))
    distinct = cfg_rows(spark, sf_dir).distinct() if rows is None else rows
    return distinct.select(
        (F.col("node_id") if "node_id" in distinct.columns else call_id()).alias("node_id"), F.lit("code.Call").alias("node_type"),
        region.alias("region"), k.cast("int").alias("ord"), F.concat(F.lit("order"), order, F.lit(":"), k.cast("string")).alias("loc"), region.alias("scope"),
        F.concat(F.lit("svc.m"), (F.col("l_orderkey") % 50).cast("string"), F.lit("."), F.lower("l_returnflag")).alias("callee_path"), F.lower("l_returnflag").alias("method"),
        F.col("l_returnflag").alias("flag"), k.cast("int").alias("line"), F.col("l_orderkey").alias("okey"),
    )


def cfg_labels(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Labels on cfg: flag R is ``candidate``, N is ``check`` with a coverage by line, A is ``audit``; every seventh order's are advisory."""
    coverage = F.element_at(F.array(*map(F.lit, ("dominates", "endpoint", "postDominates", "sameScope", "sameReceiver"))), (F.col("line") % 5 + 1).cast("int"))
    concept = F.when(F.col("flag") == "R", "candidate").when(F.col("flag") == "N", "check").otherwise("audit")
    detail = F.create_map(F.lit("coverage"), coverage, F.lit("advisory"), F.when(F.col("okey") % 7 == 0, "true").otherwise("false"))
    return cfg(spark, sf_dir, rows).select(
        "node_id", concept.alias("concept"), F.when(F.col("okey") % 2 == 0, "high").otherwise("medium").alias("confidence"),
        F.when(F.col("line") % 2 == 0, "syntactic").otherwise("semantic").alias("fidelity"), detail.alias("detail"),
    )


def text_lines(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return table(spark, sf_dir, name).select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")
