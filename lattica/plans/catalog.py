"""Registry of the graph engine's queries and their SQL counterparts."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_MODULES = ("scans", "joins", "ranking", "rules", "solving", "flowing", "binding", "texts", "sources")


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) and the SQL for its rows."""

    def register(fn):
        assert name not in _QUERIES, name
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"lattica.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


# ---- common table expressions of the graph views, for the SQL side

NODES = """nodes AS (
  SELECT 'R:' || r_regionkey AS node_id, 'org.Region' AS node_type, 'org.Region:' || r_regionkey AS loc FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'org.Nation', 'org.Nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'party.Customer', 'party.Customer:' || c_custkey FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'party.Supplier', 'party.Supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'P:' || p_partkey, 'asset.Part', 'asset.Part:' || p_partkey FROM part
  UNION ALL SELECT 'O:' || o_orderkey, 'event.Order', 'event.Order:' || o_orderkey FROM orders)"""
NET = """net AS (
  SELECT 'R:' || n_regionkey AS src, 'N:' || n_nationkey AS dst, CASE WHEN n_nationkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto FROM nation
  UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'any' ELSE 'tcp' END FROM customer
  UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, 'tcp' FROM supplier
  UNION ALL SELECT DISTINCT 'S:' || l_suppkey, 'P:' || l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'tcp' ELSE 'udp' END FROM lineitem)"""
STEPS = """steps AS (
  SELECT 'C:' || o_custkey AS src, 'O:' || o_orderkey AS dst, 'order:' || o_orderstatus AS ability FROM orders
  UNION ALL SELECT DISTINCT 'O:' || l_orderkey, 'S:' || l_suppkey, 'ship:' || l_returnflag || '*' FROM lineitem
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'own' FROM supplier)"""
FLOWS = """flows AS (
  SELECT 'C:' || o_custkey AS src, 'O:' || o_orderkey AS dst FROM orders
  UNION ALL SELECT DISTINCT 'O:' || l_orderkey, 'P:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'O:' || l_orderkey, 'S:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier)"""
CFG = """cfg AS (
  SELECT DISTINCT 'L:' || l_orderkey || ':' || l_linenumber || ':' || l_returnflag AS node_id,
    '/fn' || l_orderkey || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '/if1.t' ELSE '/loop1.b' END AS region,
    l_linenumber AS ord, 'order' || l_orderkey || ':' || l_linenumber AS loc, lower(l_returnflag) AS method,
    'svc.m' || (l_orderkey % 50) || '.' || lower(l_returnflag) AS callee_path, l_returnflag AS flag, l_orderkey AS okey,
    CASE l_returnflag WHEN 'R' THEN 'candidate' WHEN 'N' THEN 'check' ELSE 'audit' END AS concept,
    CASE WHEN l_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN l_linenumber % 2 = 0 THEN 'syntactic' ELSE 'semantic' END AS fidelity,
    list_extract(['dominates', 'endpoint', 'postDominates', 'sameScope', 'sameReceiver'], l_linenumber % 5 + 1) AS coverage,
    l_orderkey % 7 = 0 AS advisory
  FROM lineitem)"""


def guards(part: str) -> str:
    return f"g AS (SELECT * FROM cfg WHERE concept = 'check' AND NOT advisory AND coverage = '{part}')"
