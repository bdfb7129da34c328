"""Structured control flow as predicates over regions (paths of segments) and orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import loc_file, region_scope_chain, sure, text


def inside(inner: Column, outer: Column) -> Column:
    """The same region, or one nested in it."""
    return (inner == outer) | F.startswith(inner, F.concat(outer, F.lit("/")))


def function_root(region: Column) -> Column:
    """The first segment without inline bodies: regions that nest have the same one, so it is a join key."""
    return F.regexp_extract(text(region), r"^(/?[^/#]*)", 1)


def dominates(g_region, g_ord, s_region, s_ord) -> Column:
    g, s = text(g_region), text(s_region)
    return sure(((g != "") | (s != "")) & inside(s, g) & (g_ord < s_ord))


def post_dominates(r_region, r_ord, a_region, a_ord) -> Column:
    r, a = text(r_region), text(a_region)
    return sure((r != "") & (a != "") & inside(a, r) & (r_ord > a_ord))


def sequenced(a: Column, b: Column) -> Column:
    """Some region of a's chain of inline bodies nests with one of b's."""
    return F.exists(region_scope_chain(a), lambda x: F.exists(region_scope_chain(b), lambda y: inside(x, y) | inside(y, x)))


def may_precede(a_region, a_ord, a_loc, b_region, b_ord, b_loc) -> Column:
    a, b = text(a_region), text(b_region)
    same_file = (loc_file(a_loc) != "") & (loc_file(a_loc) == loc_file(b_loc))
    placed = F.when((a == "") & (b == ""), same_file).otherwise((a != "") & (b != "") & sequenced(a, b))
    return sure(placed & (a_ord < b_ord))
