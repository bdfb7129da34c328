import pytest
from pyspark.sql import functions as F

from lattica.functions import regions as R
from lattica.functions import scalars as S


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, _i int").orderBy("_i").select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_dominates(spark):
    rows = [("/fn1", 3, "/fn1", 7, True), ("/fn1", 9, "/fn1", 4, False), ("/fn1", 2, "/fn1/if5.t", 6, True), ("/fn1/if5.t", 4, "/fn1", 9, False), ("/fn1/if5.t", 4, "/fn1/if5.e", 6, False), ("/fn1/if5.t", 4, "/fn1/if5.t/loop8", 9, True), ("/fn1", 2, "/fn2", 3, False), ("/fn1", 2, "/fn10", 9, False), ("", 1, "", 2, False), (None, 1, "/fn1", 2, True), ("/fn1", None, "/fn1", 2, False)]
    got = values(spark, rows, "gr string, go int, sr string, so int, want boolean", got=R.dominates(F.col("gr"), F.col("go"), F.col("sr"), F.col("so")), want=F.col("want"))
    assert all(a == b for a, b in got), got


def test_may_precede(spark):
    rows = [("/fn1", 2, "", "/fn1", 5, "", True), ("/fn1", 5, "", "/fn1", 2, "", False), ("/fn1", 2, "", "/fn1/if3.t", 6, "", True), ("/fn1/if3.t", 2, "", "/fn1", 6, "", True), ("/fn1/if3.t", 2, "", "/fn1/if3.e", 6, "", False), ("/fn1", 2, "", "/fn2", 6, "", False), ("/fn1#fn2", 2, "", "/fn1", 6, "", True), ("/fn1", 2, "", "/fn1#fn2", 6, "", True), ("/fn1#fn2", 6, "", "/fn1", 2, "", False), ("/fn1#fn2#fn3", 2, "", "/fn1", 9, "", True), ("/fn1#fn2", 2, "", "/fn1/if3.t", 6, "", True), ("/fn4#fn5", 2, "", "/fn1#fn2", 6, "", False), ("/fn1/if3.t#fn4", 2, "", "/fn1/if3.e", 6, "", False), ("", 10, "app:10", "", 20, "app:20", True), ("", 10, "app:10", "", 30, "other:30", False)]
    c = F.col
    got = values(spark, rows, "ar string, ao int, al string, br string, bo int, bl string, want boolean", got=R.may_precede(c("ar"), c("ao"), c("al"), c("br"), c("bo"), c("bl")), same=R.function_root(c("ar")) == R.function_root(c("br")), want=c("want"))
    assert all(a == b for a, _, b in got), got
    # the join key never separates what may precede
    assert all(same for a, same, _ in got if a)


def test_post_dominates(spark):
    rows = [("/fn1", 5, "/fn1", 2, True), ("/fn1", 5, "/fn1/if3.t", 2, True), ("/fn1/if3.t", 5, "/fn1", 2, False), ("/fn1/if3.e", 5, "/fn1/if3.t", 2, False), ("/fn1", 2, "/fn1", 5, False), ("", 1, "", 2, False)]
    got = values(spark, rows, "rr string, ro int, ar string, ao int, want boolean", got=R.post_dominates(F.col("rr"), F.col("ro"), F.col("ar"), F.col("ao")), want=F.col("want"))
    assert all(a == b for a, b in got), got


def test_scopes(spark):
    rows = [("/fn1/if2.t@x", "", "/fn1", "/fn1/if2.t", None), ("", "/a/fn3/loop4/b", "/a/fn3", "/a/fn3/loop4/b", "/a/fn3"), ("", "/loop1/x/loop2/y", "", "/loop1/x/loop2/y", "/loop1/x"), ("", "loop1", "", "loop1", "/"), ("m/", "", "", "m", None), (None, None, "", "", None)]
    got = values(spark, rows, "scope string, region string, fn string, lex string, up string", fn=S.function_scope_key("scope", "region"), fn2=F.col("fn"), lex=S.lexical_scope_key("scope", "region"), lex2=F.col("lex"), up=S.nearest_loop_parent("region"), up2=F.col("up"))
    assert all(a == b and c == d and e == f for a, b, c, d, e, f in got), got
    (chain, above), = values(spark, [("/a#b#c",)], "r string", chain=S.region_scope_chain("r"), above=S.scope_ancestors(F.lit("/p/q/r")))
    assert chain == ["/a#b#c", "/a#b", "/a"] and set(above) >= {"/p/q/r", "/p/q", "/p"}


def test_versions(spark):
    rows = [("5.5.0", "5.10.0", -1), ("5.10.1", "5.10.0", 1), ("v1.2", "1.2.0", 0), ("2.0rc1", "2.0", 0), ("", "0", 0)]
    assert [a == b for a, b in values(spark, rows, "a string, b string, want int", got=S.compare_versions("a", "b"), want=F.col("want"))] == [True] * len(rows)
    rows = [(">=0.1.5", "0.1.6", True), ("==0.1.5", "0.1.6", False), (">=0.1.5,<=0.1.5", "0.1.6", False), ("*", "0.1.6", True), ("", "9", True), ("~=1.4.2", "1.4.9", True), ("~=1.4.2", "1.5.0", False), ("!=2", "2.0", False), ("1.0 | 2", "1.0", False), ("<2;>1", "1.5", True)]
    got = values(spark, rows, "s string, v string, want boolean", got=S.specifier_allows("s", F.col("v")), want=F.col("want"))
    assert all(a == b for a, b in got), got


def test_strings(spark):
    rows = [("Random", "Random.secure", True), ("Random", "SecureRandom", False), ("a.b", "x.a.b.c", True), ("a.c", "x.a.b.c", False)]
    assert all(a == b for a, b in values(spark, rows, "v string, p string, want boolean", got=S.segments_match(F.col("p"), F.col("v")), want=F.col("want")))
    rows = [("*", "x", True), ("s3:GetObject*", "s3:GetObjectAcl", True), ("s3:GetObject*", "s3:DeleteObject", False), ("s3:GetObject", "s3:GetObject", True), ("own", "", True), ("", "x", False)]
    assert all(a == b for a, b in values(spark, rows, "a string, w string, want boolean", got=S.action_matches("a", F.col("w")), want=F.col("want")))
    rows = [("react", "reacts", True), ("react", "raect", False), ("react", "react", False), ("a", "", True)]
    assert all(a == b for a, b in values(spark, rows, "a string, b string, want boolean", got=S.edit_distance_le1("a", "b"), want=F.col("want")))
    got = values(spark, [("9",), ("7",), ("6",), ("high",), (None,)], "v string", got=S.compare_int(F.col("v"), ">=", 7), other=S.compare_int(F.col("v"), "!=", 7))
    assert got == [(True, True), (True, False), (False, True), (False, False), (False, False)]
    (got,) = values(spark, [('"@Scope/Name[x]"',)], "n string", a=S.normalize_package("n"), b=S.package_root("n"), c=S.package_stems(F.lit("a.b/c")), d=S.callee_key(F.lit(""), F.lit("m"), F.lit("t")), e=S.template_vars(F.lit("{{ x }}{{y}} {{x}}")), f=S.char_classes(F.lit("aB3")))
    assert got == ("@scope/name", "@scope/name", ["a", "a.b", "a.b/c"], ".m", ["x", "y"], 3)


@pytest.mark.parametrize("severity,level", [("critical", "error"), ("medium", "warning"), ("odd", "note")])
def test_levels(spark, severity, level):
    assert spark.range(1).select(S.severity_level(F.lit(severity))).first()[0] == level
