"""Mixing sources to target weights, by DataFrame functions alone.

Leaves are (domain, language, source). A token budget is dealt from the root
down: each node's budget goes to its children in proportion to their weights;
no child gets more than its capacity, the tokens of its leaves times the number
of epochs allowed; what a child cannot take goes to its siblings by their
weights, and only what all siblings cannot take is left to the ancestors. As
capacities are summed up the tree first, one pass down does this: a node never
gets more than its leaves hold, so its shortage was dealt among its siblings
before anything was dealt below them.

Each leaf takes a prefix, by tokens, of seeded epochs: whole epochs, then the
documents of the next one in the order of a seeded hash until the budget is
reached. The prefix's end is found from sums over ranges of the hash (a few
thousand documents each), so a leaf with a third of all rows is never sorted
as a whole; documents then compare their own hash with their leaf's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SEED, SHARE, MAX_EPOCHS = 17, (6, 10), 2
#: Documents in a range of the hash, about.
RANGE_ROWS = 4096
#: Bits of the hash.
_BITS = 60

#: Production parameters: the domain of each source (others: "forum"), and weights by path; ``*`` is any domain; 1 where no path fits.
DOMAINS = {"src0": "crawl"} | {f"src{i}": "books" for i in range(1, 7)} | {f"src{i}": "wiki" for i in range(7, 13)}
DEFAULT_DOMAIN = "forum"
WEIGHTS = {("crawl",): 4, ("books",): 3, ("wiki",): 2, ("forum",): 1, ("*", "en"): 5, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 1, ("wiki", "es"): 2, ("books", "en", "src1"): 3}


def tokens_of(text: Column) -> Column:
    """Words as the unit of budgets; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key] if table else F.lit(None)


def _weight(weights: dict, level: int) -> Column:
    """The weight of a node of the level (0: domain), by its path, else by its path with any domain, else 1."""
    names = ["domain", "language", "src"][: level + 1]
    flat = {"\x1f".join(k): v for k, v in weights.items() if len(k) == level + 1}
    path = F.concat_ws("\x1f", *names)
    wild = F.concat_ws("\x1f", F.lit("*"), *names[1:])
    return F.coalesce(_lookup(flat, path), _lookup(flat, wild), F.lit(1)).cast("long")


def deal(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """children (parents.., name, weight, capacity, total = the parent's budget) with the budget of each."""
    by_ratio = Window.partitionBy(*parents, F.lit(0)).orderBy(F.col("capacity").cast("double") / F.col("weight"), name)
    group = Window.partitionBy(*parents, F.lit(0))
    before = F.coalesce(F.sum("capacity").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    from_here = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    ranked = children.withColumn("_before", before).withColumn("_weights", from_here)
    ranked = ranked.withColumn("_full", F.col("capacity") * F.col("_weights") <= (F.col("total") - F.col("_before")) * F.col("weight"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group)
    dealt = ranked.withColumn("_left", left).withColumn("_open", open_weight)
    # the floor of each share: at most one token a child stays undealt
    return dealt.withColumn("budget", F.expr("CASE WHEN _full THEN capacity ELSE least(capacity, (_left * weight) div _open) END").cast("long")).drop("_before", "_weights", "_full", "_left", "_open")


def budgets(leaves: DataFrame, weights: dict, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves (domain, language, src, n, tokens) with the budget of each."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    languages = leaves.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
    domains = languages.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg(F.expr(f"least(coalesce(sum(tokens), 0) * {share[0]} div {share[1]}, coalesce(sum(capacity), 0))").cast("long").alias("total"))
    d = deal(domains.crossJoin(F.broadcast(total)).withColumn("weight", _weight(weights, 0)), [], "domain")  # one row on the right
    d = d.select("domain", F.col("budget").alias("total"))
    lang = deal(languages.join(d, "domain").withColumn("weight", _weight(weights, 1)), ["domain"], "language")
    lang = lang.select("domain", "language", F.col("budget").alias("total"))
    return deal(leaves.join(lang, ["domain", "language"]).withColumn("weight", _weight(weights, 2)), ["domain", "language"], "src").drop("total", "weight", "capacity")


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def plan(docs: DataFrame, seed: int, weights: dict, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """For each leaf: budget, whole epochs, the next epoch, and the last place of its prefix. ``docs``: doc_id, tokens, digest, domain, language, src."""
    leaf = ["domain", "language", "src"]
    leaves = docs.groupBy(*leaf).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    dealt = budgets(materialize(leaves, "leaves"), weights, share, max_epochs)
    dealt = dealt.withColumn("whole", F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END").cast("int"))
    dealt = dealt.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).withColumn("bits", F.expr(f"cast(greatest(0, ceil(log2(n / {RANGE_ROWS}))) as int)"))
    dealt = materialize(dealt, "budgets")
    # the prefix's end, for the leaves that take part of an epoch
    part = docs.join(dealt.where("rest > 0").drop("n").withColumnRenamed("tokens", "leaf_tokens"), leaf)
    place = F.struct(_key(seed, F.col("whole") + 1, F.col("doc_id")).alias("key"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("tokens").alias("t"), F.col("digest").alias("d"))
    part = part.select(*leaf, "tokens", "rest", "bits", place.alias("place")).withColumn("range", F.expr(f"shiftright(place.key, {_BITS} - bits)"))
    sums = part.groupBy(*leaf, "rest", "range").agg(F.sum("tokens").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy(*leaf).orderBy("range"))
    last = materialize(sums.withColumn("upto", upto).where("upto - sum < rest and rest <= upto").select(*leaf, "range", (F.col("upto") - F.col("sum")).alias("before")), "ranges")
    # one range a leaf: that in which its prefix ends
    edge = part.join(last, [*leaf, "range"])
    until = F.col("before") + F.coalesce(F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = edge.withColumn("until", until).where("until < rest").groupBy(*leaf).agg(F.max("place").alias("end"))
    ends = ends.select(*(F.col(c).alias(f"_{c}") for c in leaf), "end")
    same = (F.col("domain") == F.col("_domain")) & (F.col("language") == F.col("_language")) & (F.col("src") == F.col("_src"))
    return materialize(dealt.join(ends, same, "left").select(*leaf, F.col("budget").alias("leaf_budget"), "whole", "end"), "mixture")


def _measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, domains: dict, default: str, keep: list) -> DataFrame:
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), tokens_of(text).alias("tokens"), F.xxhash64(text).alias("digest"), F.coalesce(_lookup(domains, src), F.lit(default)).alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("language"), src.alias("src"), *keep)


def mix(docs: DataFrame, weights: dict | None = None, domains: dict | None = None, default_domain: str = DEFAULT_DOMAIN, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rows: bool = False) -> DataFrame:
    """A row for each time a document is taken: doc_id, epoch, domain, language, src, n_tokens, leaf_budget; with rows, the documents themselves.

    The budget is ``share`` of all tokens. A document belongs to an epoch's
    prefix if the tokens before it are fewer than the leaf's rest. Documents
    without words (null, empty or blank texts) take nothing and stay with the
    prefix they fall into; a leaf that has no others gives none. A null
    language or source is an empty name. Repeated rows stand at one place and
    are taken together. Weights are positive integers. Other columns are
    ignored; an empty table gives an empty result.
    """
    weights, domains = WEIGHTS if weights is None else weights, DOMAINS if domains is None else domains
    measure = lambda keep: _measured(docs, id_col, text_col, lang_col, source_col, domains, default_domain, keep)
    small = materialize(measure([]), "measured")
    chosen = plan(small, seed, weights, share, max_epochs)
    source = measure([F.struct(*docs.columns).alias("row")]) if rows else small
    met = source.join(chosen, ["domain", "language", "src"])
    place = F.struct(_key(seed, F.col("whole") + 1, F.col("doc_id")).alias("key"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("tokens").alias("t"), F.col("digest").alias("d"))
    taken = F.col("whole") + F.when(F.col("end").isNotNull() & (place <= F.col("end")), 1).otherwise(0)
    met = met.withColumn("taken", taken).where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("taken"))))
    if rows:
        return met.select(*(F.col("row")[c].alias(c) for c in docs.columns))
    return met.select("doc_id", F.col("epoch").cast("int").alias("epoch"), "domain", "language", "src", F.col("tokens").alias("n_tokens"), "leaf_budget")
