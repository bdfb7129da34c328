"""Which sources of a language differ, and by which terms: sums over distinct count vectors.

1. Python counts the terms of a document once, adds what its task has seen of
   a (lang, source, term), and sends sums of counts and documents on.
2. A term's occurrences in the sources of a language are its vector: the pairs
   (source, count) with a count above 0, in order of the sources. Terms in
   fewer than ``min_docs`` documents of a language go.
3. Terms of a language with one vector are alike to every pair of sources. So
   vectors are grouped, and each is evaluated once for every pair and counts
   as often as it has terms.
4. The pairs are dealt in tiles of TILE x TILE sources and, within a tile, in
   slices of about SLICE vectors; a group of a tile and a slice is bounded. A
   pair has a fixed divergence at a term that neither source holds; it counts
   for all terms, and the vectors add what they have beyond it. So vectors
   that are empty in all of a tile's sources need not be sent to it.
5. Ranked are the sources of every pair, and the original terms.

Sums are exact: shares are integers out of SCALE, by division with remainder
in steps that stay within 64 bits up to 9 * 10^15 occurrences in a language.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialize

#: Documents of a language that a kept term is in; added to every count; terms of a group that are returned.
MIN_DOCS, PRIOR, TOP = 10, 2, 10
SCALE = 10**9
#: (lang, source, term) that a task adds up before it sends them on.
HELD = 200_000
#: Sources on a side of a tile; vectors of a slice; vectors that are evaluated together.
TILE, SLICE, BLOCK = 64, 1 << 13, 256
#: Runs of bytes that are ASCII letters or part of a character beyond ASCII; bytes, as every text is UTF-8.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_LOW = bytes.maketrans(_UPPER, _LOWER)

COUNTS = StructType([StructField("lang", StringType()), StructField("source", StringType()), StructField("term", StringType()), StructField("n", LongType()), StructField("docs", LongType())])
PAIRS = StructType([StructField("lang", StringType()), StructField("a", LongType()), StructField("b", LongType()), StructField("value", LongType())])


def _count(most: int):
    """The function for mapInArrow: COUNTS of whole texts, added up until ``most`` are held."""

    def run(batches):
        schema = to_arrow_schema(COUNTS)
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out():
            for (lang, source), (n, docs) in seen.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array([t.decode("utf-8", "surrogatepass") for t in terms]), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], schema=schema
                )

        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                n, docs = seen.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                own = Counter(_TERM.findall(text.as_buffer().to_pybytes().translate(_LOW)))
                held -= len(n)
                n.update(own)
                docs.update(own.keys())
                held += len(n)
                if held > most:
                    yield from out()
                    seen, held = {}, 0
        yield from out()

    return run


def term_vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, vector) of kept terms; vector: (source, n) of the sources that hold it, in order."""
    counts = docs.mapInArrow(_count(HELD), COUNTS)
    # one shuffle: what is dealt by (lang, term) is grouped by (lang, term, source) and then by (lang, term) where it lies
    counts = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return terms.where(F.col("docs") >= min_docs).select("lang", "term", "vector")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total), for count <= total, in three steps of a thousand; no product leaves 64 bits."""
    steps, rest = [], count
    for _ in range(3):
        steps.append(F.call_function("div", rest * 1000, total))
        rest = (rest * 1000) % total
    return steps[0] * 1_000_000 + steps[1] * 1000 + steps[2] + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile(tile: int):
    """The function for a cogroup: what a slice's vectors add to the divergence of each pair of a tile's sources, beyond that of a term which neither holds."""

    def evaluate(key, vectors: pa.Table, sources: pa.Table) -> pa.Table:
        lang, low, high, _ = (k.as_py() for k in key)
        ids, zero = (sources.column(c).to_numpy() for c in ("id", "zero"))
        order = np.argsort(ids)
        ids, zero = ids[order], zero[order]
        sides = [np.flatnonzero(ids // tile == k) for k in (low, high)]
        p0, q0 = zero[sides[0]][:, None], zero[sides[1]][None, :]
        empty = (p0 - q0) * (p0 - q0) // (p0 + q0)
        total = np.zeros_like(empty)
        if len(vectors):
            names, first, row = np.unique(vectors.column("vector_id").to_numpy(), return_index=True, return_inverse=True)
            size, column, held = vectors.column("size").to_numpy()[first], np.searchsorted(ids, vectors.column("id").to_numpy()), vectors.column("p").to_numpy()
            by_row = np.argsort(row, kind="stable")
            row, column, held = row[by_row], column[by_row], held[by_row]
            for at in range(0, len(names), BLOCK):
                end = min(at + BLOCK, len(names))
                a, b = np.searchsorted(row, [at, end])
                dense = np.tile(zero, (end - at, 1))
                dense[row[a:b] - at, column[a:b]] = held[a:b]
                p, q = dense[:, sides[0], None], dense[:, None, sides[1]]
                f = (p - q) * (p - q) // (p + q) - empty
                total += (f * size[at:end, None, None]).sum(axis=0)
        a, b = (x.ravel() for x in np.meshgrid(ids[sides[0]], ids[sides[1]], indexing="ij"))
        keep = (a < b) & (total.ravel() != 0)
        columns = [np.full(int(keep.sum()), lang, dtype=object), a[keep], b[keep], total.ravel()[keep]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(PAIRS))], schema=to_arrow_schema(PAIRS))

    return evaluate


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): of each source the other sources of its language (part 'pair') and its ``top`` terms above the language's share (part 'term').

    Null texts, languages and sources are empty. A document is a row: repeated
    rows count each. A group without kept terms has its pairs, with value 0.
    Ties are ranked by the item's UTF-8 bytes. Other columns are ignored; an
    empty table gives an empty result.
    """
    narrow = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    terms = materialize(term_vectors(narrow, min_docs).withColumn("n_lang", F.aggregate("vector", F.lit(0).cast("long"), lambda a, e: a + e.n)), "term-vectors")
    langs = terms.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("v"), F.sum("n_lang").alias("n_all"))
    entries = terms.select("lang", "term", "n_lang", F.explode("vector").alias("e")).select("lang", "term", "n_lang", "e.source", "e.n")
    sums = entries.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("total"))
    groups = narrow.select("lang", "source").distinct().join(langs, F.col("lang") == F.col("l"), "left").drop("l")
    groups = groups.join(sums, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").drop("l", "s").fillna(0, ["v", "n_all", "total"])
    groups = groups.select("lang", "source", "v", (F.col("total") + PRIOR * F.col("v")).alias("base"), (F.col("n_all") + PRIOR * F.col("v")).alias("lang_base"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("id"))
    groups = materialize(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(PRIOR).cast("long"), F.col("base")))), "sources")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = _pair_values(terms, groups).withColumn("rank", F.row_number().over(order))
    ranked = _term_values(entries, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(ranked)


def _pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Every pair of a language's sources, in both orders: what its vectors say, each evaluated once, and the rest of the terms."""
    vectors = terms.groupBy("lang", "vector").agg(F.count("*").alias("size"))
    vectors = materialize(vectors.withColumn("vector_id", F.monotonically_increasing_id()), "vectors")
    slices = vectors.groupBy(F.col("lang").alias("l")).agg((F.floor(F.count("*") / SLICE) + 1).alias("slices"))
    last = groups.groupBy(F.col("lang").alias("g")).agg(F.floor(F.max("id") / TILE).alias("last"))
    shape = slices.join(last, F.col("l") == F.col("g")).drop("g")

    def tiled(rows: DataFrame) -> DataFrame:
        block = F.floor(F.col("id") / TILE)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        return rows.withColumn("low", F.least(block, "other")).withColumn("high", F.greatest(block, "other"))

    shaped = groups.join(shape, F.col("lang") == F.col("l")).drop("l")
    # a row for each source, the shape of its language with it: vectors meet it by language and source
    named = shaped.select(F.col("lang").alias("l"), F.col("source").alias("s"), "id", "base", "slices", "last")
    held = vectors.select("lang", "vector_id", "size", F.explode("vector").alias("e")).select("lang", "vector_id", "size", "e.source", "e.n")
    held = held.join(named, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))).drop("l", "s")
    held = tiled(held).select("lang", "low", "high", F.pmod(F.xxhash64("vector_id"), F.col("slices")).alias("slice"), "vector_id", "size", (F.col("id") + 0).alias("id"), share(F.col("n") + PRIOR, F.col("base")).alias("p"))
    sources = tiled(shaped).select("lang", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "id", "zero")
    keys = ["lang", "low", "high", "slice"]
    summed = held.groupBy(keys).cogroup(sources.groupBy(keys)).applyInArrow(_tile(TILE), PAIRS).groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    summed = summed.withColumnRenamed("lang", "sl")
    mine = groups.select("lang", "source", "v", "id", "zero")
    other = groups.select(F.col("lang").alias("ol"), F.col("source").alias("item"), F.col("id").alias("oid"), F.col("zero").alias("ozero"))
    pairs = mine.join(other, (F.col("lang") == F.col("ol")) & (F.col("id") != F.col("oid")))
    pairs = pairs.withColumn("x", F.least("id", "oid")).withColumn("y", F.greatest("id", "oid"))
    pairs = pairs.join(summed, (F.col("lang") == F.col("sl")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left")
    value = F.coalesce("more", F.lit(0)) + F.coalesce(F.col("v") * divergence(F.col("zero"), F.col("ozero")), F.lit(0))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))


def _term_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Every term of a source whose share is above that in the language."""
    named = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "base", "lang_base")
    held = entries.join(named, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    held = held.select("lang", "source", "term", share(F.col("n") + PRIOR, F.col("base")).alias("p"), share(F.col("n_lang") + PRIOR, F.col("lang_base")).alias("q")).where("p > q")
    return held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
