"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit; two are linked at 3 or fewer differing bits, and then
one of their 32-bit halves differs in at most one bit. On each half the
anchors are the words of a covering code: the perfect Hamming code of length
31 (covering radius 1) with one free bit. Every fingerprint goes to its
nearest anchor (at distance 1 at most) as its home, and is replicated to all
anchors within covering radius plus the half's threshold, that is 2: at most
17 of 2^27. If x and y differ in at most one bit of the half, then y lies
within 2 of x's home, so the two meet there; each anchor compares homes with
replicas on all 64 bits. No pair is lost, and no list of candidates is kept.

Equal fingerprints are one row from the start, so that thousands of copies
cost nothing here. A fingerprint has at most 43,744 others within 3 bits, and
only linked pairs leave the join.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import id_and_text, map_columns, materialize, utf8
from .components import connected_components

SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Shingles whose bits are unpacked at a time.
BLOCK = 1 << 14


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Space-joined runs of words of the text with A-Z lower-cased; of fewer words the whole sequence."""
    words = utf8(text).lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each shingle, repeats included."""
    found = shingles(text, size)
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(seed)), dtype="<u8", count=len(found))


def vote(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half of the hashes. Without any: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16 if BLOCK < 65536 else np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's shingles. Without words: 0."""
    return vote(hashes(text, size, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, digest) of each document; fp is the fingerprint as a signed long, digest Spark's xxhash64 of the text."""
    docs = id_and_text(docs, id_col, text_col)
    schema = StructType([docs.schema["doc_id"], StructField("fp", LongType()), StructField("digest", LongType())])

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def make():
        return lambda ids, texts: {"doc_id": ids, "fp": [signed(fingerprint(t)) for t in texts], "digest": [SEED if t is None else signed(xxhash.xxh64_intdigest(utf8(t), SEED)) for t in texts]}

    return map_columns(docs, schema, make)


def _syndrome(half: Column) -> Column:
    """Of bits 0 to 30 under the Hamming code whose bit i has the column i + 1; 0 for a code word."""
    masks = [sum(1 << i for i in range(31) if (i + 1) >> j & 1) for j in range(5)]
    return sum((F.bit_count(half.bitwiseAND(F.lit(m))) % 2 * (1 << j) for j, m in enumerate(masks)), F.lit(0))


def _bit(at: Column) -> Column:
    """The word with bit ``at`` set; 0 for -1."""
    return F.when(at < 0, F.lit(0).cast("long")).otherwise(F.expr("1L").cast("long") * F.pow(F.lit(2.0), at).cast("long"))


def home(half: Column) -> Column:
    """The nearest code word: at distance 1 at most."""
    return half.bitwiseXOR(_bit(_syndrome(half) - 1))


def anchors(half: Column) -> Column:
    """All code words within 2 of the half (a long under 2^32).

    With s the syndrome: for s = 0 the word itself, and with the free bit
    flipped. Else flip bit s; flip it and the free bit; or flip two bits whose
    columns sum to s, i and i xor s: 15 choices.
    """
    s = _syndrome(half)
    free = F.lit(1 << 31)
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (i.bitwiseXOR(s) > i) & (i != s) & (s != 0))
    two = F.transform(pairs, lambda i: half.bitwiseXOR(_bit(i - 1)).bitwiseXOR(_bit(i.bitwiseXOR(s) - 1)))
    return F.concat(F.array(home(half), home(half).bitwiseXOR(free)), two)


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints within the threshold. ``distinct``: fp."""
    if threshold > 3:
        raise ValueError("the anchors cover thresholds up to 3")
    sides = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    # few bytes, but many replicas: all cores make them
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    halves = spread.select("fp", F.posexplode(sides).alias("side", "half"))
    key = F.col("side").cast("long") * F.lit(1 << 32)
    homes = halves.select(F.col("fp").alias("x"), (key + home(F.col("half"))).alias("at"))
    replicas = halves.select(F.col("fp").alias("y"), F.explode(F.transform(anchors(F.col("half")), lambda c: c + key)).alias("anchor"))
    met = homes.join(replicas, (F.col("at") == F.col("anchor")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold) & (F.col("x") != F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root, links) of each distinct fingerprint: its component's smallest fingerprint and its number of links. ``prints``: fp."""
    distinct = prints.select("fp").distinct()
    pairs = materialize(links(distinct, threshold), "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    linked = connected_components(pairs).withColumnRenamed("node", "fp").join(degree, "fp")
    # only linked fingerprints have a root; any other is a component of its own
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, fp, fingerprint (16 hex digits), component_id, links.

    component_id is the smallest doc_id that can be reached over linked
    fingerprints, the document's own included; links is the number of other
    fingerprints within the threshold. Documents without words (null, empty or
    blank) share the fingerprint zero, which is linked like any other. Null ids
    stay, but name no component that has an id. Repeated rows stay. Other
    columns are ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    known = materialize(classes(prints, threshold), "classes")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(known, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    known = materialize(known.join(first, "root").select(F.col("fp").alias("k"), "component_id", "links"), "classes")
    out = prints.join(known, prints.fp == known.k)
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The documents without near copies, columns as they are.

    Of each component the row with the smallest id stays (a null id only where
    there is no other); of several rows with that id, the one with the smaller
    digest of its text; of rows with equal id and text, one.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    known = materialize(classes(prints, threshold), "classes").withColumnRenamed("fp", "k")
    return representatives(docs, prints, known, id_col, text_col)


def representatives(docs: DataFrame, prints: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row that stays of each group. ``prints``: doc_id, fp, digest; ``known``: k (an fp), root."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"))
    ranked = prints.groupBy("fp").agg(F.min(rank).alias("best")).join(known, F.col("fp") == F.col("k"))
    best = ranked.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("best_id"), F.col("best.digest").alias("best_digest"))
    best = materialize(best, "representatives")
    columns = docs.columns
    # ids that may be null as two keys that are not: the join and the window then deal the texts in the same way, once
    keys = lambda i, digest: (F.col(i).isNull().alias("none"), F.coalesce(F.col(i).cast("string"), F.lit("")).alias("key"), digest.alias("digest"))
    rows = docs.select(F.struct(*columns).alias("row"), *keys(id_col, F.xxhash64(F.col(text_col).cast("string"))))
    kept = rows.join(best.select(*keys("best_id", F.col("best_digest"))), ["none", "key", "digest"], "left_semi")
    window = Window.partitionBy("none", "key", "digest").orderBy(F.xxhash64("row"))
    return kept.withColumn("place", F.row_number().over(window)).where("place = 1").select(*(F.col("row")[c].alias(c) for c in columns))
