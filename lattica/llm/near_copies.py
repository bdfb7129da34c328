"""Near copies by SimHash and exact Jaccard similarity of word shingles, for the pipeline.

Two texts are linked where their sets of five-word shingles have a Jaccard
similarity of 4/5 or more. Texts whose SimHashes of these shingles differ in 3
bits or less meet first, by op1's anchors, and are checked on whole sets. At
that similarity 64-bit SimHashes differ in about 10 bits, give or take 3, and no
covering of so wide a radius is selective; so what SimHash can't link meets by
a prefix filter after it, which loses none. Under any fixed order of all
shingles, two sets of that similarity share one of their first n - ceil(4n/5)
+ 1 shingles. The order puts shingles last that are common in the tasks that
count them; an estimate changes how many pairs meet, never the result.

Groups, not pairs, are wanted: after SimHash each set is compared with one leader of
every shingle it shares with another group, twice with different leaders; then all pairs that
meet and are not yet in one group. A pair is first held against bounds that
lose none. Sets whose first shared shingle is the i-th of one share at most its
n - i last shingles; and the parities of a set's shingles over a number of
buckets differ in no more buckets than the sets differ in shingles. What passes
is checked on whole sets. Shingles are 64-bit hashes, and equal sets are one
row from the start.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import id_and_text, map_columns, materialize, utf8
from .components import connected_components
from .simhash import SEED, hashes, links as simhash_links, representatives, vote

#: Words of a shingle; a pair is linked from SIMILAR[0] / SIMILAR[1] on.
SHINGLE, SIMILAR = 5, (4, 5)
#: Counters of the order's estimate.
COUNTERS = 1 << 20
#: Buckets of the parities, in 64-bit words.
WORDS = 16
PARITIES = [f"p{w}" for w in range(WORDS)]
#: Sets of so many shingles have parities over more buckets too; their words.
LONG, WIDE_WORDS = 1000, 256
#: The parities once more, over fewer buckets, beside every posting.
FOLDED = [f"q{w}" for w in range(4)]
#: Pairs a posting from which on leaders are compared first; rounds without a new link after which they are not; rounds at most.
FEW, IDLE, ROUNDS = 2, 2, 2


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(hashes(text, SHINGLE))


def common_counters(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counters that are high in some task, and their sums: at most COUNTERS of them. ``docs``: text."""

    def make():
        total = np.zeros(COUNTERS, dtype=np.int64)

        def count(texts):
            found = [shingle_set(t) for t in texts]
            np.add.at(total, (np.concatenate(found) % COUNTERS).astype(np.int64), 1)

        def finish():
            # above most of what unrelated shingles put in a counter
            mean = total.mean()
            at = np.flatnonzero(total > 2 + mean + 2 * np.sqrt(mean))
            yield {"counter": at.tolist(), "n": total[at].tolist()}

        count.finish = finish
        return count

    schema = StructType([StructField("counter", LongType()), StructField("n", LongType())])
    rows = map_columns(docs.select("text"), schema, make).groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    return rows.column("counter").to_numpy(), rows.column("n").to_numpy()


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, fp, digest, sim, n, first, p0, p1 ..., wide) of each document: fp names the set, sim is its SimHash, n its size, first its prefix, p0 and so on its parities."""
    schema = StructType([docs.schema["doc_id"], StructField("fp", LongType()), StructField("digest", LongType()), StructField("sim", LongType()), StructField("n", IntegerType()), StructField("first", ArrayType(LongType())), *(StructField(p, LongType()) for p in PARITIES), StructField("wide", ArrayType(LongType()))])
    a, b = SIMILAR

    def parities_of(s: np.ndarray, words: int) -> np.ndarray:
        """Whether an odd number of shingles is in each bucket; buckets are the hashes' upper bits."""
        odd = np.bincount((s >> np.uint64(65 - (64 * words).bit_length())).astype(np.int64), minlength=64 * words) & 1
        return np.packbits(odd.astype(bool), bitorder="little").view("<i8")

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def make():
        weight = np.zeros(COUNTERS, dtype=np.int64)
        weight[common[0]] = common[1]

        def cut(ids, texts):
            out = {"doc_id": ids, "fp": [], "digest": [SEED if t is None else signed(xxhash.xxh64_intdigest(utf8(t), SEED)) for t in texts], "sim": [], "n": [], "first": [], "wide": []}
            parities = np.zeros((len(texts), WORDS), dtype="<i8")
            for k, t in enumerate(texts):
                s = shingle_set(t)
                n = len(s)
                order = np.lexsort((s, weight[(s % COUNTERS).astype(np.int64)]))
                out["fp"].append(signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)))
                out["sim"].append(signed(vote(s)))
                out["n"].append(n)
                out["first"].append(s[order[: n - -(-a * n // b) + 1 if n else 0]].view("<i8").tolist())
                parities[k] = parities_of(s, WORDS)
                out["wide"].append(parities_of(s, WIDE_WORDS).tolist() if n >= LONG else None)
            return out | {p: parities[:, w].tolist() for w, p in enumerate(PARITIES)}

        return cut

    return map_columns(docs, schema, make)


def by_simhash(sizes: DataFrame) -> DataFrame:
    """(a, b), a < b: the sets that SimHash says to compare. ``sizes``: fp, sim of each set.

    Sets of one SimHash are compared with the smallest of them; these, where
    other SimHashes are linked to theirs (at 3 or fewer differing bits), with
    the set of the smallest of these and of the smallest that can be reached:
    at most three pairs a set, however many are alike.
    """
    stands = materialize(sizes.groupBy("sim").agg(F.min("fp").alias("stand")), "simhashes")
    near = materialize(simhash_links(stands.select(F.col("sim").alias("fp"))), "simhash-pairs")
    least = near.union(near.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
    chosen = least.union(connected_components(near).select("node", "root")).where("a <> b").distinct()
    x, y = (stands.select(F.col("sim").alias(f"sim_{c}"), F.col("stand").alias(f"stand_{c}")) for c in "ab")
    across = chosen.join(x, F.col("a") == F.col("sim_a")).join(y, F.col("b") == F.col("sim_b")).select("stand_a", "stand_b")
    within = sizes.select("fp", "sim").join(stands, "sim").where("fp <> stand").select("fp", "stand")
    return across.union(within).select(F.least("stand_a", "stand_b").alias("a"), F.greatest("stand_a", "stand_b").alias("b")).distinct()


def _possible(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parities don't rule the similarity out. ``sizes``: fp, n and parities of each set."""
    p, q = SIMILAR
    x, y = (sizes.select(*(F.col(k).alias(f"{k}_{c}") for k in ("fp", "n", *PARITIES))) for c in "ab")
    met = pairs.join(x, F.col("a") == F.col("fp_a")).join(y, F.col("b") == F.col("fp_b"))
    differ = sum((F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in PARITIES), F.lit(0))

    def within(d):
        # of sets that are similar enough at most (q - p) / (q + p) of both sizes differ
        return (p + q) * d <= (q - p) * (F.col("n_a") + F.col("n_b"))

    met = materialize(met.where(within(differ)).select("a", "b", "n_a", "n_b"), "possible-pairs")
    wide = sizes.where(F.col("wide").isNotNull())
    x, y = (wide.select(F.col("fp").alias(f"fp_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")
    long = met.where(F.least("n_a", "n_b") >= LONG).join(x, F.col("a") == F.col("fp_a")).join(y, F.col("b") == F.col("fp_b"))
    differ = F.aggregate(F.zip_with("wide_a", "wide_b", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
    return materialize(met.where(F.least("n_a", "n_b") < LONG).select("a", "b").union(long.where(within(differ)).select("a", "b")), "possible-pairs")


def _similar(pairs: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, by their whole sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = materialize(prints.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("digest").alias("d")), "sets-in-pairs")
    texts = docs.select(F.xxhash64("text").alias("own"), "text").join(wanted, F.col("own") == F.col("d")).groupBy("fp").agg(F.min("text").alias("text"))
    schema = StructType([StructField("k", LongType()), StructField("shingles", ArrayType(LongType()))])

    def make():
        return lambda keys, texts: {"k": keys, "shingles": [shingle_set(t).view("<i8").tolist() for t in texts]}

    sets = materialize(map_columns(texts, schema, make), "shingle-sets")
    p, q = SIMILAR
    x, y = (sets.select(F.col("k").alias(f"k{c}"), F.col("shingles").alias(f"s{c}")) for c in "ab")
    met = pairs.join(x, F.col("a") == F.col("ka")).join(y, F.col("b") == F.col("kb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return materialize(met.where((p + q) * both >= p * (F.size("sa") + F.size("sb"))).select("a", "b"), "pairs")


def _may_fit():
    """Of sets that share the i-th and i2-th shingle and none before (from 0): whether sizes and places allow the similarity."""
    p, q = SIMILAR
    n, n2 = F.col("n"), F.col("n2")
    most = F.least(n - F.col("i"), n2 - F.col("i2"))
    return (q * F.least(n, n2) >= p * F.greatest(n, n2)) & ((p + q) * most >= p * (n + n2))


def _near(a: str, b: str):
    """Whether the folded parities of two postings allow the similarity (see ``_possible``)."""
    p, q = SIMILAR
    differ = sum((F.bit_count(F.col(f"{f}{a}").bitwiseXOR(F.col(f"{f}{b}"))) for f in FOLDED), F.lit(0))
    return (p + q) * differ <= (q - p) * (F.col(f"n{a}") + F.col(f"n{b}"))


def _one_of_alike(posts: DataFrame) -> DataFrame:
    """The postings of one shingle of all that stand in the same sets: the first in the order, which is the first that any two of the sets share.

    Sets of postings are told by their size and two 64-bit sums; a passage that
    many sets share is met once, not by each of its shingles.
    """
    kinds = posts.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("fp"))).alias("y"), F.min("i").alias("lo"))
    kept = kinds.groupBy("c", "x", "y").agg(F.min(F.struct("lo", "token"))["token"].alias("token")).select("token")
    return materialize(posts.join(kept, "token", "left_semi"), "postings")


def _open(posts: DataFrame) -> DataFrame:
    """The postings of shingles that more than one group shares."""
    more = posts.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    return materialize(posts.join(more, "token", "left_semi"), "postings")


def groups(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(fp, root) of each linked set; root is its group's smallest. ``docs``: doc_id, text; ``prints``: of prefixes."""
    # equal sets have the same columns
    sizes = materialize(prints.dropDuplicates(["fp"]).select("fp", "sim", "n", "first", *PARITIES, "wide"), "sets")
    links = _similar(_possible(by_simhash(sizes), sizes), docs, prints)
    roots = connected_components(links)
    posts = sizes.select("fp", F.posexplode("first").alias("i", "token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    # buckets that are joined have the parity of their sum
    step = WORDS // len(FOLDED)
    folded = [reduce(lambda x, y: x.bitwiseXOR(y), map(F.col, PARITIES[k * step : (k + 1) * step])).alias(f) for k, f in enumerate(FOLDED)]
    own = sizes.select("fp", "n", *folded).join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    live = _open(materialize(posts.join(shared, "token", "left_semi").join(own, "fp"), "postings"))
    other = ("fp", "n", "i", "root", *FOLDED)
    p, q = SIMILAR
    turn = idle = 0
    while True:
        whole = live.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
        total = whole.agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c") - F.col("own")).alias("pairs")).first()
        # all pairs at last: where they are no more than a few a posting, or where leaders find nothing more
        last = not total.rows or total.pairs <= FEW * total.rows or idle == IDLE or turn == ROUNDS
        if last:
            live = _one_of_alike(live)
            y = live.select("token", *(F.col(c).alias(f"{c}2") for c in other))
            met = live.join(y, "token").where((F.col("root") < F.col("root2")) & _may_fit() & _near("", "2"))
        else:
            # each shingle has a leader of its own; one that sets of its size can fit comes first
            late = (p + q) * (F.col("n") - F.col("i")) < 2 * p * F.col("n")
            first = F.min(F.struct(late.alias("late"), F.xxhash64("fp", "token", F.lit(turn)).alias("h"), *other)).alias("l")
            y = live.groupBy("token").agg(first).select("token", *(F.col(f"l.{c}").alias(f"{c}2") for c in other))
            met = live.join(y, "token").where((F.col("root") != F.col("root2")) & _may_fit() & _near("", "2"))
        # in the order's first shared shingle every similar pair passes
        pairs = _possible(met.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct(), sizes)
        turn, idle = turn + 1, idle + 1
        if not pairs.isEmpty():
            found = _similar(pairs, docs, prints)
            if not found.isEmpty():
                idle = 0
                links = links.union(found)
                roots = connected_components(links)
        if last:
            break
        if idle == 0:
            r = live.drop("root").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
            live = _open(materialize(r, "postings"))
    return roots.withColumnRenamed("node", "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies, columns as they are; of a group the row stays that simhash.keep_one would keep.

    Texts without words (null, empty or blank) are one group.
    """
    narrow = id_and_text(docs, id_col, text_col)
    prints = materialize(prefixes(narrow, common_counters(narrow)), "prefixes")
    linked = groups(narrow, prints)
    known = prints.select("fp").distinct().join(linked, "fp", "left").select(F.col("fp").alias("k"), F.coalesce("root", "fp").alias("root"))
    return representatives(docs, prints, materialize(known, "classes"), id_col, text_col)
