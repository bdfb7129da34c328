"""Exact substring dedup on words: words of a long window that also starts earlier, by suffix automata.

1. Equal texts become one row with their smallest doc_id. Of a copy with a
   larger id every window starts earlier, so nothing of it is kept.
2. The anchor of a window is the run of GRAM words in it with the smallest hash
   (the leftmost of equals); equal windows have equal anchors at the same place
   in them. Anchors are counted over all texts. A window can repeat only if its
   anchor occurs twice or more; for each such anchor of a text, the words that
   its windows span, its context, go to the anchor's shard.
3. A shard reads the contexts of an anchor in the order of (doc_id, place) and
   holds the suffix automaton of those read before, its reference. Each context
   is streamed through the automaton for its matching statistics, the longest
   match with an earlier context that ends at each word. Matches of ``length``
   words and more are spans to remove. Then the automaton takes the context in.
   Contexts of one doc_id and place (a doc_id that stands in two rows) are
   streamed first and taken in afterwards: neither is earlier. A context that
   was taken in before is one span and needs no automaton.
4. An anchor of over ``HOT`` occurrences takes turns first: of equal contexts
   all but the earliest are covered; if more than ``HOT`` distinct ones are
   left, each is cut by the anchor's place in the window (equal windows agree on
   it) into narrower contexts, which are dealt by all words that their windows
   have in common; and so on, until a group is small enough for an automaton or
   a context is one window, whose earliest place is then known.
5. The spans of each text are united, and what is left of it is digested.

A broadcast of every reference shard to all tasks would read the documents as
often as there are shards. So documents and references meet by shuffles of
anchors: an automaton stands where the contexts are that it can match.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh_path, id_and_text, materialize
from .suffix_dedup import _arrow_map, _merged, _raw

LENGTH, GRAM = 20, 5
#: Occurrences of one anchor, or distinct contexts of one group, that go to one automaton as they are. Parts of a cut.
HOT, CUT = 1000, 4
#: Hashes of words that a task keeps; beyond, it starts anew. Words that are hashed together, about.
MAX_WORDS, BATCH_WORDS = 1 << 18, 1 << 20
_PLACE = np.uint64((1 << 28) - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0x94D049BB133111EB)

NO_WORDS = hashlib.sha256(b"").hexdigest()
ANCHORS = StructType([StructField("hash", LongType()), StructField("key", BinaryType())])
#: A context: its group, 1 if that is hot, the anchor's place in the first window; its text, first doc (null first), place of the anchor and words.
CONTEXTS = StructType([StructField("group", LongType()), StructField("hot", IntegerType()), StructField("x", IntegerType()), StructField("key", BinaryType()), StructField("doc", LongType()), StructField("place", LongType()), StructField("words", BinaryType())])
DIGESTS = StructType([*CONTEXTS.fields, StructField("digest", BinaryType())])
SPANS = StructType([StructField("key", BinaryType()), StructField("from", LongType()), StructField("to", LongType())])


class Hasher:
    """64-bit hashes of words, kept while a task meets them again."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MAX_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def anchors(hashes: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hash, place, first and last window start of each anchor. ``ends``: where each text's words end in ``hashes``."""
    n = len(hashes)
    if n < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    h = np.zeros(n - gram + 1, dtype=np.uint64)
    for k in range(gram):
        h = h * _MULTIPLIER + hashes[k : n - gram + 1 + k]
        h ^= h >> np.uint64(31)
    h *= _FINAL
    low, width, span = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    begins = np.concatenate([[0], ends[:-1]])
    windows = np.maximum(ends - begins - length + 1, 0)
    edge = np.zeros(n + 1, dtype=np.int8)
    has = windows > 0
    edge[begins[has]] += 1
    np.add.at(edge, begins[has] + windows[has], -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]))
    at = (low[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return h[at[first]].view(np.int64), at[first], starts[first], starts[last]


def batches_of(texts, hasher: Hasher, length: int, gram: int) -> Iterator[tuple[int, list, np.ndarray, tuple]]:
    """(number of the first text, words of each, ends, anchors) of stretches of about BATCH_WORDS words."""
    words, size, first = [], 0, 0

    def found():
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        return first, words, ends, anchors(np.concatenate([hasher(w) for w in words]), ends, length, gram)

    for k, text in enumerate(texts):
        words.append(_raw(text).split())
        size += len(words[-1])
        if size > BATCH_WORDS:
            yield found()
            words, size, first = [], 0, k + 1
    if words:
        yield found()


def _find_anchors(length: int, gram: int):
    """The function for mapInArrow: ANCHORS of whole texts."""

    def rows(batches):
        hasher = Hasher()
        for b in batches:
            for first, _, ends, (h, place, _, _) in batches_of(b.column(1), hasher, length, gram):
                owner = np.searchsorted(ends, place, "right") + first
                for at in range(0, len(h), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000]), b.column(0).take(pa.array(owner[at : at + 100_000]))], schema=to_arrow_schema(ANCHORS))

    return rows


def _find_contexts(length: int, gram: int):
    def rows(batches):
        hasher = Hasher()
        for b in batches:
            keys, docs, wanted = (b.column(k).to_pylist() for k in (0, 2, 3))
            wanted = [dict(w) for w in wanted]
            out, held = [], 0
            for first, words, ends, (h, place, start, last) in batches_of(b.column(1), hasher, length, gram):
                owner = np.searchsorted(ends, place, "right")
                begins = np.concatenate([[0], ends[:-1]])[owner]
                for x, k, p, s, e in zip(h.tolist(), owner.tolist(), (place - begins).tolist(), (start - begins).tolist(), (last - begins).tolist()):
                    hot = wanted[first + k].get(x)
                    if hot is not None:
                        context = b" ".join(words[k][s : e + length])
                        out.append((x, hot, p - s, keys[first + k], docs[first + k], p, context))
                        held += len(context)
                        if held > 4 << 20:
                            yield out
                            out, held = [], 0
            yield out

    return rows


class Automaton:
    """The suffix automaton of the word sequences taken in so far."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        nexts, link, size = self.next, self.link, self.size
        last = 0
        for w in words:
            to = nexts[last].get(w)
            if to is not None:
                if size[to] == size[last] + 1:
                    last = to
                else:
                    last = self._clone(last, w, to)
                continue
            new = len(nexts)
            nexts.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p >= 0:
                to = nexts[p][w]
                link[new] = to if size[to] == size[p] + 1 else self._clone(p, w, to)
            last = new

    def _clone(self, p: int, w: bytes, to: int) -> int:
        nexts, link, size = self.next, self.link, self.size
        copy = len(nexts)
        nexts.append(dict(nexts[to]))
        link.append(link[to])
        size.append(size[p] + 1)
        link[to] = copy
        while p >= 0 and nexts[p].get(w) == to:
            nexts[p][w] = copy
            p = link[p]
        return copy

    def matches(self, words: list[bytes], length: int) -> Iterator[tuple[int, int]]:
        """(from, to) of the words in matches of ``length`` and more, united where they touch: matching statistics, the longest match that ends at each word."""
        nexts, link, size = self.next, self.link, self.size
        state = n = 0
        begin = end = -1
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                n = size[state]
            to = nexts[state].get(w)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= length:
                if i + 1 - n > end:
                    if end >= 0:
                        yield begin, end
                    begin = i + 1 - n
                begin, end = min(begin, i + 1 - n), i + 1
        if end >= 0:
            yield begin, end


def _stream(length: int):
    """Partitions come sorted by (group, doc, place)."""

    def rows(batches):
        last, tie = None, None
        automaton, taken, waiting = None, {}, {}

        def take():
            nonlocal automaton
            for context, words in waiting.items():
                taken[context] = words
                if automaton is not None:
                    automaton.add(words)
            waiting.clear()

        for b in batches:
            out = []
            for group, x, key, doc, place, context in zip(*(c.to_pylist() for c in b.columns)):
                if group != last:
                    last, automaton, taken = group, None, {}
                    waiting.clear()
                    tie = None
                if (now := (doc, place)) != tie:
                    take()
                    tie = now
                start = place - x
                words = context.split(b" ")
                if context in taken:
                    out.append((key, start, start + len(words)))
                    continue
                if taken:
                    if automaton is None:
                        automaton = Automaton()
                        for known in taken.values():
                            automaton.add(known)
                    out += [(key, start + s, start + e) for s, e in automaton.matches(words, length)]
                waiting.setdefault(context, words)
            yield out

    return rows


def _cut(length: int, gram: int, width: int):
    """Contexts cut into stretches of windows whose anchor stands at ``width`` neighbouring places; a group is named by the old one, the stretch and all words that its windows share."""

    def rows(batches):
        for b in batches:
            out, held = [], 0
            for group, x, key, doc, place, context in zip(*(c.to_pylist() for c in b.columns)):
                words = context.split(b" ")
                last = len(words) - length
                for c in range((x - last) // width, x // width + 1):
                    low, high = c * width, min(c * width + width - 1, length - gram)
                    i, j = x - min(x, high), x - max(x - last, low)
                    part = b" ".join(words[i : j + length])
                    core = b" ".join(words[x - low : x - high + length])
                    name = xxhash.xxh3_64_intdigest(core, (group + c * 0x9E3779B97F4A7C15) % (1 << 64)) - (1 << 63)
                    digest = hashlib.blake2b(part, digest_size=16, salt=struct.pack("<qq", x - i, c)).digest()
                    out.append((name, 1, x - i, key, doc, place, part, digest))
                    held += len(part)
                if held > 4 << 20:
                    yield out
                    out, held = [], 0
            yield out

    return rows


def _words(c):
    return F.size(F.split(c.cast("string"), " "))


def resolve_hot(members: DataFrame, length: int, gram: int, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of hot anchors' contexts: contexts for automata, and spans of those that stand earlier."""
    sent, covered, width = [], [], length - gram + 1
    while True:
        parts = materialize(_arrow_map(members.select("group", "x", "key", "doc", "place", "words"), DIGESTS, _cut(length, gram, width)), "parts")
        first = parts.groupBy(F.col("group").alias("g"), F.col("digest").alias("e")).agg(F.min(F.struct(F.col("doc").isNotNull().alias("known"), "doc", "place")).alias("first"))
        first = materialize(first.select("g", "e", F.col("first.doc").alias("first_doc"), F.col("first.place").alias("first_place")), "first-places")
        distinct = first.groupBy(F.col("g").alias("h")).agg(F.count("*").alias("d")).where("d > 1")
        met = parts.join(first, (F.col("group") == F.col("g")) & (F.col("digest") == F.col("e")))
        is_first = F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("place") == F.col("first_place"))
        met = materialize(met.withColumn("is_first", is_first).drop("g", "e", "digest", "first_doc", "first_place"), "met")
        start = F.col("place") - F.col("x")
        covered.append(met.where("not is_first").select("key", start.alias("from"), (start + _words(F.col("words"))).alias("to")))
        if width == 1:
            return sent, covered
        left = met.where("is_first").join(distinct, F.col("group") == F.col("h")).drop("h", "is_first")
        sent.append(left.where(F.col("d") <= hot).drop("d"))
        members = left.where(F.col("d") > hot)
        if members.isEmpty():
            return sent, covered
        width = -(-width // CUT)


def _finish(length: int, with_kept: bool):
    def rows(batches):
        for b in batches:
            out = []
            for key, text, doc, spans in zip(*b.columns):
                words, kept, at, removed = _raw(text).split(), [], 0, 0
                for a, e in _merged([(s["from"], s["to"]) for s in spans.as_py() or ()]):
                    kept += words[at:a]
                    removed, at = removed + e - a, e
                kept = b" ".join(kept + words[at:])
                out.append((key.as_py(), doc.as_py(), len(words), removed, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_kept else [])))
            yield out

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the words left, joined by one space).

    Earlier is a smaller doc_id, or the same and a smaller start; a null id is
    the smallest. Rows that repeat id and text are one document that stands
    twice, and have one result; texts under one id are compared by their
    places. A null text has no words. Texts of fewer than ``length`` words keep
    them all. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < gram <= length:
        raise ValueError("gram is from 1 to length")
    spark = docs.sparkSession
    narrow = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = narrow.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32))).withColumn("doc", F.col("doc_id").cast("long"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"lattica_words_{uuid.uuid4().hex}", fresh_path(spark, "words")
    distinct = keyed.groupBy("key").agg(F.first("text").alias("text"), F.min(F.struct(F.col("doc").isNotNull().alias("known"), "doc"))["doc"].alias("doc"))
    distinct.write.bucketBy(buckets, "key").option("path", path).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)

    found = materialize(texts.select("key", "text").mapInArrow(_find_anchors(length, gram), ANCHORS), "word-anchors")
    many = found.groupBy(F.col("hash").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > hot).cast("int").alias("hot"))
    many = materialize(many, "repeated-anchors")
    repeated = found.join(many, F.col("hash") == F.col("h")).groupBy(F.col("key").alias("k")).agg(F.map_from_entries(F.collect_set(F.struct("hash", "hot"))).alias("wanted"))
    met = texts.join(repeated, F.col("key") == F.col("k")).select("key", "text", "doc", "wanted")
    sent, covered = _arrow_map(met, CONTEXTS, _find_contexts(length, gram)), []
    if not many.where("hot = 1").isEmpty():
        sent = materialize(sent, "contexts")
        more, covered = resolve_hot(sent.where("hot = 1"), length, gram, hot)
        sent = reduce(DataFrame.union, more, sent.where("hot = 0"))
    order = ["group", "doc", "place"]  # nulls first
    dealt = sent.select("group", "x", "key", "doc", "place", "words").repartition("group").sortWithinPartitions(*order)
    spans = reduce(DataFrame.union, covered, _arrow_map(dealt, SPANS, _stream(length)))
    spans = materialize(spans.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("from", "to")).alias("spans")), "word-spans")

    fields = [StructField("key", BinaryType()), StructField("first", LongType()), *(StructField(c, LongType()) for c in ("n_words", "n_removed")), StructField("kept_sha256", StringType())]
    fields += [StructField("kept", StringType())] * with_kept
    judged = texts.join(spans, F.col("key") == F.col("k"), "left").select("key", "text", "doc", "spans")
    results = materialize(_arrow_map(judged, StructType(fields), _finish(length, with_kept)), "words-kept")
    spark.sql(f"DROP TABLE {name}")
    out = keyed.select("doc_id", "doc", F.col("key").alias("k")).join(results, F.col("k") == F.col("key"))
    copy = F.col("doc").isNotNull() & (F.col("first").isNull() | (F.col("doc") > F.col("first"))) & (F.col("n_words") >= length)
    out = out.withColumn("n_removed", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed"))).withColumn("kept_sha256", F.when(copy, F.lit(NO_WORDS)).otherwise(F.col("kept_sha256")))
    if with_kept:
        out = out.withColumn("kept", F.when(copy, F.lit("")).otherwise(F.col("kept")))
    return out.select("doc_id", *(f.name for f in fields[2:]))
