"""Exact substring dedup: bytes covered by a long string that also starts elsewhere.

Strings of ``length`` bytes are dealt so that equal ones meet. The anchor of a
string is the k-gram in it with the smallest hash (the leftmost of equals);
equal strings have equal anchors at the same place in them. So:

1. Equal texts become one row, with a number of copies; every byte of a text
   of ``length`` or more that has copies is covered.
2. The distinct anchors of each text are counted over all texts. A string can
   repeat only if its anchor occurs twice or more.
3. For each such anchor the bytes that its strings span, its context in a
   text, are sent to the anchor's shard. An anchor of over ``HOT`` places
   takes another way: equal contexts are counted first, by partial sums, and
   what stands twice is covered at once. If more than ``HOT`` distinct ones
   are left, each is cut by the anchor's place in the string (equal strings
   agree on it) into eight narrower contexts, which are dealt by all bytes that
   their strings have in common; and so on, until a group is small enough for
   a shard or a context is one string. A context that differs from all others
   within those bytes drops out, so that a text sends a bounded number of
   pieces, however many others share its passages.
4. A shard reads contexts sorted by anchor in stretches of about a MB, lets
   equal contexts be one, sorts the suffixes of the rest (suffix_array: direct
   sort of the suffixes smaller than their successors, induction of the
   others), and finds starts whose common prefix with a neighbour has
   ``length`` bytes. Contexts are separated by a byte that is not in UTF-8.
5. The spans of each text are united, and what is left of it is digested.

Texts move once: the distinct texts are written bucketed by their digest, and
later joins bring small tables to the buckets.
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
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh_path, id_and_text, materialize
from .suffix_array import MOST, adjacent_prefixes, suffix_array

LENGTH, GRAM = 400, 64
#: Contexts of one anchor that go to one shard; beyond, equal ones are counted and the rest is cut. Parts of a cut.
HOT, CUT = 2000, 8
#: Digests of equal pieces (16 bytes each) that are broadcast to mark their places; where there are more, they are joined.
ALIKE = 1 << 18
#: Bytes of contexts that are sorted together, about.
STRETCH = 1 << 20
#: A text is cut into overlapping parts of so many bytes for its anchors; places in them fit the packed keys.
PART = 1 << 27
SEPARATOR = b"\xff"
_TABLE = np.random.default_rng(20260801).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_LOW = np.uint64((1 << 28) - 1)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all runs of ``gram`` bytes (a power of two), by doubling."""
    h, width, k = _TABLE[raw], 1, 0
    while width < gram:
        h = h[:-width] * _MULTIPLIERS[k % 6] + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
        k += 1
    return h * np.uint64(0x94D049BB133111EB)


def _anchors_of_part(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    span = length - gram + 1
    h = gram_hashes(raw, gram)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & _LOW).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return h[at[first]].view(np.int64), at[first], first, np.append(first[1:], len(at)) - 1


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hash, place, first and last start (of the strings it is the anchor of) of each anchor of a text."""
    if len(raw) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    data = np.frombuffer(raw, dtype=np.uint8)
    found = []
    for at in range(0, len(data) - length + 1, PART):
        h, place, a, b = _anchors_of_part(data[at : at + PART + length - 1], length, gram)
        found.append((h, place + at, a + at, b + at))
    return tuple(np.concatenate(x) for x in zip(*found))


def contexts(raw: bytes, counts: dict[int, int], length: int, gram: int, hot: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(anchor hash, 1 if the anchor is hot, place of the anchor in the first string, first start, bytes) of each stretch of starts that may repeat."""
    if len(raw) < length:
        return
    h, place, first, last = anchors(raw, length, gram)
    for key, p, a, b in zip(h.tolist(), place.tolist(), first.tolist(), last.tolist()):
        if key in counts:
            yield key, int(counts[key] > hot), p - a, a, raw[a : b + length]


def gathered(found: Iterator[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int, list[int], bytes]]:
    """A text's contexts with the first starts of all its places: a text that repeats itself sends each context once."""
    places: dict[tuple[int, int, int, bytes], list[int]] = {}
    for key, hot, x, start, context in found:
        places.setdefault((key, hot, x, context), []).append(start)
    return ((key, hot, x, starts, context) for (key, hot, x, context), starts in places.items())


def pieces(group: int, x: int, context: bytes, length: int, gram: int, width: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    """(group, digest, offset, bytes) of a context cut into stretches of strings whose anchor stands at ``width`` neighbouring places.

    ``x``: the anchor's place in the context's first string. The group is named
    by the old one, the stretch, and all bytes that every string of it holds.
    """
    last = len(context) - length
    for c in range((x - last) // width, x // width + 1):
        low, high = c * width, min(c * width + width - 1, length - gram)
        i, j = x - min(x, high), x - max(x - last, low)
        part = context[i : j + length]
        core = context[x - low : x - high + length]
        name = xxhash.xxh3_64_intdigest(core, (group + c * 0x9E3779B97F4A7C15) % (1 << 64))
        digest = hashlib.blake2b(part, digest_size=16, salt=struct.pack("<qq", x - i, c)).digest()
        yield name - (1 << 63), digest, i, part


def repeated_starts(group: list[list[tuple[bytes, list[int], bytes]]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """(text key, first byte, end) of covered stretches. ``group``: for each anchor its (text key, first starts, context)."""
    texts, owners, size = [], [], 0

    def flush():
        nonlocal texts, owners, size
        if texts:
            yield from _sorted_starts(texts, owners, length)
        texts, owners, size = [], [], 0

    for members in group:
        distinct: dict[bytes, list[tuple[bytes, int]]] = {}
        for key, starts, context in members:
            distinct.setdefault(context, []).extend((key, s) for s in starts)
        for context, own in distinct.items():
            if len(own) > 1:
                for key, start in own:
                    yield key, start, start + len(context)
        if len(distinct) > 1:
            extra = sum(map(len, distinct)) + len(distinct)
            if size + extra >= MOST and size:
                yield from flush()
            for context, own in distinct.items():
                texts.append(context)
                owners.append(own[0] if len(own) == 1 else None)
            size += extra
    yield from flush()


def _sorted_starts(texts: list[bytes], owners: list, length: int) -> Iterator[tuple[bytes, int, int]]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = SEPARATOR.join([*texts, b""])
    text = np.frombuffer(joined, dtype=np.uint8)
    array = suffix_array(text, length)
    # strings that repeat stand together, and only a context's own starts have so many bytes before a separator
    edge = np.zeros(len(text) + 1, dtype=np.int8)
    edge[begin[:-1]] += 1
    edge[begin[:-1] + sizes - length + 1] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    array = array[valid[array]]
    long = adjacent_prefixes(text, array, length) >= length
    hit = np.zeros(len(text), dtype=bool)
    hit[array[long]] = True
    hit[array[np.flatnonzero(long) - 1]] = True
    flags = [hit[a : a + n - length + 1] for a, n in zip(begin.tolist(), sizes.tolist())]
    for own, flag in zip(owners, flags):
        if own is not None and flag.any():
            turns = np.flatnonzero(np.diff(flag.astype(np.int8), prepend=0, append=0))
            for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
                yield own[0], own[1] + s, own[1] + e - 1 + length


def _arrow_map(df: DataFrame, schema: StructType, rows) -> DataFrame:
    """mapInArrow over whole partitions: ``rows`` gets an iterator of batches and yields lists of tuples."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in rows(batches):
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _raw(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


ANCHORS = StructType([StructField("hash", LongType()), StructField("key", BinaryType()), StructField("n", IntegerType())])
CONTEXTS = StructType([StructField("hash", LongType()), StructField("salt", IntegerType()), StructField("x", IntegerType()), StructField("key", BinaryType()), StructField("starts", ArrayType(LongType())), StructField("context", BinaryType())])
#: A piece with its bytes, and with all its places.
WIDE = StructType([StructField("group", LongType()), StructField("digest", BinaryType()), StructField("n", LongType()), StructField("x", IntegerType()), StructField("key", BinaryType()), StructField("start", LongType()), StructField("context", BinaryType())])
PLACES = StructType([StructField("group", LongType()), StructField("digest", BinaryType()), StructField("key", BinaryType()), StructField("starts", ArrayType(LongType())), StructField("size", LongType())])
SPANS = StructType([StructField("key", BinaryType()), StructField("from", LongType()), StructField("to", LongType())])


def _find_anchors(length: int, gram: int):
    def rows(batches):
        for b in batches:
            out = []
            for key, text in zip(b.column(0), b.column(1)):
                k = key.as_py()
                found, n = np.unique(anchors(_raw(text), length, gram)[0], return_counts=True)
                out += [(h, k, m) for h, m in zip(found.tolist(), np.minimum(n, 1 << 30).tolist())]
                if len(out) > 50_000:
                    yield out
                    out = []
            yield out

    return rows


def _find_contexts(length: int, gram: int, hot: int):
    def rows(batches):
        for b in batches:
            out, size = [], 0
            for key, text, hashes, counts in zip(*b.columns):
                k = key.as_py()
                for h, salt, x, starts, context in gathered(contexts(_raw(text), dict(zip(hashes.as_py(), counts.as_py())), length, gram, hot)):
                    out.append((h, salt, x, k, starts, context))
                    size += len(context)
                    if size > 4 << 20:
                        yield out
                        out, size = [], 0
            yield out

    return rows


def _find_pieces(length: int, gram: int, width: int, places: bool):
    """``batches``: hash, x, key, starts, context. Rows of PLACES or of WIDE."""

    def rows(batches):
        for b in batches:
            out, size = [], 0
            for h, x, key, starts, context in zip(*(c.to_pylist() for c in b.columns)):
                for group, digest, i, part in pieces(h, x, context, length, gram, width):
                    if places:
                        out.append((group, digest, key, [s + i for s in starts], len(part)))
                    else:
                        out.append((group, digest, len(starts), x - i, key, starts[0] + i, part))
                        size += len(part)
                if size > 4 << 20 or len(out) > 50_000:
                    yield out
                    out, size = [], 0
            yield out

    return rows


def _merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    at = end = -1
    for a, e in sorted(spans):
        if a > end:
            if end >= 0:
                yield at, end
            at, end = a, e
        end = max(end, e)
    if end >= 0:
        yield at, end


def _mark_pieces(length: int, gram: int, width: int, alike):
    """``batches``: hash, x, key, starts, context. SPANS of the pieces whose digests are in the broadcast set, united over neighbouring rows of a text."""

    def rows(batches):
        known, last, spans = alike.value, None, []
        for b in batches:
            out = []
            for h, x, key, starts, context in zip(*(c.to_pylist() for c in b.columns)):
                if key != last:
                    out += [(last, a, e) for a, e in _merged(spans)]
                    last, spans = key, []
                for _, digest, i, part in pieces(h, x, context, length, gram, width):
                    if digest in known:
                        spans += [(s + i, s + i + len(part)) for s in starts]
            yield out
        yield [(last, a, e) for a, e in _merged(spans)]

    return rows


def resolve_hot(members: DataFrame, length: int, gram: int, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of hot anchors' contexts (CONTEXTS): contexts for the shards, and covered stretches (SPANS).

    Each round counts equal pieces, covers those that stand twice, hands groups
    of a few distinct pieces to the shards and cuts those of larger groups.
    Pieces of one digest are one row after the first round.
    """
    sent, covered, width = [], [], length - gram + 1
    while True:
        rows = members.select("hash", "x", "key", "starts", "context")
        wide = _arrow_map(rows, WIDE, _find_pieces(length, gram, width, False))
        one = wide.groupBy("group", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("key", "start", "x", "context")).alias("r"))
        one = materialize(one.select("group", "digest", "n", "r.*"), "pieces")
        distinct = one.groupBy("group").agg(F.count("*").alias("d")).where("d > 1")
        alike = one.where("n > 1").select(F.col("group").alias("g"), F.col("digest").alias("e"))
        if alike.count() <= ALIKE:
            # a digest names the group too: its bytes hold all that the group's strings have in common
            known = members.sparkSession.sparkContext.broadcast(frozenset(alike.select("e").toArrow().column(0).to_pylist()))
            met = _arrow_map(rows, SPANS, _mark_pieces(length, gram, width, known))
        else:
            places = _arrow_map(rows, PLACES, _find_pieces(length, gram, width, True))
            met = places.join(alike, (F.col("group") == F.col("g")) & (F.col("digest") == F.col("e"))).select("key", "size", F.explode("starts").alias("from"))
            met = met.select("key", "from", (F.col("from") + F.col("size")).alias("to"))
        covered.append(materialize(met, "alike"))
        left = one.join(distinct.withColumnRenamed("group", "g"), F.col("group") == F.col("g"))
        left = left.select(F.col("group").alias("hash"), F.lit(1 + len(sent)).alias("salt"), "x", "key", F.array("start").alias("starts"), "context", "d")
        left = materialize(left, "unlike")
        sent.append(left.where(F.col("d") <= hot if width > 1 else F.lit(True)).drop("d"))
        members = left.where(F.col("d") > hot)
        if width == 1 or members.isEmpty():
            return sent, covered
        width = -(-width // CUT)


def _find_spans(length: int):
    """Partitions come sorted by (hash, salt)."""

    def rows(batches):
        group, members, last, size = [], [], None, 0
        for b in batches:
            for h, salt, key, starts, context in zip(*(c.to_pylist() for c in b.columns)):
                if (h, salt) != last:
                    if len(members) > 1 or members and len(members[0][1]) > 1:
                        group.append(members)
                    else:
                        size -= sum(len(m[2]) for m in members)
                    if size > STRETCH:
                        yield list(repeated_starts(group, length))
                        group, size = [], 0
                    members, last = [], (h, salt)
                members.append((key, starts, context))
                size += len(context)
        group.append(members)
        yield list(repeated_starts(group, length))

    return rows


def _finish(length: int, with_kept: bool):
    def rows(batches):
        for b in batches:
            out = []
            for key, text, copies, spans in zip(*b.columns):
                raw, spans = _raw(text), sorted((s["from"], s["to"]) for s in spans.as_py() or ())
                if copies.as_py() > 1 and len(raw) >= length:
                    spans = [(0, len(raw))]
                kept, at, removed, n = [], 0, 0, 0
                for a, e in spans:
                    if a > at or n == 0:  # stretches that touch are one
                        kept.append(raw[at:a])
                        removed, n, at = removed + e - a, n + 1, e
                    elif e > at:
                        removed, at = removed + e - at, e
                kept = b"".join([*kept, raw[at:]])
                out.append((key.as_py(), len(raw), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
            yield out

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes: a cut may split a character).

    A null text is empty. Repeated rows are copies: of a text of ``length``
    bytes or more that occurs in two rows nothing is kept in either. Shorter
    texts keep everything. Null ids pass through; other columns are ignored;
    an empty table gives an empty result.
    """
    if gram & (gram - 1) or gram > length:
        raise ValueError("gram is a power of two, up to length")
    hot = min(hot, (MOST - 1) // (2 * length - gram + 2))  # one anchor's contexts fit one array
    spark = docs.sparkSession
    narrow = id_and_text(docs, id_col, text_col)
    narrow = narrow.withColumn("text", F.coalesce("text", F.lit("")))
    keyed = narrow.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"lattica_texts_{uuid.uuid4().hex}", fresh_path(spark, "texts")
    distinct = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    distinct.write.bucketBy(buckets, "key").option("path", path).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    long = texts.where(F.octet_length("text") >= length)

    found = materialize(_arrow_map(long.select("key", "text"), ANCHORS, _find_anchors(length, gram)), "anchors")
    many = found.groupBy("hash").agg(F.sum("n").alias("count")).where("count > 1").withColumnRenamed("hash", "h")
    many = materialize(many, "repeated-anchors")
    repeated = found.join(many, F.col("hash") == F.col("h")).groupBy("key").agg(F.collect_list(F.struct("hash", "count")).alias("found"))
    repeated = repeated.select(F.col("key").alias("k"), F.col("found.hash").alias("hashes"), F.col("found.count").alias("counts"))
    met = long.join(repeated, F.col("key") == F.col("k")).select("key", "text", "hashes", "counts")
    sent, covered = _arrow_map(met, CONTEXTS, _find_contexts(length, gram, hot)), []
    if not many.where(F.col("count") > hot).isEmpty():
        sent = materialize(sent, "contexts")
        more, covered = resolve_hot(sent.where("salt = 1"), length, gram, hot)
        sent = reduce(DataFrame.union, more, sent.where("salt = 0"))
    dealt = sent.select("hash", "salt", "key", "starts", "context").repartition("hash", "salt").sortWithinPartitions("hash", "salt")
    spans = reduce(DataFrame.union, covered, _arrow_map(dealt, SPANS, _find_spans(length))).groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    spans = materialize(spans.withColumnRenamed("key", "k"), "spans")

    fields = [StructField("key", BinaryType()), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())]
    fields += [StructField("kept", BinaryType())] * with_kept
    judged = texts.join(spans, F.col("key") == F.col("k"), "left").select("key", "text", "copies", "spans")
    results = materialize(_arrow_map(judged, StructType(fields), _finish(length, with_kept)), "kept")
    spark.sql(f"DROP TABLE {name}")
    return keyed.select("doc_id", F.col("key").alias("k")).join(results, F.col("k") == F.col("key")).select("doc_id", *(f.name for f in fields[1:]))
