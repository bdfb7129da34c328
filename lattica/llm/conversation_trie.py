"""The trie of common beginnings of conversations, by prefix-doubling names.

1. A turn's role and text become one digest, and equal digests one dense name.
2. Names of aligned blocks of 2^(k+1) turns are names of the pairs of names of
   their halves: log2 of the longest conversation rounds of a grouping and a
   join, over half the rows each.
3. A prefix of d turns is the prefix without the lowest bit of d and the block
   of that size which follows. Prefixes are named in rounds by the number of
   bits in d, again a grouping and a join each.
4. Conversations whose prefixes have one name are a node's members. The node's
   own conversation, the smallest member, owns it; what it owns is the end of
   its turns from some depth on. So sums over a subtree are sums over members:
   each adds what it owns at that depth or deeper. Every turn is in one such
   sum, and no ancestor list is made, however deep the trie.
5. Ids that end at a node are put together in blocks of neighbouring ids, and
   the blocks are digested in order as a stream.

Names are dense numbers: each written part of the distinct keys starts where
the parts before it end. A hot turn is one key of a join; its rows are on the
side that adaptive execution splits, and sums are partial first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialize

#: Conversations that share a base, and the number of lengths of what is taken from it.
GROUP, LENGTHS = 100, 6
#: Ids of a block are those of one range of so many numbers.
RANGE = 4096
#: Depths of a conversation that are summed in one group.
CHUNK = 4096
ENDS = StructType([StructField("e_conv", LongType()), StructField("e_depth", LongType()), StructField("ends_sha256", StringType())])
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _marked(rows: DataFrame, what: str) -> DataFrame:
    """The rows, written as they lie, with a mark of their part and place."""
    return materialize(rows.withColumn("_mark", F.monotonically_increasing_id()), what)


def _numbered(marked: DataFrame, name: str, start: int = 0) -> tuple[DataFrame, int]:
    """The rows of _marked with numbers from ``start`` on in their order, without gaps; and the next free number."""
    part, within = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND((1 << 33) - 1)
    # a row for each written part: as many as tasks, whatever the data
    parts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    offsets = parts.select(F.col("_part").alias("_p"), F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    total = parts.agg(F.sum("_size")).first()[0] or 0
    named = marked.join(F.broadcast(offsets), part == F.col("_p")).withColumn(name, within + F.coalesce("_before", F.lit(0)) + start)
    return named.drop("_mark", "_p", "_before"), start + total


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, size) of every turn: at counts from 0 in the order of turn (null first), then role and text; size is the text's code points.

    Places come from one sort by ranges, so that a long conversation is not one task's.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("digest"), F.char_length("text").cast("long").alias("size"))
    index, _ = _numbered(_marked(rows, "turns"), "index")
    first = index.groupBy(F.col("conv_id").alias("c")).agg(F.min("index").alias("first"))
    return index.join(first, F.col("conv_id") == F.col("c")).select("conv_id", (F.col("index") - F.col("first")).alias("at"), "digest", "size")


def rebuilt(conversations: DataFrame, group: int = GROUP, lengths: int = LENGTHS) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id; their turns: conv_id, at, digest, size), where each begins with the first turns of its group's base.

    conv_id c takes h = crc32(decimal c) % lengths turns of conversation
    c - c % group, or all it has, and then its own after its first h. A null
    role or text is empty; rows without a conv_id belong to none and are left
    out; a repeated row is a turn of its own; other columns are ignored.
    """
    own = materialize(turns(conversations), "turns")
    ids = own.select("conv_id").distinct().select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % lengths).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = own.where(F.col("at") < lengths - 1).where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("b"), "at", "digest", "size")
    has = first.groupBy(F.col("b").alias("hb")).agg(F.count("*").alias("n"))
    ids = ids.join(has, F.col("base") == F.col("hb"), "left").select("conv_id", "h", "base", F.least(F.col("h"), F.coalesce("n", F.lit(0))).alias("taken"))
    ids = materialize(ids, "conversations")
    given = ids.join(first, (F.col("base") == F.col("b")) & (F.col("at") < F.col("h"))).select("conv_id", "at", "digest", "size")
    kept = own.join(ids.select(F.col("conv_id").alias("c"), "h", "taken"), F.col("conv_id") == F.col("c")).where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "size")
    return ids.select("conv_id"), materialize(given.union(kept), "rebuilt")


def dense_names(rows: DataFrame, keys: list[str], name: str, start: int = 0) -> tuple[DataFrame, int]:
    """``rows`` (written already) with ``name``, a number from ``start`` on for each distinct ``keys``, without gaps; and the next free number."""
    distinct = rows.groupBy(keys).agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)))
    named, free = _numbered(_marked(distinct, "keys"), name, start)
    match = [F.col(k) == F.col(f"_{i}") for i, k in enumerate(keys)]
    return rows.join(named.select(*(f"_{i}" for i in range(len(keys))), name), match).select(*rows.columns, name), free


def prefix_names(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, size) of every prefix of 1 and more turns; equal prefixes have one node. ``rows``: conv_id, at, digest, size."""
    named, _ = dense_names(rows, ["digest"], "name")
    level = materialize(named.select("conv_id", F.col("at").alias("block"), "name", "size"), "names")
    longest = level.agg(F.max("block")).first()[0]
    sizes, blocks, k = level.select("conv_id", (F.col("block") + 1).alias("depth"), "size"), [level.drop("size")], 0
    if longest is None:
        return sizes.withColumn("node", F.lit(0).cast("long"))
    depths = longest + 1
    while 2 << k <= depths:
        half = blocks[-1]
        right = half.where(F.col("block") % 2 == 1).select(F.col("conv_id").alias("c"), (F.col("block") - 1).alias("r"), F.col("name").alias("second"))
        pairs = half.join(right, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("r"))).select("conv_id", F.shiftright("block", 1).alias("block"), F.col("name").alias("first"), "second")
        joined, _ = dense_names(materialize(pairs, "pairs"), ["first", "second"], "name")
        blocks.append(materialize(joined.select("conv_id", "block", "name"), "names"))
        k += 1
    # a prefix whose depth is a power of two is a block; others follow by the number of bits
    low = lambda d: d.bitwiseAND(-d)
    tail = None
    for i, b in enumerate(blocks):
        own = b.select("conv_id", ((F.col("block") + 1) * (1 << i)).alias("depth"), F.col("name").alias("last"))
        own = own.where(low(F.col("depth")) == 1 << i)
        tail = own if tail is None else tail.union(own)
    tail = materialize(tail, "tails")
    bits = F.bit_count("depth")
    done, free = dense_names(tail.where(bits == 1), ["depth", "last"], "node")
    done = materialize(done.select("conv_id", "depth", "node"), "prefixes")
    found, before = done, done
    for n in range(2, (depths + 1).bit_length()):
        up = before.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("node").alias("head"))
        rest = tail.where(bits == n).join(up, (F.col("conv_id") == F.col("c")) & (F.col("depth") - low(F.col("depth")) == F.col("d"))).select("conv_id", "depth", "head", "last")
        named, free = dense_names(materialize(rest, "heads"), ["depth", "head", "last"], "node", free)
        before = materialize(named.select("conv_id", "depth", "node"), "prefixes")
        found = found.union(before)
    found = found.withColumnsRenamed({"conv_id": "c", "depth": "d"})
    return found.join(sizes, (F.col("c") == F.col("conv_id")) & (F.col("d") == F.col("depth"))).select("conv_id", "depth", "node", "size")


def _digest(batches):
    """Rows come sorted by node and block: one digest for each node, over its blocks in order."""
    schema = to_arrow_schema(ENDS)
    now, digest, out = None, None, []
    for batch in batches:
        for conv, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, depth) != now:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (conv, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, digest.hexdigest()), schema)], schema=schema)


def _chains(members: DataFrame) -> DataFrame:
    """Members with the node above (parent) and below (next) in their own conversation, and ``below``: what the conversation owns at this depth or deeper.

    A conversation is cut into parts of CHUNK depths; the row beyond each border stands in both parts.
    """
    depth, home = F.col("depth"), F.floor(F.col("depth") / CHUNK)
    owned = F.when(F.col("own") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("size")).otherwise(0)
    parts = F.array(home, F.when((depth % CHUNK == 0) & (depth > 0), home - 1), F.when(depth % CHUNK == CHUNK - 1, home + 1))
    rows = members.withColumn("owned", owned).withColumn("home", home).withColumn("part", F.explode(F.filter(parts, lambda p: p.isNotNull())))
    ahead, down = Window.partitionBy("conv_id", "part").orderBy("depth"), Window.partitionBy("conv_id", "part").orderBy(F.desc("depth"))
    rows = rows.select("*", F.lag("own").over(ahead).alias("parent"), F.lead("own").over(ahead).alias("next"), F.sum(F.when(F.col("part") == F.col("home"), F.col("owned")).otherwise(0)).over(down).alias("here")).where("part = home")
    sums = members.groupBy(F.col("conv_id").alias("c"), home.alias("h")).agg(F.sum(owned).alias("s"))
    later = sums.select("c", "h", F.sum("s").over(Window.partitionBy("c").orderBy(F.desc("h")).rowsBetween(Window.unboundedPreceding, -1)).alias("later")).where("later is not null")
    rows = rows.join(later, (F.col("conv_id") == F.col("c")) & (F.col("home") == F.col("h")), "left")
    return rows.select("conv_id", "depth", "node", "own", "n_convs", "parent", "next", (F.col("here") + F.coalesce("later", F.lit(0))).alias("below"))


def prefix_trie(given: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row for each node, a distinct sequence of first turns: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``given``: all conversations (conv_id), and their turns (conv_id, at,
    digest, size). Conversations without turns are members of the root alone.
    Without any conversation there is no root, and the result is empty.
    """
    ids, rows = given
    prefixes = prefix_names(rows)
    root = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("node"), F.lit(0).cast("long").alias("size"))
    members = materialize(root.unionByName(prefixes), "members")
    nodes = members.groupBy("node").agg(F.min("conv_id").alias("own"), F.count("*").alias("n_convs"))
    members = materialize(members.join(nodes.withColumnRenamed("node", "x"), F.col("node") == F.col("x")).drop("x"), "members")
    chain = materialize(_chains(members), "chains")
    # a node that its own conversation ends at may go on in others
    goes_on = chain.where("next is not null").groupBy(F.col("node").alias("x")).agg(F.sum(F.when(F.col("next") == F.col("conv_id"), 1).otherwise(0)).alias("n_children"))
    leaf = chain.where("next is null and own = conv_id").select("conv_id", "node").join(goes_on, F.col("node") == F.col("x"), "left_anti").select(F.col("conv_id").alias("lc"))
    counted = chain.join(leaf, F.col("conv_id") == F.col("lc"), "left")
    sums = counted.groupBy("node").agg(
        F.min("own").alias("conv_id"), F.min("depth").alias("depth"), F.min(F.when(F.col("own") == F.col("conv_id"), F.col("parent"))).alias("parent_conv_id"),
        F.min("n_convs").alias("n_convs"), F.count("lc").alias("n_leaves"), F.sum("below").alias("saved_tokens"),
    )
    ends = chain.where("next is null").groupBy("own", "depth", F.floor(F.col("conv_id") / RANGE).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    ends = ends.select("own", "depth", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ends = ends.repartition("own", "depth").sortWithinPartitions("own", "depth", "block").select("own", "depth", "ids").mapInArrow(_digest, ENDS)
    out = sums.join(goes_on, F.col("node") == F.col("x"), "left").join(ends, (F.col("conv_id") == F.col("e_conv")) & (F.col("depth") == F.col("e_depth")), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
