"""Benchmark decontamination by suffix arrays of the training words.

Documents are cut into shards (a few MB of text each, whole documents). Words
become the numbers they have in the benchmark's vocabulary (0 for others). The
suffix array of a shard holds, in the order of their words, all suffixes that
begin like some test window (no other suffix can hold a match), and every test
suffix is located in it by one vectorised binary search for the range that
shares its window: 13 words, or a whole shorter item. The ranges give all
places. At each place the longest match is found among the test suffixes that
share the window, which are adjacent in the tests' own suffix array; these
matches are what is hit, and the documents they cover too much of are removed.

The benchmark reaches the executors by broadcast, in slices of a bounded size.
Each slice is a pass over the documents with what was found so far written
beside them, so that no process holds more than one slice.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import bound_batches, materialize, release, utf8

WINDOW = 13
#: A document is contaminated if at least this share of its words is hit (as a fraction: words times it).
SHARE = (1, 20)
#: Bytes of benchmark text that are broadcast at a time.
SLICE_BYTES = 8 << 20
#: Windows that are searched in a shard at a time.
WINDOWS = 1 << 16
#: Bytes of documents in a shard, beyond which it is closed.
SHARD_BYTES = 4 << 20
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORD_BYTES).split()


def ranks(ids: np.ndarray, longest: int) -> np.ndarray:
    """The place of each suffix in the order of all, by prefix doubling. Negative numbers end an item; each ranks as a word of its own."""
    ends = ids < 0
    rank = np.where(ends, np.cumsum(ends), ids.astype(np.int64) + int(ends.sum()))
    k = 1
    while k <= longest:
        follow = np.concatenate([rank[k:], np.zeros(min(k, len(rank)), dtype=np.int64)])
        values, rank = np.unique(rank * (int(follow.max(initial=0)) + 1) + follow, return_inverse=True)
        if len(values) == len(rank):
            break
        k *= 2
    return rank


class TestSuffixes:
    """The suffix array of a slice of the benchmark. ``items``: (id as text, text)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        read = [(name, np.fromiter(map(number, words_of(text)), dtype=np.int32)) for name, text in items]
        self.items = [(name, ids) for name, ids in read if len(ids)]
        lengths = np.array([len(ids) for _, ids in self.items], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.ids = np.full(int(self.starts[-1]) + window + 1, -1, dtype=np.int32)  # a -1 after each item
        for at, (_, ids) in zip(self.starts.tolist(), self.items):
            self.ids[at : at + len(ids)] = ids
        rank = ranks(self.ids, int(lengths.max(initial=0)))
        widths = np.minimum(lengths, window)
        counts = lengths - widths + 1
        self.groups = []  # (length, suffixes in order, where each distinct window begins among them)
        for n in np.unique(widths).tolist():
            own = np.flatnonzero(widths == n)
            many = counts[own]
            place = np.repeat(self.starts[own] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            array = place[np.argsort(rank[place])].astype(np.int32)
            new = np.zeros(len(array), dtype=bool)
            new[:1] = True
            for j in range(n):
                new[1:] |= self.ids[array[1:] + j] != self.ids[array[:-1] + j]
            self.groups.append((n, array, np.append(np.flatnonzero(new), len(array)).astype(np.int32)))
        self.depth = max((n for n, *_ in self.groups), default=0)
        self.begin = min([4, *(n for n, *_ in self.groups)])
        self.known = np.zeros(1 << _BITS, dtype=bool)
        for _, array, first in self.groups:
            self.known[self.mix([self.ids[array[first[:-1]] + j] for j in range(self.begin)])] = True

    def item(self, suffix) -> np.ndarray:
        """The item (its place in ``items``) of each suffix."""
        return np.searchsorted(self.starts, suffix, "right") - 1

    def mix(self, columns) -> np.ndarray:
        """A bucket for the first words of each suffix; equal words, equal bucket."""
        h = np.zeros(columns[0].shape, dtype=np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * _MIX
        return (h >> np.uint64(64 - _BITS)).astype(np.int64)


class Shard:
    """The suffix array of some documents' words."""

    def __init__(self, docs: list[list[bytes]], tests: TestSuffixes):
        self.tests = tests
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # a 0 after each document
        self.ids = np.zeros(int(self.starts[-1]) + max(tests.depth, tests.begin), dtype=np.int32)
        get = tests.vocabulary.get
        for at, d in zip(self.starts.tolist(), docs):
            self.ids[at : at + len(d)] = [get(w, 0) for w in d]
        n, k = int(self.starts[-1]), tests.begin
        columns = [self.ids[j : n + j] for j in range(k)]
        live = tests.known[tests.mix(columns)]
        for c in columns:
            live &= c > 0
        suffixes = np.flatnonzero(live)
        # sorted by the first depth words; what lies beyond is compared where a match is extended
        self.suffixes = suffixes[np.lexsort([self.ids[suffixes + j] for j in reversed(range(tests.depth))])] if len(suffixes) else suffixes

    def bound(self, rows: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of all rows at once over the first words of the suffixes."""
        n, width = len(self.suffixes), np.arange(rows.shape[1])
        low, high = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), n, dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            have, want = self.ids[self.suffixes[mid][:, None] + width], rows[open_]
            differ = have != want
            first = differ.argmax(axis=1)
            at = np.arange(len(open_))
            less = np.where(differ[at, first], have[at, first] < want[at, first], right)
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low

    def places(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(group, window length, windows, places): every place of every test suffix's window, for some windows at a time."""
        for g, (n, array, first) in enumerate(self.tests.groups):
            for at in range(0, len(first) - 1 if len(self.suffixes) else 0, WINDOWS):
                rows = self.tests.ids[array[first[at : min(at + WINDOWS, len(first) - 1)]][:, None] + np.arange(n)]
                low, high = self.bound(rows, False), self.bound(rows, True)
                counts = high - low
                window = np.repeat(np.arange(len(rows)), counts)
                offset = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
                if len(window):
                    yield g, n, window + at, self.suffixes[low[window] + offset]

    def common(self, place: np.ndarray, suffix: np.ndarray, known: int) -> np.ndarray:
        """Words that the shard's and the tests' suffixes share, of which ``known`` are known to be equal."""
        length, live, step = np.full(len(place), known, dtype=np.int64), np.arange(len(place)), np.arange(16)
        here, there = len(self.ids) - 1, len(self.tests.ids) - 1  # a 0 and a -1: never equal
        while len(live):
            at = length[live][:, None] + step
            differ = self.ids[np.minimum(place[live][:, None] + at, here)] != self.tests.ids[np.minimum(suffix[live][:, None] + at, there)]
            ended = differ.any(axis=1)
            length[live] += np.where(ended, differ.argmax(axis=1), len(step))
            live = live[~ended]
        return length

    def longest(self, g: int, n: int, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest match at each place, and the test suffix that has it.

        Among the test suffixes that share the window, which are adjacent in
        their suffix array, the place's own suffix is searched; one of the two
        beside it shares the most words with it.
        """
        _, array, first = self.tests.groups[g]
        begin, end = first[window].astype(np.int64), first[window + 1].astype(np.int64)
        low, high = begin.copy(), np.where(end - begin > 1, end, begin)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            at = self.common(place[open_], array[mid], n)
            less = self.tests.ids[array[mid] + at] < self.ids[np.minimum(place[open_] + at, len(self.ids) - 1)]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        left, right = array[np.maximum(low - 1, begin)], array[np.minimum(low, end - 1)]
        a, b = self.common(place, left, n), self.common(place, right, n)
        return np.maximum(a, b), np.where(a >= b, left, right)

    def judge(self) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and the items found in each document."""
        return self.search()[:2]

    def search(self) -> tuple[np.ndarray, list[set[str]], list[tuple[int, int, str] | None]]:
        """Which words are hit; the items found in each document; its longest match (words, its word, the item), the first of equals.

        A word is hit if a match covers it. Every window that begins inside a
        longer match has a place of its own, so that the matches cover just
        the words of all occurring windows.
        """
        edge = np.zeros(len(self.ids) + 1, dtype=np.int32)
        items: list[set[str]] = [set() for _ in self.starts[1:]]
        best: list[tuple[int, int, str] | None] = [None] * len(items)
        for g, n, window, place in self.places():
            length, suffix = self.longest(g, n, window, place)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + length, -1)
            doc = np.searchsorted(self.starts, place, "right") - 1
            _, array, first = self.tests.groups[g]
            for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist():
                items[d].update(self.tests.items[k][0] for k in set(self.tests.item(array[first[w] : first[w + 1]]).tolist()))
            order = np.lexsort((place, -length, doc))
            for k in order[np.flatnonzero(np.diff(doc[order], prepend=-1))].tolist():
                d = int(doc[k])
                found = (int(length[k]), int(place[k] - self.starts[d]), self.tests.items[int(self.tests.item(suffix[k]))][0])
                best[d] = min(best[d] or found, found, key=lambda x: (-x[0], x[1]))
        return np.cumsum(edge) > 0, items, best

    def matches(self) -> list[tuple[int, int, str, int, int]]:
        """(document, its word, item, the item's word, words) of every match that can't be extended on either side."""
        found = set()
        for g, n, window, place in self.places():
            _, array, first = self.tests.groups[g]
            many = (first[window + 1] - first[window]).astype(np.int64)
            pair = np.repeat(np.arange(len(window)), many)
            suffix = array[first[window][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)].astype(np.int64)
            p = place[pair]
            item = self.tests.item(suffix)
            s = suffix - self.tests.starts[item]
            fresh = (s == 0) | (p == 0) | (self.ids[p - 1] != self.tests.ids[suffix - 1])
            p, item, s, suffix = p[fresh], item[fresh], s[fresh], suffix[fresh]
            doc = np.searchsorted(self.starts, p, "right") - 1
            for d, at, k, i, m in zip(doc.tolist(), (p - self.starts[doc]).tolist(), item.tolist(), s.tolist(), self.common(p, suffix, n).tolist()):
                found.add((d, at, self.tests.items[k][0], i, m))
        return sorted(found)


def slices(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in slices of bounded size; read by partition, not at once."""
    part, size = [], 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        part.append((name or "", text))
        size += len(utf8(text)) + 64
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


RESULT = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()), StructField("contaminated", BooleanType())]
#: The longest match: its words, its first word in the document, the item.
LONGEST = [StructField("longest", LongType()), StructField("longest_at", LongType()), StructField("longest_item", StringType())]


def _judged(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, share: tuple[int, int], drop: bool, slice_bytes: int) -> DataFrame:
    """All columns of ``docs``, RESULT and LONGEST; or, with drop, only the rows that are not contaminated, as they are.

    Every slice of the benchmark is a pass of its own; what a pass found is
    written beside the documents for the next one, so that neither the driver
    nor a worker holds more than one slice.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [f for f in docs.schema.fields]
    state = [StructField(f"_found_{uuid.uuid4().hex}", kind) for kind in (ArrayType(LongType()), ArrayType(StringType()), *(f.dataType for f in LONGEST))]
    parts = slices(benchmark, item_col, item_text, slice_bytes)
    out, part, first = docs, next(parts, []), True
    while part is not None:
        test = spark.sparkContext.broadcast(TestSuffixes(part, window))
        part = next(parts, None)
        last = part is None
        schema = StructType(kept + (([] if drop else RESULT + LONGEST) if last else state))
        out = out.mapInArrow(_pass(test, first, last, drop, share, len(kept), text_col, to_arrow_schema(schema)), schema)
        if not last:
            out = materialize(out, "decontaminate")
            test.destroy()
        first = False
    return out


def _pass(test, first: bool, last: bool, drop: bool, share, width: int, text_col: str, arrow: pa.Schema):
    text_at = arrow.get_field_index(text_col)

    def run(batches):
        tests = test.value
        for b in batches:
            texts, at = b.column(text_at), 0
            while at < b.num_rows:
                docs, size, end = [], 0, at
                while end < b.num_rows and (size < SHARD_BYTES or end == at):
                    text = texts[end].as_py()
                    docs.append(words_of(text))
                    size += len(text or "")
                    end += 1
                yield finish(b.slice(at, end - at), docs, Shard(docs, tests))
                at = end
        release()

    def finish(part: pa.RecordBatch, docs, shard: Shard) -> pa.RecordBatch:
        hit, items, best = shard.search()
        own = part.columns[:width]
        if not first:
            for k, (before, names, *longest) in enumerate(zip(*(c.to_pylist() for c in part.columns[width:]))):
                hit[int(shard.starts[k]) + np.array(before, dtype=np.int64)] = True
                items[k].update(names)
                if longest[0] is not None:
                    best[k] = min(best[k] or tuple(longest), tuple(longest), key=lambda x: (-x[0], x[1]))
        longest = [pa.array([x and x[j] for x in best], f.type) for j, f in enumerate(to_arrow_schema(StructType(LONGEST)))]
        if not last:
            hits = [np.flatnonzero(hit[a : a + len(d)]).tolist() for a, d in zip(shard.starts.tolist(), docs)]
            return pa.RecordBatch.from_arrays([*own, pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *longest], schema=arrow)
        n = [len(d) for d in docs]
        n_hit = [int(np.count_nonzero(hit[a : a + len(d)])) for a, d in zip(shard.starts.tolist(), docs)]
        bad = [h > 0 and h * share[1] >= w * share[0] for h, w in zip(n_hit, n)]
        if drop:
            return pa.RecordBatch.from_arrays(own, schema=arrow).filter(pa.array([not x for x in bad], pa.bool_()))
        sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        return pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array(bad, pa.bool_()), *longest], schema=arrow)

    return run


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: tuple[int, int] = SHARE, slice_bytes: int = SLICE_BYTES, with_longest: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and, if asked for, longest, longest_at, longest_item.

    The last three name the longest match (its words, its first word in the
    document, an item that has it; the first of equals), null without one.
    Null texts and items have no words; an item without words has no window.
    Items that share an id count once; a null id is written as an empty
    string. Without items nothing is hit. Null ids and repeated rows pass
    through; other columns are ignored; empty tables give empty results.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _judged(narrow, benchmark, "text", item_col, item_text, window, share, False, slice_bytes)
    return out.drop("text", *([] if with_longest else [f.name for f in LONGEST]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: tuple[int, int] = SHARE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents that are not contaminated, columns as they are."""
    return _judged(docs, benchmark, text_col, item_col, item_text, window, share, True, slice_bytes)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id (as text), doc_word, item_word, n_words of every longest verbatim match of a window or more."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    longs = [StructField(c, LongType()) for c in ("doc_word", "item_word", "n_words")]
    schema = StructType([docs.schema["doc_id"], StructField("item_id", StringType()), *longs])
    arrow = to_arrow_schema(schema)

    def one(test):
        def run(batches):
            for b in batches:
                for ids, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rows = [(ids, name, p, s, m) for _, p, name, s, m in Shard([words_of(text)], test.value).matches()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        return docs.mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for part in slices(benchmark, item_col, item_text, slice_bytes):
        out = out.union(one(spark.sparkContext.broadcast(TestSuffixes(part, window))))
    return out
