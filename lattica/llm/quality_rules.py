"""Quality rules: text statistics of each document, and lines that recur across a host's documents.

Method: the normalised lines of every document are hashed, the distinct
documents of each (host, line) counted (equal texts are one document), lines
above the host's limit removed, and documents rejected of which too little is
left. Copies are met within each task before the shuffle of line hashes.

At most (mean lines a document) x (root of the host's documents) lines of a
host can exceed its limit, so the removal list is small; it is written to the
shared folder, and Spark broadcasts it only if the written size is under its
own threshold (else it joins by host, splitting skewed hosts).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .common import map_columns, materialize, utf8

#: A line is removed where more than this share of its host's documents, and more than so many of them, hold it.
MAX_SHARE, MIN_DOCUMENTS = 0.1, 20
#: Where no share is given, a line is removed that more distinct texts of its host hold than this and the root of their number.
MIN_TEXTS = 5
#: A document is rejected if less than this share of its words is left.
MIN_LEFT = 0.5
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, "#*$%&|<>"
#: (host, line) sums that a task holds before it passes them on.
HELD = 40_000


def line_key(line: bytes) -> int | None:
    """Signed 64-bit hash of a line with A-Z lower-cased and white space squeezed; None for a line without words."""
    words = line.split()
    return xxhash.xxh64_intdigest(b" ".join(words).lower()) - (1 << 63) if words else None


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    blanks = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            many = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
            hit = np.zeros(n, dtype=bool)
            for k in range(3):
                hit[k : k + len(windows)] |= many
            repeat = int(hit.sum())
    return n, (len(text) - blanks if text else 0), symbols, len(lines) - len(set(lines)), repeat


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def line_keys(text: str | None) -> set[int]:
    return {k for x in set(utf8(text).split(b"\n")) if (k := line_key(x)) is not None}


def _document_counts(docs: DataFrame) -> DataFrame:
    """(host, line, n): the documents of each line; a null line counts all of the host."""

    def make():
        sums: Counter = Counter()
        rows: Counter = Counter()

        def flush():
            out = {"host": [h for h, _ in sums] + list(rows), "line": [k for _, k in sums] + [None] * len(rows), "n": [*sums.values(), *rows.values()]}
            sums.clear()
            rows.clear()
            return out

        def count(hosts, texts):
            for host, text in zip(hosts, texts):
                rows[host] += 1
                sums.update((host, k) for k in line_keys(text))
            return flush() if len(sums) > HELD else None

        count.finish = lambda: [flush()]
        return count

    schema = StructType([StructField("host", StringType()), StructField("line", LongType()), StructField("n", LongType())])
    return map_columns(docs, schema, make).groupBy("host", "line").agg(F.sum("n").alias("n"))


def _distinct_text_counts(docs: DataFrame) -> DataFrame:
    """(host, line, n): the distinct texts of each line; a null line counts all of the host.

    A text is told by its 128-bit digest, so that only its line hashes are
    shuffled. Copies are met within each task first.
    """

    def make():
        def keys(hosts, texts):
            return {"host": hosts, "digest": [None if t is None else xxhash.xxh3_128_digest(utf8(t)) for t in texts], "lines": [sorted(line_keys(t)) for t in texts]}

        return keys

    schema = StructType([StructField("host", StringType()), StructField("digest", BinaryType()), StructField("lines", ArrayType(LongType()))])
    once = map_columns(docs, schema, make).distinct()
    lines = F.concat(F.array(F.lit(None).cast("long")), "lines")
    return once.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))


def frequent_lines(docs: DataFrame, max_share: float | None, min_documents: int) -> DataFrame:
    """(host, lines): for each host the hashes of its lines above the limit. ``docs``: host, text.

    Without ``max_share`` only distinct texts of a host count, and the limit
    grows with the square root of their number.
    """

    docs = docs.select("host", "text")
    counts = _distinct_text_counts(docs) if max_share is None else _document_counts(docs)
    counts = materialize(counts, "line-counts")
    size = counts.where("line is null").select(F.col("host").alias("h"), F.col("n").alias("docs"))
    # a line over the limit is in more than min_documents; that filter comes before the join
    many = counts.where(F.col("line").isNotNull() & (F.col("n") > min_documents))
    over = many.join(size, many.host.eqNullSafe(size.h)).where(F.col("n") > (F.lit(max_share) * F.col("docs") if max_share is not None else F.sqrt("docs")))
    return materialize(over.groupBy("host").agg(F.collect_list("line").alias("lines")), "frequent-lines")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_share: float | None = MAX_SHARE, min_documents: int | None = None, min_left: float = MIN_LEFT, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_left and, if asked for, clean_text (without the removed lines), changed (whether any was) and the columns to carry.

    Without ``max_share`` equal texts of a host count once, and a document
    needs as many words after the removal of lines as before it; with it a
    document is a row, and repeated rows count as often as they occur. A
    document is kept if it does not fail the base rules and enough of its
    words is left. A null text has no words and fails. A null host is a host of its own. Lines
    without a word are neither counted nor removed. Columns of other names are
    ignored; an empty table gives an empty result.
    """
    carry = carry or []
    if min_documents is None:
        min_documents = MIN_TEXTS if max_share is None else MIN_DOCUMENTS
    least = MIN_WORDS if max_share is None else 0
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    frequent = frequent_lines(narrow, max_share, min_documents).withColumnRenamed("host", "h")
    joined = narrow.join(frequent, narrow.host.eqNullSafe(frequent.h), "left").select("doc_id", "text", "lines", *(f"_c_{c}" for c in carry))
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [narrow.schema["doc_id"], *(StructField(c, LongType()) for c in longs), StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), StructField("words_left", LongType())]
    fields += [StructField("clean_text", StringType()), StructField("changed", BooleanType())] * with_text + [narrow.schema[f"_c_{c}"] for c in carry]

    def make():
        sets: dict[int, tuple] = {}

        def frequent_set(lines):
            key = hash(tuple(lines))
            if sets.get(key, (None,))[0] != lines:
                if len(sets) > 1000:
                    sets.clear()
                sets[key] = (lines, frozenset(lines))
            return sets[key][1]

        def judge(ids, texts, lines, *others):
            out: dict[str, list] = {f.name: [] for f in fields}
            for text, known in zip(texts, lines):
                stats = statistics(text)
                left, clean, changed = stats[0], text, False
                if known:
                    common = frequent_set(known)
                    parts = utf8(text).split(b"\n")
                    gone = [line_key(x) in common for x in parts]
                    if changed := any(gone):
                        left -= sum(len(x.split()) for x, g in zip(parts, gone) if g)
                        clean = b"\n".join(x for x, g in zip(parts, gone) if not g).decode("utf-8", "surrogatepass") if with_text else None
                failed = base_failed(stats[0], stats[4])
                for c, v in zip(longs, stats):
                    out[c].append(v)
                out["base_failed"].append(failed)
                out["kept"].append(not failed and left >= min_left * stats[0] and left >= least)
                out["words_left"].append(left)
                if with_text:
                    out["clean_text"].append(clean)
                    out["changed"].append(changed)
            out["doc_id"] = ids
            for c, values in zip(carry, others):
                out[f"_c_{c}"] = values
            return out

        return judge

    return map_columns(joined, StructType(fields), make)
