"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is the logistic of w0 + sum w_i x_i + pairwise interactions, whose
weights are inner products of k-dimensional factors. They are summed in time
linear in the features by 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted on the driver from at most ``MAX_ROWS`` labelled documents, those
with the smallest hashes of their ids; their features, not their texts, are
collected. Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from .common import map_columns, materialize, utf8

#: Labelled documents that the model is fitted on, at most; words of a document's hash space; factors.
MAX_ROWS, WORD_BITS, FACTORS = 6000, 16, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.05, 1e-4, 7
#: Every statistic is given as a number and as one of so many ranges with about equally many documents.
RANGES = 16
SYMBOLS = "#*$%&|<>"
STATISTICS = ("log_chars", "log_words", "word_length", "symbols", "punctuation", "exclamations", "digits", "upper_words", "title_words", "distinct_words", "repeated_lines", "words_a_line", "repeated_windows", "longest_word", "non_ascii", "log_meta_chars")


def statistics(text: str | None, meta_chars: int | None) -> tuple[list[float], Counter]:
    """Structure statistics of a whole text, and its words with A-Z lower-cased."""
    raw = utf8(text)
    words = raw.split()
    n, chars = len(words), len(text or "")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    low = Counter(raw.lower().split())
    windows = list(zip(words, words[1:], words[2:]))
    per = lambda k, of: k / of if of else 0.0
    values = [
        math.log1p(chars), math.log1p(n), per(sum(map(len, words)), n),
        per(sum(raw.count(c.encode()) for c in SYMBOLS), chars), per(raw.count(b".") + raw.count(b",") + raw.count(b";"), n), per(raw.count(b"!"), n),
        per(sum(raw.count(b"%d" % d) for d in range(10)), chars), per(sum(w.isupper() and len(w) > 1 for w in words), n), per(sum(w[:1].isupper() for w in words), n),
        per(len(low), n), per(len(lines) - len(set(lines)), len(lines)), math.log1p(per(n, len(lines))), per(len(windows) - len(set(windows)), len(windows)),
        math.log1p(max(map(len, words), default=0)), per(len(raw) - chars, chars), math.log1p(max(0, chars if meta_chars is None else meta_chars)),
    ]
    return values, low


def word_features(low: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words with damped counts of unit length."""
    if not low:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    ids = np.fromiter((zlib.crc32(w) for w in low), dtype=np.int64, count=len(low)) & ((1 << WORD_BITS) - 1)
    values = np.log1p(np.fromiter(low.values(), dtype=np.float64, count=len(low)))
    return ids.astype(np.int32), (values / np.sqrt((values**2).sum())).astype(np.float32)


class Machine:
    """Ranges of the statistics and the machine's weights."""

    def __init__(self, stats: np.ndarray, seed: int = SEED):
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        self.cuts = [np.unique(np.quantile(c, np.arange(1, RANGES) / RANGES)) for c in stats.T]
        n_stats = stats.shape[1]
        self.base = 1 << WORD_BITS
        size = self.base + n_stats * (RANGES + 1)
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS))

    def rows(self, stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of documents, one after another: ids, values, and where each document starts."""
        n, k = stats.shape
        number = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        ranges = np.stack([np.searchsorted(c, x, "right") for c, x in zip(self.cuts, stats.T)], axis=1)
        own = np.concatenate([np.tile(self.base + np.arange(k) * (RANGES + 1), (n, 1)), self.base + np.arange(k) * (RANGES + 1) + 1 + ranges], axis=1)
        value = np.concatenate([number, np.full((n, k), 1 / math.sqrt(k))], axis=1)
        ids = [np.concatenate([own[i], words[i][0]]) for i in range(n)]
        values = [np.concatenate([value[i], words[i][1]]) for i in range(n)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).astype(np.int64)
        return np.concatenate(ids), np.concatenate(values), starts

    def forward(self, ids, values, starts):
        vx = self.v[ids] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.w[ids] * values, starts)
        return self.w0 + linear + 0.5 * (sums**2 - squares).sum(axis=1), vx, sums

    def score(self, stats: np.ndarray, words: list) -> np.ndarray:
        z = self.forward(*self.rows(stats, words))[0]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def fit(self, stats: np.ndarray, words: list, labels: np.ndarray, seed: int = SEED) -> Machine:
        """Adagrad on the logistic loss in small batches."""
        rng = np.random.default_rng(seed)
        p = np.clip(labels.mean(), 0.01, 0.99)
        self.w0 = math.log(p / (1 - p))
        gw, gv, g0 = np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                ids, values, starts = self.rows(stats[some], [words[i] for i in some])
                z, vx, sums = self.forward(ids, values, starts)
                error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[some]) / len(some)
                doc = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(ids))))
                seen, inverse = np.unique(ids, return_inverse=True)
                e = error[doc]
                dw = np.bincount(inverse, e * values, len(seen)) + DECAY * self.w[seen]
                each = (e * values)[:, None] * (sums[doc] - vx)
                dv = np.stack([np.bincount(inverse, each[:, f], len(seen)) for f in range(FACTORS)], axis=1) + DECAY * self.v[seen]
                gw[seen] += dw**2
                gv[seen] += dv**2
                g0 += error.sum() ** 2
                self.w[seen] -= RATE * dw / np.sqrt(gw[seen])
                self.v[seen] -= RATE * dv / np.sqrt(gv[seen])
                self.w0 -= RATE * error.sum() / math.sqrt(g0)
        return self


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """doc_id and label of the labelled documents to learn from: not held out, label 0 or 1 and the same in all rows of an id."""
    named = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_label"))
    known = named.where(F.col("_label").isin(0, 1) & (fold(F.col("_label_id")) != 1)).groupBy("_label_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other")
    return known.select("_label_id", "_label").orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", max_rows: int = MAX_ROWS) -> Machine | float:
    """The machine, or the only probability there is where the labels are of one class (0.5 without any)."""
    sample = materialize(training_rows(docs, labels, id_col, label_col, max_rows), "training-rows")
    chars = F.col(chars_col).cast("long") if chars_col else F.lit(None).cast("long")
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), chars.alias("chars"))
    # at most max_rows rows of two numbers on the small side
    rows = narrow.join(F.broadcast(sample), F.col("_id") == F.col("_label_id")).select("_id", "text", "chars", "_label", F.xxhash64("_id", "text").alias("order"))
    # a label is one example: of several rows of its id always the same one
    one = rows.groupBy("_id").agg(F.min(F.struct("order", "text", "chars", "_label")).alias("r"))
    rows = one.select("r.text", "r.chars", "r._label", "r.order")
    schema = StructType([StructField("order", LongType()), StructField("label", IntegerType()), StructField("stats", ArrayType(DoubleType())), StructField("ids", ArrayType(IntegerType())), StructField("values", ArrayType(FloatType()))])

    def make():
        def features(texts, chars, label, order):
            found = [statistics(t, c) for t, c in zip(texts, chars)]
            words = [word_features(low) for _, low in found]
            return {"order": order, "label": label, "stats": [s for s, _ in found], "ids": [i.tolist() for i, _ in words], "values": [v.tolist() for _, v in words]}

        return features

    got = sorted(map_columns(rows, schema, make).collect())
    y = np.array([r.label for r in got], dtype=float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    stats = np.array([r.stats for r in got])
    words = [(np.array(r.ids, dtype=np.int32), np.array(r["values"], dtype=np.float32)) for r in got]
    return Machine(stats).fit(stats, words, y)


def score(docs: DataFrame, model: Machine | float, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    A null text is empty; empty texts are scored by their statistics. Without a
    number of characters that of the text is taken. A null id is not held out.
    Repeated rows pass through; other columns are ignored; an empty table gives
    an empty result.
    """
    chars = F.col(chars_col).cast("long") if chars_col else F.lit(None).cast("long")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"), chars.alias("chars"))
    schema = StructType([narrow.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def make():
        model = shared.value

        def judge(ids, held_out, texts, chars):
            if isinstance(model, float):
                scores = [model] * len(ids)
            else:
                found = [statistics(t, c) for t, c in zip(texts, chars)]
                scores = model.score(np.array([s for s, _ in found]), [word_features(low) for _, low in found]).tolist()
            return {"doc_id": ids, "held_out": held_out, "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return judge

    return map_columns(narrow, schema, make)


def classify(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    return score(docs, fit(docs, labels, **columns), **{k: v for k, v in columns.items() if k in ("id_col", "text_col", "chars_col")})
