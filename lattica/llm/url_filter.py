"""URL filter over a sorted digest array.

Rules are strings ``host/path``. They are kept in one file: the sorted 64-bit
xxHash keys of the rules, their offsets and verdicts, and the rule strings
themselves. Executors memory-map the file, hash every (host suffix, path
prefix) that a rule could have, find all keys of a batch by one vectorised
binary search, and compare the stored string before a key counts, so that
colliding keys never decide.

The file is as large as the rule list, not as the input; it reaches the
executors through Spark's own file distribution and is fetched again by an
executor that replaces a lost one.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_columns

MAGIC = b"LTDIGST1"
SEED = 0
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): both empty for null or a url without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_ASCII_LOWER), path


def build_index(block: list[str], allow: list[str]) -> bytes:
    """The index file. A rule in both lists allows; repeated rules count once."""
    verdicts = {r: 0 for r in block} | {r: 1 for r in allow}
    rules = {}
    for rule, allowed in verdicts.items():
        if "/" not in rule or rule.startswith("/"):
            raise ValueError(f"a rule needs a host and a path: {rule!r}")
        host, _, path = rule.partition("/")
        rules[host.translate(_ASCII_LOWER) + "/" + path] = allowed
    rows = sorted((xxhash.xxh64_intdigest(r.encode(), SEED), r.encode(), a) for r, a in rules.items())
    keys = np.array([k for k, _, _ in rows], dtype="<u8")
    offsets = np.cumsum([0, *(len(r) for _, r, _ in rows)]).astype("<u8")
    flags = np.array([a for _, _, a in rows], dtype="u1")
    lengths = np.array(sorted({len(r.decode()[r.decode().index("/") :]) for _, r, _ in rows}), dtype="<u4")
    longest = max((r.decode().index("/") for _, r, _ in rows), default=0)
    head = MAGIC + struct.pack("<QII", len(rows), len(lengths), longest)
    return head + lengths.tobytes() + keys.tobytes() + offsets.tobytes() + flags.tobytes() + b"".join(r for _, r, _ in rows)


class DigestIndex:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        self.map = np.memmap(path, dtype="u1", mode="r")
        assert bytes(self.map[:8]) == MAGIC, "not a digest index"
        n, n_lengths, self.longest_host = struct.unpack("<QII", bytes(self.map[8:24]))
        at = 24
        self.path_lengths = self.map[at : at + 4 * n_lengths].view("<u4").tolist()
        at += 4 * n_lengths
        self.keys = np.frombuffer(self.map, dtype="<u8", count=n, offset=at)
        at += 8 * n
        self.offsets = np.frombuffer(self.map, dtype="<u8", count=n + 1, offset=at)
        at += 8 * (n + 1)
        self.flags = self.map[at : at + n]
        self.strings = self.map[at + n :]

    def candidates(self, host: str, path: str) -> list[str]:
        """Every string that could be a rule for the url: host suffixes by path prefixes of known lengths."""
        if not host or not path:
            return []
        starts, at = [0] * (len(host) <= self.longest_host), host.find(".", max(0, len(host) - self.longest_host - 1))
        while at >= 0:
            starts.append(at + 1)
            at = host.find(".", at + 1)
        prefixes = [path[:k] for k in self.path_lengths if k <= len(path)]
        return [host[s:] + p for s in starts for p in prefixes]

    def lookup(self, strings: list[str]) -> list[int | None]:
        """1 (allow), 0 (block) or None (no such rule) for each string."""
        if not strings or not len(self.keys):
            return [None] * len(strings)
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        probe = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in raw), dtype="u8", count=len(raw))
        low, high = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        out: list[int | None] = [None] * len(strings)
        for i in np.flatnonzero(high > low).tolist():
            for k in range(low[i], high[i]):  # more than one where keys collide
                if bytes(self.strings[self.offsets[k] : self.offsets[k + 1]]) == raw[i]:
                    out[i] = int(self.flags[k])
                    break
        return out

    def judge(self, urls: list[tuple[str, str]], default: str = "allow") -> list[tuple[str | None, str]]:
        """(rule, verdict) of each (host, path). The longest rule wins; at one length, that with the longer host."""
        own, strings = [], []
        for i, (host, path) in enumerate(urls):
            found = self.candidates(host, path)
            own += [i] * len(found)
            strings += found
        best: list[tuple | None] = [None] * len(urls)
        for i, s, hit in zip(own, strings, self.lookup(strings)):
            if hit is not None and (best[i] is None or (len(s), s.index("/")) > best[i][:2]):
                best[i] = (len(s), s.index("/"), s, hit)
        return [(None, default) if b is None else (b[2], "allow" if b[3] else "block") for b in best]


#: Index files that an application's executors were given.
_published: set[tuple[str, str]] = set()


def publish(spark, index: bytes) -> str:
    """Hand the index file to all executors; its name there."""
    name = f"lattica-digest-{hashlib.sha256(index).hexdigest()[:24]}.bin"
    key = (spark.sparkContext.applicationId, name)
    if key not in _published:
        path = os.path.join(tempfile.mkdtemp(prefix="lattica-"), name)
        with open(path, "wb") as f:
            f.write(index)
        spark.sparkContext.addFile(path)
        _published.add(key)
    return name


def filter_urls(pages: DataFrame, block: list[str], allow: list[str], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no
    rule and gets the default verdict. A url without a path fits no rule, as
    every rule's path starts with a slash. Null ids and repeated rows pass
    through unchanged; other columns are ignored; an empty table gives an
    empty result.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    name = publish(pages.sparkSession, build_index(block, allow))
    schema = StructType([pages.schema["page_id"], *(StructField(c, StringType()) for c in ("host", "path", "rule", "verdict"))])

    def make():
        index = DigestIndex(SparkFiles.get(name))

        def judge(ids, urls):
            parts = [split_url(u) for u in urls]
            found = index.judge(parts, default)
            return {"page_id": ids, "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [r for r, _ in found], "verdict": [v for _, v in found]}

        return judge

    return map_columns(pages, schema, make)
