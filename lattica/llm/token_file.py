"""Token ids in seekable zstandard files.

A file holds one or more independent zstandard frames for each document (more
only beyond ``FRAME_BYTES``), then a skippable frame with the documents (id,
number of tokens, number of frames), then the public seekable-format table: a
skippable frame with the compressed size, size and checksum (low half of the
XXH64) of every frame. A reader loads the two tables and decompresses only the
frames of the documents asked for.

Files hold ascending, disjoint ranges of doc_id. Each is written under an
attempt's own name and renamed, so that a task that runs again, or twice, leaves
one whole file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import drop_held, fresh_path, id_and_text, map_columns, materialize
from .vocabulary import load

SKIPPABLE, SEEK_MAGIC, TABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1, b"LTDOCS01"
#: Uncompressed bytes of a frame at most; the format's sizes have 32 bits.
FRAME_BYTES = 1 << 28
LEVEL = 3
_NO_ID = -(1 << 63)


def filesystem(uri: str):
    """The store and the path in it that a uri names."""
    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes the documents of one file in the order they come."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.frames, self.docs, self.ids, self.bytes = out, [], [], 0, 0
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        pieces = [ids[i : i + FRAME_BYTES] for i in range(0, len(ids), FRAME_BYTES)]
        for raw in pieces:
            packed = self.compressor.compress(raw)
            self.put(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append((_NO_ID if doc_id is None else doc_id, len(ids) // 4, len(pieces)))
        self.ids += len(ids) // 4

    def close(self) -> None:
        docs = np.array(self.docs, dtype="<i8").reshape(-1, 3).tobytes()
        body = TABLE_MAGIC + zstandard.compress(docs) + struct.pack("<I", zlib.crc32(docs))
        self.put(struct.pack("<II", SKIPPABLE, len(body)) + body)
        table = np.array(self.frames, dtype="<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.put(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Random access to one file (a seekable binary stream)."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        end = stream.tell()
        if end < 9:
            raise ValueError("not a token file")
        stream.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEK_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table")
        table = end - 9 - 12 * n
        stream.seek(table)
        self.frames = np.frombuffer(stream.read(12 * n), dtype="<u4").reshape(-1, 3).astype("i8")
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        stream.seek(int(self.starts[-1]))  # the documents' table follows the last frame
        body = stream.read(table - 8 - int(self.starts[-1]))[8:]
        raw = zstandard.decompress(body[8:-4])
        if body[:8] != TABLE_MAGIC or zlib.crc32(raw) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("the documents' table is damaged")
        self.docs = np.frombuffer(raw, dtype="<i8").reshape(-1, 3)
        self.first = np.concatenate([[0], np.cumsum(self.docs[:, 2])])
        self.decompressor = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> bytes:
        """The ids of the k-th document, checked."""
        out = []
        for f in range(self.first[k], self.first[k + 1]):
            self.stream.seek(int(self.starts[f]))
            raw = self.decompressor.decompress(self.stream.read(int(self.frames[f, 0])))
            if len(raw) != self.frames[f, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[f, 2]:
                raise ValueError(f"frame {f} is damaged")
            out.append(raw)
        return b"".join(out)

    def doc_id(self, k: int) -> int | None:
        return None if (i := int(self.docs[k, 0])) == _NO_ID else i

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with that id (the file is sorted by it)."""
        return list(range(*(int(np.searchsorted(self.docs[:, 0], doc_id, side)) for side in ("left", "right"))))


MANIFEST = StructType([StructField("shard", LongType()), StructField("path", StringType()), StructField("n_docs", LongType()), StructField("n_ids", LongType()), StructField("n_bytes", LongType())])


def write_token_files(docs: DataFrame, out_dir: str, vocabulary_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every document, write the files, and return their manifest (a written table; one row for each file).

    Documents are dealt by ranges of doc_id and sorted in each range; null ids
    come first, equal ids in the order of their texts. A null text is empty:
    only the end id is written for it. An empty table writes no file.
    """
    docs = id_and_text(docs, id_col, text_col)
    dealt = docs.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def make():
        vocabulary, state = load(vocabulary_path), {}
        shard = TaskContext.get().partitionId()

        def write(ids, texts):
            if not state:
                store, folder = filesystem(out_dir)
                store.create_dir(folder, recursive=True)
                state.update(store=store, final=f"{folder}/part-{shard:06d}.ids.zst", tmp=f"{folder}/_attempt-{uuid.uuid4().hex}")
                state["stream"] = store.open_output_stream(state["tmp"])
                state["writer"] = Writer(state["stream"])
            for i, raw in zip(ids, vocabulary.encode(texts)):
                state["writer"].add(i, raw + end)

        def finish():
            if state:
                w = state["writer"]
                w.close()
                state["stream"].close()
                state["store"].move(state["tmp"], state["final"])
                yield {"shard": [shard], "path": [os.path.basename(state["final"])], "n_docs": [len(w.docs)], "n_ids": [w.ids], "n_bytes": [w.bytes]}

        write.finish = finish
        return write

    return materialize(map_columns(dealt, MANIFEST, make, keeps=True), "token-manifest")


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (bytes) of every document, read from the files, each by a task of its own.

    The manifest has a row for each file, so its rows are few however many
    documents there are; the files' starts are summed on the driver.
    """
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        files.append((r.path, start))
        start += r.n_ids
    schema = StructType([StructField("doc_id", LongType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])
    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))

    def run(batches):
        import pyarrow as pa

        drop_held()
        store, folder = filesystem(out_dir)
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(f"{folder}/{path}") as stream:
                    reader = Reader(stream)
                    n = len(reader.docs)
                    for at in range(0, n, 4096):
                        part = range(at, min(n, at + 4096))
                        tokens = reader.docs[at : at + 4096, 1]
                        starts = base + np.concatenate([[0], np.cumsum(tokens)])
                        base = int(starts[-1])
                        crc = [zlib.crc32(reader.ids(k)) for k in part]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([reader.doc_id(k) for k in part], pa.int64()), "start": pa.array(starts[:-1], pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return listed.mapInArrow(run, schema)


def find_document(spark: SparkSession, out_dir: str, manifest: DataFrame, doc_id: int) -> list[list[int]]:
    """The ids of the documents with that id; only their frames are decompressed."""
    store, folder = filesystem(out_dir)
    found = []
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        with store.open_input_file(f"{folder}/{r.path}") as stream:
            reader = Reader(stream)
            found += [np.frombuffer(reader.ids(k), dtype="<u4").tolist() for k in reader.find(doc_id)]
    return found


def write_and_read(docs: DataFrame, vocabulary_path: str, end_id: int | None = 1, **columns) -> DataFrame:
    """Write the documents' ids to a fresh folder beside the checkpoints and read the files back."""
    spark = docs.sparkSession
    out_dir = fresh_path(spark, "token-ids")
    return read_token_files(spark, out_dir, write_token_files(docs, out_dir, vocabulary_path, end_id, **columns))
