"""What the operators share: the shared folder, written tables and Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are turned into Python objects at a time; bounds a worker's memory, not the result.
SLICE_ROWS = 256
#: Rows of an Arrow batch, where the session does not say.
BATCH_ROWS = 2048

_own_dirs: dict[str, str] = {}
_held: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and Spark runs inside one process (tests), a temporary
    folder is made once for each application; on a cluster an error is raised.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lattica-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that text operators read, under fixed names; other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def release() -> None:
    """Give freed memory back to the system: Python workers are reused, and stand beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def hold(drop: Callable[[], None]) -> None:
    """Say that this process keeps something from task to task, and how to drop it."""
    _held.append(drop)


def drop_held() -> None:
    """Drop what tasks of another operator have kept: Python workers outlive their stage, and a table of theirs would stand beside the next one's."""
    if not _held:
        return
    while _held:
        _held.pop()()
    gc.collect()
    release()


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches in a session that has Spark's own default of 10,000 rows: JVM and worker each hold some batches of whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_columns(df: DataFrame, schema: StructType, make: Callable[[], Callable[..., dict | None]], keeps: bool = False) -> DataFrame:
    """mapInArrow over slices of columns.

    ``make()`` runs once in each task and returns the function that gets the
    columns of a slice as Python lists (in df's order) and returns the output
    columns by name, or None for no rows. A ``finish`` attribute of that
    function, if there is one, yields more outputs at the task's end. Only a
    ``make`` that keeps something for the worker's next task finds what was kept.
    """
    bound_batches(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def batch_of(cols: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x := cols[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_held()
        fn = make()
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                out = fn(*[c.to_pylist() for c in part.columns])
                if out is not None:
                    yield batch_of(out)
        for out in getattr(fn, "finish", lambda: ())():
            yield batch_of(out)
        del fn
        release()

    return df.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """A text's UTF-8 bytes; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
