"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, a temporary folder of the application."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def dealt(df: DataFrame, key: str, what: str = "table") -> DataFrame:
    """The distinct rows, written in buckets of the key: one shuffle, and none of this table in joins on the key."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lattica_{what}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key).dropDuplicates()
    rows.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


class Growing:
    """A table in buckets of a key (of one column or more) that a loop adds its rounds to: one scan has all of them, and none is shuffled in joins on the key.

    (A union of tables loses their buckets as soon as a filter stands above one.)
    """

    def __init__(self, rows: DataFrame, key: str | list[str], what: str = "table"):
        self.spark, self.key = rows.sparkSession, [key] if isinstance(key, str) else key
        self.buckets, self.name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"lattica_{what}_{uuid.uuid4().hex}"
        self.add(rows)

    def add(self, rows: DataFrame) -> None:
        """Rows that a join or a grouping by the key has left where they belong are not shuffled."""
        rows.write.mode("append").bucketBy(self.buckets, *self.key).option("path", f"{shared_dir(self.spark)}/{self.name}").option("compression", "zstd").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)


def bucketed(df: DataFrame, key: str, what: str = "table") -> DataFrame:
    """Like dealt, of rows that stay as they are."""
    return Growing(df, key, what).table()


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write and reread: cuts the lineage of loops, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lattica-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
