"""Incremental evaluation: content-addressed manifests, deltas, and a file stream that refreshes changed modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(rows: DataFrame, module: str, columns: list[str]) -> DataFrame:
    """(module, version, n): a digest of the module's rows, whatever their order and however many.

    Rows are digested one by one, the digests summed as four numbers of 60 bits
    modulo 2^60 in partial sums, and the sums and the count digested. No
    module's rows are put together; repeated rows count each.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0"))
    row = F.sha2(F.concat_ws("\x00", *(text(c) for c in columns)), 256)
    parts = rows.select(module, *(F.conv(F.substring(row, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)").alias(f"h{k}") for k in range(4)))
    sums = parts.groupBy(module).agg(F.count("*").alias("n"), *((F.sum(f"h{k}") % F.lit(1 << 60).cast("decimal(38,0)")).cast("long").alias(f"h{k}") for k in range(4)))
    version = F.sha2(F.concat_ws("\x00", F.col(module).cast("string"), F.col("n").cast("string"), *(F.col(f"h{k}").cast("string") for k in range(4))), 256)
    return sums.select(module, F.substring(version, 1, 16).alias("version"), "n")


def delta(before: DataFrame, after: DataFrame, module: str) -> DataFrame:
    """(module, op): added, deleted (a tombstone), changed or same."""
    a, b = before.select(F.col(module).alias("old"), F.col("version").alias("v1")), after.select(F.col(module).alias("new"), F.col("version").alias("v2"))
    op = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("v1") != F.col("v2"), "changed").otherwise("same")
    return a.join(b, F.col("old") == F.col("new"), "full_outer").select(F.coalesce("new", "old").alias(module), op.alias("op"))


def refresh(rows: DataFrame, results: DataFrame, module: str, old: DataFrame, columns: list[str], evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results for ``rows``: kept for unchanged modules, evaluated for new and changed ones, dropped for deleted ones."""
    changes = delta(old, manifest(rows, module, columns), module)
    again = rows.join(changes.where("op in ('added', 'changed')").select(module), module, "left_semi")
    kept = results.join(changes.where("op = 'same'").select(module), module, "left_semi")
    return kept.unionByName(evaluate(again))


def follow(spark: SparkSession, folder: str, schema, checkpoint: str, on_batch: Callable[[DataFrame, int], None]):
    """Run the batch plan on each set of new module files in a folder; the started query."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
