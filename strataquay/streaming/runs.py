"""Runs as a stream (an extension): every micro-batch is one delivered snapshot.

The stream keeps the newest state of every key as a table of fixed-width hashes
and appends what changed.  Each batch writes its state under its own number,
so a batch that is repeated after a failure gives the same files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.changes import content_hash


def _state(rows: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    h1, h2 = content_hash(content)
    per_row = rows.select(F.col(key).alias("key"), h1.alias("h1"), h2.alias("h2")).distinct()
    return per_row.groupBy("key").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))


def batch_changes(before: DataFrame | None, rows: DataFrame, *, key: str, content: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The new state, and ``key, change`` against ``before``; without an earlier state nothing has changed."""
    now = _state(rows, key, content)
    if before is None:
        return now, now.select("key", F.lit("added").alias("change")).limit(0)
    a, b = now.alias("a"), before.alias("b")
    met = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")), "full_outer")
    change = F.when(F.col("b.h1").isNull(), "added").when(F.col("a.h1").isNull(), "removed").otherwise("modified")
    differs = ~(F.col("a.h1").eqNullSafe(F.col("b.h1")) & F.col("a.h2").eqNullSafe(F.col("b.h2")))
    return now, met.where(differs).select(F.coalesce("a.key", "b.key").alias("key"), change.alias("change"))


def stream_snapshot_changes(
    spark: SparkSession, source: str, schema: StructType, target: str, *, key: str, content: Sequence[str], available_now: bool = True
) -> StreamingQuery:
    """Follow a folder of Parquet snapshots, one file a run; write states and changes under ``target``."""

    def handle(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        before = session.read.parquet(f"{target}/state/batch={number - 1}") if number else None
        now, changes = batch_changes(before, rows, key=key, content=content)
        now.write.mode("overwrite").parquet(f"{target}/state/batch={number}")
        changes.write.mode("overwrite").parquet(f"{target}/changes/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{target}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
