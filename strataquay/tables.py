"""Access to the project's Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a snapshot row that describe its delivery and are not content.
DELIVERY_COLUMNS = ("row_id", "run_tag", "loaded_at", "dist", "rnum")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def content_columns(rows: DataFrame) -> list[str]:
    """The ``cot_*`` and ``thm_*`` columns in name order."""
    return sorted(c for c in rows.columns if c.startswith(("cot_", "thm_")))


def last_run_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot rows that belong to the run with the highest ``run_no``."""
    newest = table(spark, folder, "snapshot_runs").select(F.max_by("run_tag", "run_no").alias("run_tag"))
    return table(spark, folder, "snapshots").join(newest, "run_tag", "left_semi")


def usable_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Loads with status ok: ``cot_theme_id, run_tag, run_no``."""
    loads = table(spark, folder, "theme_loads").where("load_status = 'ok'").select("cot_theme_id", "run_tag").distinct()
    return loads.join(table(spark, folder, "snapshot_runs").select("run_tag", "run_no"), "run_tag")
