"""Reading and writing snapshots, results and boundary files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_SHARD = 10_000


def read_boundaries(spark: SparkSession, path: str, *, name: str = "name") -> DataFrame:
    """``region, part, rings`` of a feature collection of polygons and multi-polygons."""
    ring = "array<array<array<double>>>"
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, ring))).when(kind == "MultiPolygon", F.from_json(text, f"array<{ring}>"))
    return raw.select(F.element_at("f.properties", name).alias("region"), F.posexplode(polygons).alias("part", "rings"))


def _text_of(spark: SparkSession, path: str) -> str | None:
    """A small file's text from any storage Spark reaches; None if there is none."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = made.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(made):
        return None
    stream = system.open(made)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def shard_name(number: int) -> str:
    """``rows-000.ndjson``, ``rows-001.ndjson``, ..."""
    return f"rows-{number:03d}.ndjson"


def read_ndjson_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows of ``meta.json`` and ``rows-*.ndjson`` by the header's column names.

    None where there is no header file.  Blank lines are skipped and null stays null.  Values are variants, which keep
    numbers, truth values and texts apart; ``as_text`` gives them as text.
    """
    meta = _text_of(spark, f"{folder}/meta.json")
    if meta is None:
        return None
    columns = json.loads(meta)["columns"]
    lines = spark.read.text(f"{folder}/rows-*.ndjson").where(F.trim("value") != "")
    values = F.from_json("value", "array<variant>")
    null = lambda v: F.when(~F.is_variant_null(v), v)
    return lines.select(values.alias("v")).select(*[null(F.get("v", i)).alias(c) for i, c in enumerate(columns)])


def as_text(rows: DataFrame) -> DataFrame:
    """Variant columns as text, others as they are."""
    return rows.select(*[F.col(c).cast("string").alias(c) if kind == "variant" else F.col(c) for c, kind in rows.dtypes])


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file with its ``file`` and ``broken``; an absent path gives no rows.

    A broken document keeps its row, all values null and ``broken`` true, so that it can be counted.
    """
    try:
        read = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{schema}, file string, broken boolean")
    return read.withColumns({"file": F.col("_metadata.file_path"), "broken": F.col("_corrupt").isNotNull()}).drop("_corrupt")


def write_shards(rows: DataFrame, path: str, *, rows_per_shard: int = ROWS_PER_SHARD) -> None:
    """K1: newline-delimited JSON arrays, at most ``rows_per_shard`` lines a file."""
    # a struct of mixed types can't be an array; each value's own JSON is cut out of its one-field object
    parts = [F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1) for c in rows.columns]
    rows.select(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("value")).write.option("maxRecordsPerFile", rows_per_shard).mode("overwrite").text(path)


def write_themes(rows: DataFrame, path: str, *, partition: str) -> None:
    """K2: replace only the partitions present in ``rows``; stale files of those go with them."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def publish_run(tables: dict[str, DataFrame], run_row: DataFrame, folder: str, run_id: str) -> None:
    """K3, K4: write every table under the run's own path, and the run log's row last.

    Readers list runs from the log, so a run that broke off is never seen.
    """
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}/run_id={run_id}")
    run_row.write.mode("append").parquet(f"{folder}/runs")


def read_as_of(spark: SparkSession, folder: str, name: str, run_id: str) -> DataFrame | None:
    """A table as it was published by one run; None if the log doesn't list the run."""
    try:
        listed = spark.read.parquet(f"{folder}/runs").where(F.col("run_id") == run_id)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if listed.isEmpty():
        return None
    return spark.read.parquet(f"{folder}/{name}/run_id={run_id}")
