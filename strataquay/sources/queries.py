"""Queries of the source checks over pages derived from the snapshot rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import table
from .pages import page_states, read_envelopes

SIZE = 100


def derived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every load as pages of 100 rows in JSON envelopes, with faults by theme and run.

    The last digit of the theme's id and the run's number choose the fault: a changed
    total, a wrong page number, a refused load, a broken body, a missing count.
    """
    rows = table(spark, folder, "snapshots").select("run_tag", "cot_theme_id", "row_id")
    runs = table(spark, folder, "snapshot_runs").select("run_tag", "run_no")
    # ranks within a load come from its sorted rows; only ids are moved
    ranked = rows.join(runs, "run_tag").withColumn("place", F.row_number().over(Window.partitionBy("run_tag", "cot_theme_id").orderBy("row_id")) - 1)
    pages = ranked.groupBy("run_tag", "run_no", "cot_theme_id", (F.floor(F.col("place") / SIZE) + 1).alias("page_no")).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("run_tag", "cot_theme_id").agg(F.count(F.lit(1)).alias("all"))
    fault = F.pmod(F.right("cot_theme_id", F.lit(1)).try_cast("int") + F.col("run_no"), F.lit(7))
    met = pages.join(totals, ["run_tag", "cot_theme_id"]).withColumn("fault", F.coalesce(fault, F.lit(6)))
    total = F.when((F.col("fault") == 0) & (F.col("page_no") > 1), F.col("all") + 1).otherwise(F.col("all"))
    said = F.when((F.col("fault") == 1) & (F.col("page_no") == 2), F.lit(9)).otherwise(F.col("page_no"))
    refused = F.col("fault") == 2
    head = F.when(F.col("page_no") % 2 == 0, "head").otherwise("header")
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i.cast("string")), ",")
    body = F.concat(
        F.lit('{"'), head, F.lit('":{"'), F.when(head == "head", "RETCODE").otherwise("resultCode"), F.lit('":"'), F.when(refused, "400").otherwise("200"),
        F.lit('","TOTAL_COUNT":"'), total.cast("string"), F.lit(f'","PAGE_SIZE":{SIZE},"PAGE_NO":'), said.cast("string"), F.lit('},"body":['), items, F.lit("]}"),
    )
    broken = (F.col("fault") == 3) & (F.col("page_no") == 1)
    return met.select(
        "run_tag", "cot_theme_id", F.col("page_no").cast("int").alias("page_no"), F.when(refused, 400).otherwise(200).alias("http_status"),
        F.when(broken, F.lit("<html>")).otherwise(body).alias("body"),
    )


def page_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every load from its pages."""
    return page_states(read_envelopes(derived_pages(spark, folder)), keys=["run_tag", "cot_theme_id"], page_size=SIZE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"page_validation": page_validation}
ORACLE = {
    "page_validation": """WITH ranked AS (
      SELECT run_tag, run_no, cot_theme_id, row_number() OVER (PARTITION BY run_tag, cot_theme_id ORDER BY row_id) - 1 AS place FROM snapshots JOIN snapshot_runs USING (run_tag)),
    pages AS (SELECT run_tag, cot_theme_id, (right(cot_theme_id, 1)::INT + run_no) % 7 AS fault, place // 100 + 1 AS page_no, count(*) AS n FROM ranked GROUP BY ALL)
    SELECT run_tag, cot_theme_id, sum(CASE WHEN fault = 3 AND page_no = 1 THEN 0 ELSE n END)::BIGINT AS rows,
      CASE WHEN max(fault) = 2 THEN 'unavailable' WHEN max(fault) = 3 THEN 'error' WHEN max(fault) = 0 AND count(*) > 1 THEN 'incomplete'
        WHEN max(fault) = 1 AND count(*) > 1 THEN 'incomplete' ELSE 'ok' END AS state FROM pages GROUP BY ALL"""
}
