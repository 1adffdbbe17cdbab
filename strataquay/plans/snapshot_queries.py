"""Queries p1 to p3 over full snapshots, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.phone import DIALABLE, unusable_phone
from ..functions.text import is_blank
from ..operators.changes import snapshot_changes
from ..operators.profile import Profile, ProfiledColumn, cells, number_shown, profile_loads, quantiles
from ..operators.proximity import containing_regions, near_pairs
from ..tables import DELIVERY_COLUMNS, content_columns, last_run_rows, table, usable_loads

#: Bounds of usable coordinates, degrees (fixed values).
X_BOUNDS, Y_BOUNDS = (124, 132), (33, 39)
NEAR_M = 10.0
SHARE_MOVE, MEAN_MOVE, LEAST_ROWS = 0.25, 0.15, 10
_ROUNDING = 1e-12


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "snapshots")
    return snapshot_changes(
        rows,
        usable_loads(spark, folder),
        group="cot_theme_id",
        key="cot_conts_id",
        load="run_tag",
        load_order="run_no",
        content=content_columns(rows),
        dates=["cot_update_date"],
    )


def p1_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Cases per theme, load and kind."""
    return p1_found(spark, folder).groupBy("cot_theme_id", "prev_run_tag", "run_tag", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def _outside(column: str, bounds: tuple[int, int]):
    value = F.col(column)
    return value.isNotNull() & (F.isnan(value) | ~value.between(*bounds))


def _rows_with_code_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots with ``_known_code``: the category code is one of its theme's."""
    known = (
        table(spark, folder, "theme_categories").select("cot_theme_id", "cot_theme_sub_id").distinct().withColumn("_known_code", F.lit(True))
    )
    return table(spark, folder, "snapshots").join(known, ["cot_theme_id", "cot_theme_sub_id"], "left")


def foremost_columns() -> list[ProfiledColumn]:
    code = F.col("cot_theme_sub_id")
    return [
        ProfiledColumn("cot_tel_no", unusable=unusable_phone(F.col("cot_tel_no"))),
        ProfiledColumn("cot_coord_x", True, _outside("cot_coord_x", X_BOUNDS)),
        ProfiledColumn("cot_coord_y", True, _outside("cot_coord_y", Y_BOUNDS)),
        ProfiledColumn("cot_theme_sub_id", unusable=~is_blank(code) & F.col("_known_code").isNull()),
    ]


def _profile(spark: SparkSession, folder: str, rows: DataFrame, columns: list[ProfiledColumn]) -> Profile:
    return profile_loads(rows, columns, usable_loads(spark, folder), group="cot_theme_id", load="run_tag", load_order="run_no")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows_with_code_flag(spark, folder)
    shifts = _profile(spark, folder, rows, foremost_columns()).shifts

    def moved(part: str):
        return F.abs(F.col(part) / F.col("rows") - F.col(f"prev_{part}") / F.col("prev_rows")) >= SHARE_MOVE - _ROUNDING

    coordinate = F.col("column_name").isin("cot_coord_x", "cot_coord_y")
    departs = (
        moved("blank")
        | moved("unusable")
        | (coordinate & F.coalesce(F.abs(F.col("mean_usable") - F.col("prev_mean_usable")) >= MEAN_MOVE - _ROUNDING, F.lit(False)))
        | ((F.col("column_name") == "cot_theme_sub_id") & (F.col("max_jump") >= SHARE_MOVE - _ROUNDING))
    )
    loads = shifts.where((F.col("rows") >= LEAST_ROWS) & (F.col("prev_rows") >= LEAST_ROWS) & departs).select(
        F.lit("load").alias("case_kind"),
        F.col("_load").alias("run_tag"),
        F.col("_group").alias("cot_theme_id"),
        "column_name",
        F.lit(0).cast("bigint").alias("row_id"),
    )
    broken = (
        cells(rows, foremost_columns(), group="cot_theme_id", load="run_tag", id_column="row_id")
        .where("_unusable")
        .select(
            F.lit("cell").alias("case_kind"),
            F.col("_load").alias("run_tag"),
            F.col("_group").alias("cot_theme_id"),
            "column_name",
            F.col("_id").alias("row_id"),
        )
    )
    return broken.unionByName(loads)


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Figures, exact quartiles and the shift against the load before for every column but the two that name the load."""
    rows = _rows_with_code_flag(spark, folder)
    known = {c.name: c for c in foremost_columns()}
    kinds = dict(rows.dtypes)
    names = [c for c in (*content_columns(rows), *DELIVERY_COLUMNS) if c not in ("cot_theme_id", "run_tag")]
    columns = [known.get(c) or ProfiledColumn(c, kinds[c] != "string") for c in names]
    profile = _profile(spark, folder, rows, columns)
    key = ["column_name", "_group", "_load"]
    shown = profile.loads.join(quantiles(profile.values, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), key, "left").join(
        profile.shifts.select(*key, F.col("_prev").alias("prev_run_tag"), "ks", "max_jump"), key, "left"
    )
    return shown.select(
        "column_name",
        F.col("_group").alias("cot_theme_id"),
        F.col("_load").alias("run_tag"),
        "rows",
        (F.col("blank") / F.col("rows")).alias("blank_share"),
        "unusable",
        "distinct_values",
        F.coalesce(number_shown(F.col("min_number")), "min_text").alias("min_value"),
        F.coalesce(number_shown(F.col("max_number")), "max_text").alias("max_value"),
        "q25",
        "q50",
        "q75",
        "prev_run_tag",
        F.round("ks", 9).alias("ks"),
        F.round("max_jump", 9).alias("max_jump"),
    )


def p2_column_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and exact Kolmogorov-Smirnov distances of the foremost columns."""
    profile = _profile(spark, folder, _rows_with_code_flag(spark, folder), foremost_columns())
    key = ["column_name", "_group", "_load"]
    return profile.loads.join(profile.shifts.select(*key, "ks"), key, "left").select(
        "column_name",
        F.col("_group").alias("cot_theme_id"),
        F.col("_load").alias("run_tag"),
        "rows",
        "blank",
        "unusable",
        "distinct_values",
        F.round("ks", 6).alias("ks"),
    )


def _located(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("cot_coord_x").between(*X_BOUNDS) & F.col("cot_coord_y").between(*Y_BOUNDS))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _located(last_run_rows(spark, folder)).select("row_id", "cot_conts_id", "cot_coord_x", "cot_coord_y", "cot_gu_name")
    near = near_pairs(
        rows, id_column="row_id", x="cot_coord_x", y="cot_coord_y", distance_m=NEAR_M, differ="cot_conts_id", max_latitude=Y_BOUNDS[1]
    ).select(
        F.lit("near").alias("case_kind"), F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"), F.lit("").alias("gu_name")
    )
    held = containing_regions(
        rows,
        table(spark, folder, "district_boundaries"),
        id_column="row_id",
        x="cot_coord_x",
        y="cot_coord_y",
        name="gu_name",
        part="polygon_no",
        rings="coordinates",
    )
    region = (
        held.join(rows.select(F.col("row_id").alias("id"), "cot_gu_name"), "id")
        .where(~F.col("region").eqNullSafe(F.col("cot_gu_name")))
        .select(F.lit("region").alias("case_kind"), F.col("id").alias("row_id_a"), F.lit(0).cast("bigint").alias("row_id_b"), F.col("region").alias("gu_name"))
    )
    return near.unionByName(region)


def p3_district_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the last run per containing district."""
    held = containing_regions(
        _located(last_run_rows(spark, folder)), table(spark, folder, "district_boundaries"),
        id_column="row_id", x="cot_coord_x", y="cot_coord_y", name="gu_name", part="polygon_no", rings="coordinates",
    )
    return held.groupBy(F.col("region").alias("gu_name")).agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_change_counts, p2_found, p2_profile, p2_column_totals, p3_found, p3_district_rows)
}

_SPACES = " || ".join(f"chr({n})" for n in (9, 10, 11, 12, 13, 32, 160, 12288, 65279))
_BLANK = "trim({c}, " + _SPACES + ") = ''"
_CONTENT = [
    "cot_addr_full_new", "cot_addr_full_old", "cot_conts_id", "cot_conts_lan_type", "cot_conts_name", "cot_conts_stat",
    "cot_coord_data", "cot_coord_type", "cot_coord_x", "cot_coord_y", "cot_dong_name", "cot_extra_data_01", "cot_extra_name",
    "cot_gu_name", "cot_img_main_url", "cot_kw", "cot_line_color", "cot_line_pattern", "cot_line_weight", "cot_master_no",
    "cot_mbr_max_x", "cot_mbr_max_y", "cot_mbr_min_x", "cot_mbr_min_y", "cot_name_01", "cot_name_03", "cot_nation_base_area",
    "cot_nation_point_number", "cot_reg_date", "cot_san_name", "cot_slave_no", "cot_tel_no", "cot_theme_id", "cot_theme_sub_id",
    "cot_value_01", "cot_value_03", "thm_coord_type", "thm_theme_name", "thm_theme_type",
]
_LOADS = """loads AS (
  SELECT cot_theme_id, run_tag, run_no, lag(run_tag) OVER w AS prev_run_tag
  FROM (SELECT DISTINCT cot_theme_id, run_tag FROM theme_loads WHERE load_status = 'ok') JOIN snapshot_runs USING (run_tag)
  WINDOW w AS (PARTITION BY cot_theme_id ORDER BY run_no))"""
_P1 = f"""WITH {_LOADS},
contents AS (
  SELECT s.cot_theme_id, s.cot_conts_id, s.run_tag,
    list_sort(list(DISTINCT struct_pack(a := struct_pack({', '.join(f'{c} := {c}' for c in _CONTENT)}), d := cot_update_date))) AS full_set,
    list_sort(list(DISTINCT struct_pack({', '.join(f'{c} := {c}' for c in _CONTENT)}))) AS kept_set
  FROM snapshots s JOIN loads USING (cot_theme_id, run_tag) GROUP BY ALL),
now AS (SELECT c.*, l.prev_run_tag FROM contents c JOIN loads l USING (cot_theme_id, run_tag) WHERE l.prev_run_tag IS NOT NULL),
was AS (SELECT c.*, l.run_tag AS next_run_tag FROM contents c JOIN loads l ON l.cot_theme_id = c.cot_theme_id AND l.prev_run_tag = c.run_tag)
SELECT coalesce(n.cot_theme_id, w.cot_theme_id) AS cot_theme_id, coalesce(n.cot_conts_id, w.cot_conts_id) AS cot_conts_id,
  coalesce(n.prev_run_tag, w.run_tag) AS prev_run_tag, coalesce(n.run_tag, w.next_run_tag) AS run_tag,
  CASE WHEN w.run_tag IS NULL THEN 'added' WHEN n.run_tag IS NULL THEN 'removed'
    WHEN n.kept_set = w.kept_set THEN 'dates_only' ELSE 'modified' END AS change_kind
FROM now n FULL JOIN was w ON n.cot_theme_id = w.cot_theme_id AND n.cot_conts_id IS NOT DISTINCT FROM w.cot_conts_id AND n.run_tag = w.next_run_tag
WHERE w.run_tag IS NULL OR n.run_tag IS NULL OR n.full_set IS DISTINCT FROM w.full_set"""

_P2_CELLS = f"""flagged AS (
  SELECT s.*, c.cot_theme_sub_id IS NOT NULL AS known_code FROM snapshots s
  LEFT JOIN (SELECT DISTINCT cot_theme_id, cot_theme_sub_id FROM theme_categories) c USING (cot_theme_id, cot_theme_sub_id)),
long AS (
  SELECT row_id, run_tag, cot_theme_id, 'cot_tel_no' AS column_name, CASE WHEN {_BLANK.format(c='cot_tel_no')} THEN NULL ELSE cot_tel_no END AS txt, NULL::DOUBLE AS num,
    coalesce(NOT ({_BLANK.format(c='cot_tel_no')}) AND NOT regexp_full_match(regexp_replace(cot_tel_no, '\\s+', ' ', 'g'), '{DIALABLE}'), false) AS unusable FROM flagged
  UNION ALL SELECT row_id, run_tag, cot_theme_id, 'cot_coord_x', NULL, cot_coord_x,
    coalesce(isnan(cot_coord_x) OR NOT cot_coord_x BETWEEN 124 AND 132, false) FROM flagged
  UNION ALL SELECT row_id, run_tag, cot_theme_id, 'cot_coord_y', NULL, cot_coord_y,
    coalesce(isnan(cot_coord_y) OR NOT cot_coord_y BETWEEN 33 AND 39, false) FROM flagged
  UNION ALL SELECT row_id, run_tag, cot_theme_id, 'cot_theme_sub_id', CASE WHEN {_BLANK.format(c='cot_theme_sub_id')} THEN NULL ELSE cot_theme_sub_id END, NULL,
    coalesce(NOT ({_BLANK.format(c='cot_theme_sub_id')}) AND NOT known_code, false) FROM flagged)"""
_P2 = f"""WITH {_LOADS}, {_P2_CELLS},
figures AS (
  SELECT run_tag, cot_theme_id, column_name, count(*) AS n, count(*) FILTER (txt IS NULL AND num IS NULL) / count(*) AS blank,
    count(*) FILTER (unusable) / count(*) AS broken, avg(num) FILTER (NOT unusable) AS mean FROM long GROUP BY ALL),
pairs AS (SELECT cot_theme_id, run_tag, prev_run_tag FROM loads WHERE prev_run_tag IS NOT NULL),
codes AS (SELECT run_tag, cot_theme_id, txt, count(*) AS k FROM long WHERE column_name = 'cot_theme_sub_id' AND txt IS NOT NULL GROUP BY ALL),
signed AS (
  SELECT p.cot_theme_id, p.run_tag, txt, k / n AS share FROM pairs p JOIN codes USING (cot_theme_id, run_tag)
    JOIN figures f USING (cot_theme_id, run_tag) WHERE f.column_name = 'cot_theme_sub_id'
  UNION ALL SELECT p.cot_theme_id, p.run_tag, txt, -k / n FROM pairs p JOIN codes c ON c.cot_theme_id = p.cot_theme_id AND c.run_tag = p.prev_run_tag
    JOIN figures f ON f.cot_theme_id = p.cot_theme_id AND f.run_tag = p.prev_run_tag WHERE f.column_name = 'cot_theme_sub_id'),
jumps AS (SELECT cot_theme_id, run_tag, max(abs(d)) AS jump FROM (SELECT cot_theme_id, run_tag, txt, sum(share) AS d FROM signed GROUP BY ALL) GROUP BY ALL)
SELECT 'cell' AS case_kind, run_tag, cot_theme_id, column_name, row_id FROM long WHERE unusable
UNION ALL
SELECT 'load', b.run_tag, b.cot_theme_id, b.column_name, 0::BIGINT FROM pairs p
JOIN figures b ON b.cot_theme_id = p.cot_theme_id AND b.run_tag = p.run_tag
JOIN figures a ON a.cot_theme_id = p.cot_theme_id AND a.run_tag = p.prev_run_tag AND a.column_name = b.column_name
LEFT JOIN jumps j ON j.cot_theme_id = p.cot_theme_id AND j.run_tag = p.run_tag
WHERE a.n >= 10 AND b.n >= 10 AND (abs(a.blank - b.blank) >= 0.25 - 1e-12 OR abs(a.broken - b.broken) >= 0.25 - 1e-12
  OR (b.column_name LIKE 'cot_coord%' AND coalesce(abs(a.mean - b.mean) >= 0.15 - 1e-12, false))
  OR (b.column_name = 'cot_theme_sub_id' AND coalesce(j.jump >= 0.25 - 1e-12, false)))"""
_P2_TOTALS = f"""WITH {_LOADS}, {_P2_CELLS},
figures AS (
  SELECT column_name, cot_theme_id, run_tag, count(*) AS rows, count(*) FILTER (txt IS NULL AND num IS NULL) AS blank,
    count(*) FILTER (unusable) AS unusable, count(DISTINCT CASE WHEN num IS NULL AND txt IS NULL THEN NULL ELSE {{'n': num, 't': txt}} END) AS distinct_values
  FROM long GROUP BY ALL),
pairs AS (
  SELECT p.cot_theme_id, p.run_tag, p.prev_run_tag, b.column_name, b.rows AS n, a.rows AS prev_n FROM loads p
  JOIN figures b USING (cot_theme_id, run_tag)
  JOIN figures a ON a.cot_theme_id = p.cot_theme_id AND a.run_tag = p.prev_run_tag AND a.column_name = b.column_name),
signed AS (
  SELECT p.cot_theme_id, p.run_tag, p.column_name, num, txt, 1.0 / n AS w FROM pairs p JOIN long USING (cot_theme_id, run_tag, column_name)
  UNION ALL SELECT p.cot_theme_id, p.run_tag, p.column_name, num, txt, -1.0 / prev_n FROM pairs p
    JOIN long l ON l.cot_theme_id = p.cot_theme_id AND l.run_tag = p.prev_run_tag AND l.column_name = p.column_name),
curve AS (
  SELECT cot_theme_id, run_tag, column_name, sum(w) OVER (PARTITION BY cot_theme_id, run_tag, column_name ORDER BY num, txt) AS c
  FROM (SELECT cot_theme_id, run_tag, column_name, num, txt, sum(w::DOUBLE) AS w FROM signed WHERE num IS NOT NULL OR txt IS NOT NULL GROUP BY ALL)),
ks AS (SELECT cot_theme_id, run_tag, column_name, max(abs(c)) AS ks FROM curve GROUP BY ALL)
SELECT f.column_name, f.cot_theme_id, f.run_tag, f.rows, f.blank, f.unusable, f.distinct_values,
  CASE WHEN p.n IS NULL THEN NULL ELSE round(coalesce(k.ks, 0), 6) END AS ks
FROM figures f LEFT JOIN pairs p USING (cot_theme_id, run_tag, column_name) LEFT JOIN ks k USING (cot_theme_id, run_tag, column_name)"""

_OTHERS = ["loaded_at", "dist", "rnum", "row_id"]


def _long(c: str) -> str:
    unusable = {
        "cot_tel_no": f"coalesce(NOT ({_BLANK.format(c=c)}) AND NOT regexp_full_match(regexp_replace(cot_tel_no, '\\s+', ' ', 'g'), '{DIALABLE}'), false)",
        "cot_coord_x": "coalesce(isnan(cot_coord_x) OR NOT cot_coord_x BETWEEN 124 AND 132, false)", "cot_coord_y": "coalesce(isnan(cot_coord_y) OR NOT cot_coord_y BETWEEN 33 AND 39, false)",
        "cot_theme_sub_id": f"coalesce(NOT ({_BLANK.format(c=c)}) AND NOT known_code, false)",
    }.get(c, "false")
    if c in _OTHERS or c.startswith(("cot_coord_x", "cot_coord_y", "cot_mbr")):
        number = f"epoch_us({c}) / 1e6" if c == "loaded_at" else f"{c}::DOUBLE"
        return f"SELECT run_tag, cot_theme_id, '{c}' AS column_name, NULL AS txt, {number} AS num, {unusable} AS unusable FROM flagged"
    return f"SELECT run_tag, cot_theme_id, '{c}', CASE WHEN {_BLANK.format(c=c)} THEN NULL ELSE {c} END, NULL, {unusable} FROM flagged"


_PROFILED = [*_OTHERS, *[c for c in [*_CONTENT, "cot_update_date"] if c != "cot_theme_id"]]
_NUM_TEXT = "CASE WHEN isnan({n}) THEN 'NaN' ELSE printf('%.6f', {n}) END"
_P2_PROFILE = f"""WITH {_LOADS}, flagged AS (
  SELECT s.*, c.cot_theme_sub_id IS NOT NULL AS known_code FROM snapshots s
  LEFT JOIN (SELECT DISTINCT cot_theme_id, cot_theme_sub_id FROM theme_categories) c USING (cot_theme_id, cot_theme_sub_id)),
long AS ({' UNION ALL '.join(map(_long, _PROFILED))}),
vals AS (SELECT run_tag, cot_theme_id, column_name, txt, num, count(*) AS k FROM long GROUP BY ALL),
figures AS (
  SELECT column_name, cot_theme_id, run_tag, count(*) AS rows, count(*) FILTER (txt IS NULL AND num IS NULL) AS blank, count(*) FILTER (unusable) AS unusable,
    min(num) AS low_num, max(num) AS high_num, min(txt) AS low_txt, max(txt) AS high_txt FROM long GROUP BY ALL),
ranked AS (
  SELECT run_tag, cot_theme_id, column_name, coalesce({_NUM_TEXT.format(n='num')}, txt) AS shown, sum(k) OVER (PARTITION BY run_tag, cot_theme_id, column_name ORDER BY num, txt) AS upto,
    sum(k) OVER (PARTITION BY run_tag, cot_theme_id, column_name) AS total FROM vals WHERE txt IS NOT NULL OR num IS NOT NULL),
picks AS (
  SELECT run_tag, cot_theme_id, column_name, count(*) AS distinct_values, {', '.join(f"arg_min(shown, upto) FILTER (upto >= ceil(total * {q})) AS {n}" for n, q in (('q25', 0.25), ('q50', 0.5), ('q75', 0.75)))} FROM ranked GROUP BY ALL),
pairs AS (
  SELECT p.cot_theme_id, p.run_tag, p.prev_run_tag, b.column_name, b.rows AS n, a.rows AS prev_n FROM loads p JOIN figures b USING (cot_theme_id, run_tag)
  JOIN figures a ON a.cot_theme_id = p.cot_theme_id AND a.run_tag = p.prev_run_tag AND a.column_name = b.column_name),
signed AS (
  SELECT p.cot_theme_id, p.run_tag, p.column_name, num, txt, k / n AS w FROM pairs p JOIN vals USING (cot_theme_id, run_tag, column_name)
  UNION ALL SELECT p.cot_theme_id, p.run_tag, p.column_name, num, txt, -k / prev_n FROM pairs p
    JOIN vals v ON v.cot_theme_id = p.cot_theme_id AND v.run_tag = p.prev_run_tag AND v.column_name = p.column_name),
steps AS (SELECT cot_theme_id, run_tag, column_name, num, txt, sum(w) AS d FROM signed WHERE num IS NOT NULL OR txt IS NOT NULL GROUP BY ALL),
curve AS (SELECT cot_theme_id, run_tag, column_name, d, sum(d) OVER (PARTITION BY cot_theme_id, run_tag, column_name ORDER BY num, txt) AS c FROM steps),
shifts AS (SELECT cot_theme_id, run_tag, column_name, max(abs(c)) AS ks, max(abs(d)) AS jump FROM curve GROUP BY ALL)
SELECT f.column_name, f.cot_theme_id, f.run_tag, f.rows, f.blank / f.rows AS blank_share, f.unusable, coalesce(q.distinct_values, 0) AS distinct_values,
  coalesce({_NUM_TEXT.format(n='low_num')}, low_txt) AS min_value, coalesce({_NUM_TEXT.format(n='high_num')}, high_txt) AS max_value, q25, q50, q75, p.prev_run_tag,
  CASE WHEN p.n IS NOT NULL THEN round(coalesce(s.ks, 0), 9) END AS ks, CASE WHEN p.n IS NOT NULL THEN round(coalesce(s.jump, 0), 9) END AS max_jump
FROM figures f LEFT JOIN picks q USING (cot_theme_id, run_tag, column_name) LEFT JOIN pairs p USING (cot_theme_id, run_tag, column_name) LEFT JOIN shifts s USING (cot_theme_id, run_tag, column_name)"""

_P3_POINTS = """pts AS (
  SELECT row_id, cot_conts_id, cot_coord_x AS x, cot_coord_y AS y, cot_gu_name FROM snapshots
  WHERE run_tag = (SELECT max_by(run_tag, run_no) FROM snapshot_runs) AND cot_coord_x BETWEEN 124 AND 132 AND cot_coord_y BETWEEN 33 AND 39)"""
_P3_HELD = """rings AS (
  SELECT gu_name, polygon_no, ring FROM (SELECT gu_name, polygon_no, unnest(coordinates) AS ring FROM district_boundaries)),
edges AS (
  SELECT gu_name, polygon_no, ring[i][1] AS ax, ring[i][2] AS ay, ring[i + 1][1] AS bx, ring[i + 1][2] AS by_
  FROM (SELECT gu_name, polygon_no, ring, unnest(range(1, len(ring))) AS i FROM rings)),
held AS (
  SELECT row_id, gu_name FROM pts JOIN edges ON (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax
  GROUP BY row_id, gu_name, polygon_no HAVING count(*) % 2 = 1)"""
_P3 = f"""WITH {_P3_POINTS}, {_P3_HELD},
grid AS (SELECT *, floor(x / 0.000125)::BIGINT AS cx, floor(y / 0.00009)::BIGINT AS cy FROM pts),
steps AS (SELECT a.d AS dx, b.d AS dy FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b)
SELECT 'near' AS case_kind, a.row_id AS row_id_a, b.row_id AS row_id_b, '' AS gu_name
FROM (SELECT grid.*, cx + dx AS nx, cy + dy AS ny FROM grid, steps) a JOIN grid b ON b.cx = a.nx AND b.cy = a.ny
WHERE a.row_id < b.row_id AND a.cot_conts_id IS DISTINCT FROM b.cot_conts_id
  AND 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 10
UNION ALL
SELECT 'region', row_id, 0::BIGINT, gu_name FROM held JOIN pts USING (row_id) WHERE gu_name IS DISTINCT FROM cot_gu_name"""

ORACLE: dict[str, str] = {
    "p1_found": _P1,
    "p1_change_counts": f"SELECT cot_theme_id, prev_run_tag, run_tag, change_kind, count(*) AS n FROM ({_P1}) GROUP BY ALL",
    "p2_found": _P2,
    "p2_profile": _P2_PROFILE,
    "p2_column_totals": _P2_TOTALS,
    "p3_found": _P3,
    "p3_district_rows": f"WITH {_P3_POINTS}, {_P3_HELD} SELECT gu_name, count(*) AS n FROM held GROUP BY gu_name",
}
