"""History and dashboard queries over the snapshot runs, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.diffs import canonical_text, stored_hashes
from ..tables import content_columns, table
from . import view_sql
from .history import PREV, RUN, SEVERITIES, THEME, History

#: Columns by meaning; others keep their raw name.
LABELS = {
    "cot_addr_full_new": "road address", "cot_addr_full_old": "lot address", "cot_conts_id": "id", "cot_conts_lan_type": "language", "cot_conts_name": "name", "cot_conts_stat": "state",
    "cot_coord_data": "shape", "cot_coord_type": "kind of shape", "cot_coord_x": "longitude", "cot_coord_y": "latitude", "cot_dong_name": "neighbourhood", "cot_extra_data_01": "further data",
    "cot_extra_name": "further address", "cot_gu_name": "district", "cot_img_main_url": "image", "cot_kw": "key words", "cot_line_color": "line colour", "cot_line_pattern": "line pattern",
    "cot_line_weight": "line weight", "cot_master_no": "main lot", "cot_mbr_max_x": "eastern edge", "cot_mbr_max_y": "northern edge", "cot_mbr_min_x": "western edge", "cot_mbr_min_y": "southern edge",
    "cot_nation_base_area": "base area", "cot_nation_point_number": "point number", "cot_reg_date": "registered", "cot_san_name": "mountain lot", "cot_slave_no": "sub lot", "cot_tel_no": "telephone",
    "cot_theme_id": "theme", "cot_theme_sub_id": "category", "cot_update_date": "updated", "thm_coord_type": "theme shape", "thm_theme_name": "theme name", "thm_theme_type": "theme type",
}


def column_label(column: Column) -> Column:
    """Numbered detail columns by their number, others by the list, else as they are."""
    number = F.regexp_extract(column, "^cot_(?:value|name)_([0-9]+)$", 1).try_cast("int").cast("string")
    listed = F.create_map(*[F.lit(t) for pair in LABELS.items() for t in pair])
    return (
        F.when(F.startswith(column, F.lit("cot_value_")) & number.isNotNull(), F.concat(F.lit("detail "), number))
        .when(F.startswith(column, F.lit("cot_name_")) & number.isNotNull(), F.concat(F.lit("title of detail "), number))
        .otherwise(F.coalesce(F.try_element_at(listed, column), column))
    )


def snapshot_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Each usable load's order-independent content hash."""
    return History(spark, folder).hashes


def stored_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The hash under which a usable load's text columns are stored as JSON."""
    h = History(spark, folder)
    rows = table(spark, folder, "snapshots").join(h.ok_loads.select(THEME, RUN), [THEME, RUN], "left_semi")
    texts = [c for c, kind in rows.dtypes if c in h.columns and kind == "string"]
    return stored_hashes(rows, scope=(RUN, THEME), columns=texts, id_column="cot_conts_id")


def snapshot_added(spark: SparkSession, folder: str) -> DataFrame:
    """J6"""
    return History(spark, folder).changes.where("change = 'added'").drop("change")


def snapshot_removed(spark: SparkSession, folder: str) -> DataFrame:
    """J7"""
    return History(spark, folder).changes.where("change = 'removed'").drop("change")


def snapshot_modified(spark: SparkSession, folder: str) -> DataFrame:
    """Changed fields of modified rows."""
    return History(spark, folder).fields


def timestamp_only(spark: SparkSession, folder: str) -> DataFrame:
    """I3"""
    return History(spark, folder).changes.where("change = 'dates_only'").drop("change")


def diff_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A18"""
    return History(spark, folder).change_counts


def finding_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Findings that came or were resolved."""
    return History(spark, folder).finding_diff.where("change in ('added', 'resolved')")


def severity_changed(spark: SparkSession, folder: str) -> DataFrame:
    """J10"""
    return History(spark, folder).finding_diff.where("change = 'severity_changed'")


def unchanged_count(spark: SparkSession, folder: str) -> DataFrame:
    """Findings after less those that came or changed."""
    return History(spark, folder).finding_diff.groupBy(THEME, PREV, RUN).agg(
        (F.count_if(F.col("severity_after").isNotNull()) - F.count_if(F.col("change") == "added") - F.count_if(F.col("change") == "severity_changed")).alias("unchanged")
    )


def rules_effect_split(spark: SparkSession, folder: str) -> DataFrame:
    """I2"""
    return History(spark, folder).rules_effect.where("change <> 'unchanged'")


def version_log(spark: SparkSession, folder: str) -> DataFrame:
    """I1, U7"""
    return History(spark, folder).versions


def last_version(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every theme."""
    return History(spark, folder).versions.groupBy(THEME).agg(F.max("version").alias("versions"), F.max_by(RUN, "version").alias(RUN), F.max_by("row_count", "version").alias("row_count"))


def catalog_merge(spark: SparkSession, folder: str) -> DataFrame:
    """J11, J12, I4"""
    return History(spark, folder).catalogue


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A2"""
    return History(spark, folder).status_counts()


def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """A3, A17"""
    return History(spark, folder).run_totals()


def guards(spark: SparkSession, folder: str) -> DataFrame:
    """A23, I5"""
    return History(spark, folder).guards()


def health(entry_status: Column) -> Column:
    """How a theme stands."""
    return (
        F.when((entry_status != "ok") | F.col("error").isNull(), "unchecked").when(F.col("error") > 0, "error")
        .when(F.col("suspect") > 0, "suspect").when(F.col("info") > 0, "info").otherwise("clean")
    )


def theme_health(spark: SparkSession, folder: str) -> DataFrame:
    """Themes by standing, zero-filled."""
    counted = History(spark, folder).catalogue.groupBy(health(F.col("status")).alias("health")).agg(F.count(F.lit(1)).alias("themes"))
    every = spark.createDataFrame([(h,) for h in ("error", "suspect", "info", "clean", "unchecked")], "health string")
    return every.join(counted, "health", "left").na.fill(0)


def themes_with_severity(spark: SparkSession, folder: str) -> DataFrame:
    """A15"""
    return History(spark, folder).catalogue.where("status = 'ok' and error is not null").agg(*[F.count_if(F.col(s) > 0).alias(s) for s in SEVERITIES])


def _grouped(name: str) -> Column:
    return S.grouped_number(F.col(name).cast("bigint"))


def row_change_text() -> Column:
    """What became of rows; new dates only where there are some."""
    dates = F.when(F.col("dates_only") > 0, F.concat(F.lit(", dates only "), _grouped("dates_only"))).otherwise("")
    return F.concat(F.lit("added "), _grouped("added"), F.lit(", removed "), _grouped("removed"), F.lit(", modified "), _grouped("modified"), dates)


def finding_change_text() -> Column:
    """What became of findings."""
    return F.concat(F.lit("new "), _grouped("findings_added"), F.lit(", resolved "), _grouped("findings_resolved"), F.lit(", regraded "), _grouped("findings_severity_changed"))


def changed_themes(spark: SparkSession, folder: str) -> DataFrame:
    """Themes whose rows or findings changed, and those with new dates only."""
    rows = F.col("added") + F.col("removed") + F.col("modified")
    found = F.col("findings_added") + F.col("findings_resolved") + F.col("findings_severity_changed")
    listed = History(spark, folder).catalogue.where("compared").withColumns({"row_changes": rows, "finding_changes": found})
    kind = F.when((F.col("row_changes") > 0) | (F.col("finding_changes") > 0), "changed").when(F.col("dates_only") > 0, "dates_only")
    order = Window.partitionBy("kind").orderBy(F.desc_nulls_first("row_changes"), F.desc_nulls_first("finding_changes"), "name", THEME)  # one row a theme
    return listed.withColumn("kind", kind).where("kind is not null").select(
        THEME, "name", "kind", "row_changes", "finding_changes", "dates_only", row_change_text().alias("row_text"), finding_change_text().alias("finding_text"), F.row_number().over(order).alias("place")
    )


def department_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Departments with their place in the ranking, the unknown one last."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    grouped = History(spark, folder).catalogue.groupBy("department").agg(
        F.count(F.lit(1)).alias("themes"), F.count_if(F.col("status") == "ok").alias("checked"), *[total(s) for s in SEVERITIES], total("findings_added"), total("findings_resolved")
    )
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("department") == "unknown", F.desc("error"), F.desc("suspect"), "department")  # one row a department
    return grouped.withColumn("place", F.row_number().over(order))


#: Departments on the first page, hits of a search.
TOP_DEPARTMENTS, MOST_HITS = 10, 30


def top_departments(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten departments and the length of each one's bar against the longest, in per cent."""
    longest = F.greatest(F.lit(1), F.max("error").over(Window.partitionBy(F.lit(1))))  # one row a department
    ranked = department_rollup(spark, folder).withColumn("_longest", longest)
    return ranked.where(F.col("place") <= TOP_DEPARTMENTS).select("department", "place", "error", F.round(100 * F.col("error") / F.col("_longest"), 6).alias("bar"))


def _by_trouble() -> list[Column]:
    """O3: errors, then suspects, unknown last; names in Korean order (Hangul before Latin)."""
    return [F.desc(F.coalesce("error", F.lit(-1))), F.desc(F.coalesce("suspect", F.lit(-1))), F.collate("name", "ko"), F.col(THEME)]


def home_totals(spark: SparkSession, folder: str) -> DataFrame:
    """V1: what the first page says of the whole collection."""
    return History(spark, folder).catalogue.agg(
        F.count(F.lit(1)).alias("themes"), F.count_if(F.col("status") == "ok").alias("readable"), F.sum("row_count").cast("bigint").alias("rows"),
        *[F.sum(s).cast("bigint").alias(s) for s in SEVERITIES], F.count_if(F.col("added") + F.col("removed") + F.col("modified") > 0).alias("changed"),
    )


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """A line a run for the log."""
    h = History(spark, folder)
    met = h.run_totals().join(h.status_counts().select(RUN, "themes"), RUN)
    parts = [_grouped("themes_read"), F.lit(" of "), _grouped("themes"), F.lit(" themes, "), _grouped("rows"), F.lit(" rows, "), *[x for s in SEVERITIES for x in (_grouped(s), F.lit(f" {s}, "))]]
    changed = F.when(F.col("themes_changed").isNull(), "nothing compared").otherwise(F.concat(_grouped("themes_changed"), F.lit(" themes changed")))
    return met.select(RUN, F.concat(F.col(RUN), F.lit(": "), *parts, changed).alias("line"))


def version_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every two versions of a theme, named in either order, as the older and the newer one."""
    log = History(spark, folder).versions.select(THEME, "version", RUN)
    named = log.select(THEME, F.struct("version", RUN).alias("_one")).join(log.select(THEME, F.struct("version", RUN).alias("_two")), THEME).where("_one.version <> _two.version")
    return named.select(THEME, F.least("_one", "_two").alias("_older"), F.greatest("_one", "_two").alias("_newer")).distinct().select(
        THEME, F.col(f"_older.{RUN}").alias("older"), F.col(f"_newer.{RUN}").alias("newer")
    )


def department_page(spark: SparkSession, folder: str) -> DataFrame:
    """V3, O3: the themes of every department by errors and suspects."""
    order = Window.partitionBy("department").orderBy(*_by_trouble())
    return History(spark, folder).catalogue.select("department", THEME, "name", "error", "suspect", F.row_number().over(order).alias("place"))


def theme_search(spark: SparkSession, folder: str) -> DataFrame:
    """Themes whose name or department holds the words, white space and case aside; the first 30 by trouble."""
    needle = S.compact(F.lit(" 행정 지원"))
    hit = F.contains(S.compact(F.col("name")), needle) | F.contains(S.compact(F.col("department")), needle) | F.contains(S.compact(F.col("name")), S.compact(F.lit("쉼 터")))
    placed = History(spark, folder).catalogue.where(hit).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*_by_trouble())))  # one row a theme
    return placed.where(F.col("place") <= MOST_HITS).select(THEME, "name", "department", "place")


def new_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of each compared load that its predecessor didn't have."""
    h = History(spark, folder)
    new = h.finding_diff.where("change = 'added'").select(THEME, RUN, "fingerprint")
    return h.findings.join(new, [THEME, RUN, "fingerprint"], "left_semi").select(THEME, RUN, "rule_id", "severity", "conts_key", "fingerprint")


def finding_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Suspect findings of two rules whose name, key or value holds the words."""
    h, needle = History(spark, folder), S.compact(F.lit("동 물"))
    texts = [F.contains(S.compact(F.col(c)), needle) for c in ("name", "conts_key", "value")]
    return h.findings.where(F.col("rule_id").isin("C-08", "C-10") & (F.col("severity") == "suspect") & (texts[0] | texts[1] | texts[2])).select(
        THEME, RUN, "rule_id", "conts_key", "group_key", "name"
    )


def paged_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Every finding with its page of 100 in its theme's list and the number of pages."""
    h = History(spark, folder)
    order = [F.coalesce(F.col(c), F.lit("")) for c in ("rule_id", "conts_key", "group_key", "field", "value")]
    by_rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "suspect", 1).otherwise(2)
    listed = h.findings.withColumn("place", F.row_number().over(Window.partitionBy(THEME, RUN).orderBy(by_rank, *order)))
    sizes = h.findings.groupBy(THEME, RUN).agg(F.ceil(F.count(F.lit(1)) / 100).alias("pages"))
    return listed.join(sizes, [THEME, RUN]).select(THEME, RUN, "fingerprint", "severity", (F.floor((F.col("place") - 1) / 100) + 1).alias("page"), "pages")


def compare_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Changed fields with column labels and the row's name, the later one preferred."""
    h = History(spark, folder)
    names = h.rows.select(THEME, RUN, "key", "name")
    return (
        h.fields.join(names.withColumnRenamed("name", "_after"), [THEME, RUN, "key"], "left")
        .join(names.select(THEME, F.col(RUN).alias(PREV), "key", F.col("name").alias("_before")), [THEME, PREV, "key"], "left")
        .select(THEME, PREV, RUN, "key", column_label(F.col("column")).alias("label"), F.coalesce("_after", "_before").alias("name"), "before", "after")
    )


def display_value(canonical: Column) -> Column:
    """Canonical text as people read it: no zeros that only fill decimals."""
    return F.when(F.rlike(canonical, F.lit(r"^-?[0-9]+\.[0-9]+$")), F.regexp_replace(canonical, r"\.?0+$", "")).otherwise(canonical)


def row_detail(spark: SparkSession, folder: str) -> DataFrame:
    """The filled fields of every row that has an error, with how they are shown."""
    h = History(spark, folder)
    kinds = dict(table(spark, folder, "snapshots").dtypes)
    hit = h.findings.where("severity = 'error' and conts_key is not null").select(THEME, RUN, F.col("conts_key").alias("key")).distinct()
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in h.columns]), F.array(*[canonical_text(c, kinds[c]) for c in h.columns]))
    shown = h.keyed(hit).select(THEME, RUN, "key", F.explode(values).alias("column", "value"))
    filled = shown.where("value <> '\x00' and trim(value) <> ''")
    number = F.col("column").isin(*[c for c in h.columns if kinds[c] == "double"])
    return filled.withColumn("value", F.when(number, display_value(F.col("value"))).otherwise(F.col("value"))).withColumn("label", column_label(F.col("column")))


def mode_title(spark: SparkSession, folder: str) -> DataFrame:
    """Each theme's commonest title of its detail columns, the smallest where they tie."""
    rows = table(spark, folder, "snapshots")
    titles = rows.select(THEME, F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(n).alias("title")) for n, v in (("cot_name_01", "cot_value_01"), ("cot_name_03", "cot_value_03"))])).alias("_t")).select(THEME, "_t.*")
    counted = titles.where("trim(title) <> ''").groupBy(THEME, "column", "title").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(THEME, "column").agg(F.min(F.struct((-F.col("n")).alias("least"), "title")).alias("_top")).select(THEME, "column", F.col("_top.title").alias("label"))


def public_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Public themes with an id, the first of each id, names trimmed; the list holds repeats."""
    listed = table(spark, folder, "snapshots").select("row_id", THEME, F.col("thm_theme_name").alias("name")).join(
        table(spark, folder, "themes").select(THEME, "thm_theme_stat"), THEME, "left"
    )
    # the first occurrence by place in the list, from partial aggregates
    public = listed.where((F.trim(THEME) != "") & (F.col("thm_theme_stat") == "1"))
    return public.groupBy(THEME).agg(F.min(F.struct("row_id", F.trim("name").alias("name"))).alias("_first")).select(THEME, "_first.row_id", "_first.name")


def run_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Stamps of every event: local minute, run tag, label, age at a fixed instant."""
    instant = F.col("ts").cast("timestamp_ntz")
    minute = S.local_minute(instant)
    tag = S.run_tag(minute)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, folder, "events").select("event_id", minute.alias("minute"), tag.alias("tag"), S.tag_label(tag).alias("label"), S.time_ago(instant, now).alias("age"))


def json_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers out of JSON text; broken JSON gives null."""
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def format_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers as people read them."""
    return table(spark, folder, "orders").select(
        "o_orderkey", S.grouped_number(F.floor("o_totalprice")).alias("price"), S.distance_text(F.col("o_totalprice") / 7).alias("distance"), S.number_text(F.floor("o_totalprice").cast("double") / 2).alias("half")
    )


def url_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Last path segment, its extension-free mark, and an encoded and decoded name."""
    url = F.col("cot_img_main_url")
    return table(spark, folder, "snapshots").select(
        "row_id", F.element_at(F.split(url, "/"), -1).alias("segment"), S.decoded_url(F.url_encode(F.col("cot_conts_name"))).alias("name"),
    )


def number_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed texts, and numbers written as text."""
    return table(spark, folder, "snapshots").select("row_id", S.trimmed(F.col("cot_slave_no")).alias("slave"), S.parsed_number(F.col("cot_slave_no")).alias("number"), S.parsed_number(F.col("cot_theme_sub_id")).alias("code"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        snapshot_hash, snapshot_added, snapshot_removed, snapshot_modified, timestamp_only, diff_counts, finding_diff, severity_changed, unchanged_count,
        rules_effect_split, version_log, last_version, catalog_merge, status_counts, run_totals, guards, theme_health, themes_with_severity, changed_themes,
        department_rollup, department_page, theme_search, new_findings, finding_filter, paged_findings, compare_versions, row_detail, mode_title, public_filter,
        run_stamps, json_scalars, format_texts, url_scalars, number_scalars, stored_hash, top_departments, home_totals, run_log, version_pairs,
    )
}
ORACLE: dict[str, str] = dict(view_sql.QUERIES)
