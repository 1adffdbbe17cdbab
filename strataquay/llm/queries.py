"""Queries p4 to p9 with their SQL counterparts.

Tokenizers can't be said in SQL; p7_check, p8_check and p9_check say what must hold of their results instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import content_columns, last_run_rows, table
from ..session import materialize
from .addresses import AddressFields, building_pairs, buildings, parse_addresses
from .formatting import Copies, collapse_copies
from .mixing import Mixture, mix_sources
from .names import link_names
from .packing import pack_items
from .splitting import split_texts
from .tokens import VOCABULARY, token_count

_SWAPPABLE = [[("cot_name_01", "cot_value_01"), ("cot_name_03", "cot_value_03")]]


def _copies(spark: SparkSession, folder: str) -> Copies:
    rows = table(spark, folder, "snapshots")
    return collapse_copies(
        rows, id_column="row_id", within=["cot_theme_id", "run_tag"], content=content_columns(rows), swappable=_SWAPPABLE
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder).members.select(F.col("representative").alias("row_id_a"), F.col("row").alias("row_id_b"))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record once, with the number of its copies."""
    return _copies(spark, folder).groups.select(F.col("representative").alias("row_id"), "copies")


_ADDRESS = AddressFields("row_id", ("cot_addr_full_new", "cot_addr_full_old", "cot_extra_name"), "cot_gu_name")
_CITY = "한빛(?:특별시|시)?"


def _district_names(spark: SparkSession, folder: str) -> list[str]:
    """The city's districts: a fixed table of a few dozen rows."""
    names = table(spark, folder, "district_boundaries").select("gu_name").where("gu_name is not null").distinct()
    return sorted(row[0] for row in names.collect())


def row_buildings(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """``id, building`` of the rows with a numbered address in either address field."""
    addressed = rows.where((F.coalesce(F.trim("cot_addr_full_new"), F.lit("")) != "") | (F.coalesce(F.trim("cot_addr_full_old"), F.lit("")) != ""))
    parsed = materialize(parse_addresses(addressed, _ADDRESS, city=_CITY, districts=_district_names(spark, folder)))
    return buildings(parsed)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(last_run_rows(spark, folder).select("row_id", *_ADDRESS.fields, "cot_gu_name"))
    found = row_buildings(spark, folder, rows)
    text = F.concat_ws("\x01", *[F.coalesce(c, F.lit("")) for c in _ADDRESS.fields])
    members = found.join(rows.select("row_id", text.alias("text")), found.id == rows.row_id).select("row_id", "building", "text")
    pairs = building_pairs(members, id_column="row_id", group="building", text=F.col("text"))
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p6_buildings(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with a numbered address and the smallest row of its building."""
    rows = last_run_rows(spark, folder).select("row_id", *_ADDRESS.fields, "cot_gu_name")
    found = materialize(row_buildings(spark, folder, rows))
    first = found.groupBy("building").agg(F.min("id").alias("building_row_id"), F.count(F.lit(1)).alias("rows"))
    return found.join(first, "building").select(F.col("id").alias("row_id"), "building_row_id", "rows")


def name_entities(spark: SparkSession, folder: str) -> DataFrame:
    """``id, entity, name`` of the last run's rows whose name is linked to another row's."""
    rows = materialize(last_run_rows(spark, folder).select("row_id", "cot_conts_name", "cot_coord_x", "cot_coord_y", *_ADDRESS.fields, "cot_gu_name"))
    housed = row_buildings(spark, folder, rows)
    x, y = mended_position(F.col("cot_coord_x"), F.col("cot_coord_y"))
    named = rows.select("row_id", "cot_conts_name", x.alias("x"), y.alias("y")).join(
        housed.select(F.col("id").alias("row_id"), "building").hint("merge"), "row_id", "left"
    )
    brands = [d.removesuffix("구") for d in _district_names(spark, folder)]
    entities = link_names(named, id_column="row_id", name="cot_conts_name", x="x", y="y", building="building", brands=brands)
    return entities.join(rows.select(F.col("row_id").alias("id"), F.col("cot_conts_name").alias("name")).hint("merge"), "id")


def mended_position(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude with swapped axes and micro-degrees put right; null if still unusable."""
    scaled = [F.when(F.abs(v) > 1e6, v / 1e6).otherwise(v) for v in (x, y)]
    swapped = scaled[0].between(33, 39) & scaled[1].between(124, 132)
    right = scaled[0].between(124, 132) & scaled[1].between(33, 39)
    return (
        F.when(right, scaled[0]).when(swapped, scaled[1]),
        F.when(right, scaled[1]).when(swapped, scaled[0]),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    entities = name_entities(spark, folder)
    pairs = building_pairs(entities, id_column="id", group="entity", text=F.col("name"))
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p5_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every linked row, the smallest row of its entity, and the entity's rows and spellings."""
    entities = materialize(name_entities(spark, folder))
    whole = entities.groupBy("entity").agg(
        F.min("id").alias("entity_row_id"), F.count(F.lit(1)).alias("rows"), F.countDistinct("name").alias("spellings")
    )
    return entities.join(whole, "entity").select(F.col("id").alias("row_id"), "entity_row_id", "rows", "spellings")


def sized_documents(spark: SparkSession, folder: str, path: str = VOCABULARY) -> DataFrame:
    """Documents with the tokens of their whole texts, written once."""
    documents = table(spark, folder, "documents")
    return materialize(documents.select("doc_id", "source", token_count(F.col("text"), path).alias("tokens")))


def _for_each_limit(frame: DataFrame, limits: DataFrame) -> DataFrame:
    """Every row once for each of a few settings, with ``limit_name, max_tokens``."""
    some = [F.struct(F.lit(r["limit_name"]).alias("limit_name"), F.lit(r["max_tokens"]).alias("max_tokens")) for r in sorted(limits.collect())]
    none = F.array().cast("array<struct<limit_name:string,max_tokens:int>>")
    return frame.withColumn("_limit", F.explode(F.array(*some) if some else none)).select(*frame.columns, "_limit.*")


def _containers(spark: SparkSession, folder: str, sized: DataFrame) -> DataFrame:
    limits = table(spark, folder, "size_limits").where("purpose = 'container'").select("limit_name", "max_tokens").collect()  # a few settings
    packed = None
    for limit in sorted(limits):
        laid = pack_items(sized, id_column="doc_id", size="tokens", capacity=limit["max_tokens"]).select(
            F.lit(limit["limit_name"]).alias("limit_name"),
            "container",
            F.col("id").alias("doc_id"),
            "part",
            F.col("size").alias("tokens"),
            F.col("fill").alias("container_tokens"),
            (F.col("fill") / limit["max_tokens"]).alias("container_fill"),
        )
        packed = laid if packed is None else packed.unionByName(laid)
    return packed


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, the container it lies in and that container's fill, for each container size."""
    return _containers(spark, folder, sized_documents(spark, folder))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per container size the texts laid, and what must be none: texts missing or cut wrongly, containers overfull or misstated."""
    sized = sized_documents(spark, folder)
    laid = materialize(_containers(spark, folder, sized))
    limits = table(spark, folder, "size_limits").where("purpose = 'container'").select("limit_name", "max_tokens")
    by_text = laid.groupBy("limit_name", "doc_id").agg(F.sum("tokens").alias("_sum"), F.count(F.lit(1)).alias("_parts"), F.countDistinct("part").alias("_numbers"))
    wanted = _for_each_limit(sized, limits).join(by_text, ["limit_name", "doc_id"], "full_outer")
    parts = F.greatest(F.ceil(F.col("tokens") / F.col("max_tokens")), F.lit(1))
    texts = wanted.groupBy("limit_name").agg(
        F.count("_sum").alias("texts"), F.count_if(F.col("_sum").isNull() | F.col("tokens").isNull()).alias("missing"),
        F.count_if((F.col("_sum") != F.col("tokens")) | (F.col("_parts") != parts) | (F.col("_numbers") != parts)).alias("cut_wrongly"),
    )
    filled = laid.groupBy("limit_name", "container").agg(F.sum("tokens").alias("_sum"), F.min("container_tokens").alias("_low"), F.max("container_tokens").alias("_high")).join(limits, "limit_name")
    containers = filled.groupBy("limit_name").agg(
        F.count_if(F.col("_sum") > F.col("max_tokens")).alias("overfull"), F.count_if((F.col("_sum") != F.col("_low")) | (F.col("_low") != F.col("_high"))).alias("misstated")
    )
    return texts.join(containers, "limit_name")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per container size: texts, containers, the fewest possible, and the share of room used."""
    limits = table(spark, folder, "size_limits").select("limit_name", "max_tokens")
    laid = p7_containers(spark, folder).groupBy("limit_name").agg(
        F.countDistinct("container").alias("containers"), F.countDistinct("doc_id").alias("texts"), F.sum("tokens").alias("tokens")
    )
    return laid.join(limits, "limit_name").select(
        "limit_name", "texts", "tokens", "containers", F.ceil(F.col("tokens") / F.col("max_tokens")).alias("fewest_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6).alias("fill"),
    )


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return mix_sources(
        sized_documents(spark, folder), table(spark, folder, "source_targets"),
        id_column="doc_id", source="source", size="tokens", share="target_share", cap="max_repeats",
    )


def p8_collection(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn copies in random order."""
    return _mixture(spark, folder).drawn.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("tokens"), "copy", "shuffle_key")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each source was asked for and what it gave."""
    return _mixture(spark, folder).shares


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per source what must be none or true: texts used too often, misnumbered or of another source; the share met to two records' size."""
    mixture = _mixture(spark, folder)
    drawn = materialize(mixture.drawn.select("id", F.col("source").alias("_source"), "size", "copy"))
    targets = table(spark, folder, "source_targets").select("source", "target_share", "max_repeats")
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source")
    used = drawn.groupBy("id", "_source").agg(F.count(F.lit(1)).alias("_n"), F.max("copy").alias("_last"), F.countDistinct("copy").alias("_numbers"), F.max("size").alias("_size"))
    met = used.join(documents, "id", "left").join(targets.select(F.col("source").alias("_source"), "max_repeats"), "_source")
    found = met.groupBy(F.col("_source").alias("source")).agg(
        F.count_if(F.col("_n") > F.col("max_repeats")).alias("too_often"), F.count_if((F.col("_last") != F.col("_n")) | (F.col("_numbers") != F.col("_n"))).alias("misnumbered"),
        F.count_if(~F.col("source").eqNullSafe(F.col("_source"))).alias("of_another"),
    )
    total, largest = drawn.agg(F.sum("size"), F.max("size")).first()
    miss = F.abs(F.col("actual_share") - F.col("target_share"))
    shares = mixture.shares.select("source", ((F.col("available_size") == 0) | (miss <= 2 * (largest or 0) / (total or 1))).cast("int").alias("share_met"))
    return targets.select("source").join(found, "source", "left").na.fill(0).join(shares, "source")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every text above a piece limit."""
    return split_texts(
        table(spark, folder, "documents"), table(spark, folder, "size_limits").where("purpose = 'piece'"),
        id_column="doc_id", text="text", name="limit_name", max_tokens="max_tokens", overlap_tokens="overlap_tokens",
    ).withColumnRenamed("id", "doc_id")


def p9_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per piece limit what must be none: pieces too large or not the text between their offsets, gaps, open ends, long texts left whole."""
    limits = table(spark, folder, "size_limits").where("purpose = 'piece'").select("limit_name", "max_tokens")
    pieces = materialize(p9_pieces(spark, folder))
    documents = table(spark, folder, "documents").select("doc_id", "text", F.char_length("text").alias("_length"))
    cut = pieces.join(documents, "doc_id").join(limits, "limit_name").select(
        "limit_name", "doc_id", "start", "end", "_length", (F.col("tokens") > F.col("max_tokens")).alias("_large"),
        (F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) != F.col("piece")).alias("_altered"),
    )
    before = F.max("end").over(Window.partitionBy("limit_name", "doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    told = cut.withColumn("_gap", F.col("start") > F.coalesce(before, F.lit(0)))
    by_text = told.groupBy("limit_name", "doc_id").agg(
        F.count_if("_large").alias("too_large"), F.count_if("_altered").alias("altered"), F.count_if("_gap").alias("gaps"), (F.max("end") != F.max("_length")).cast("int").alias("open_ends")
    )
    long = _for_each_limit(sized_documents(spark, folder), limits).where("tokens > max_tokens")
    whole = long.join(pieces.select("limit_name", "doc_id").distinct(), ["limit_name", "doc_id"], "left_anti").groupBy("limit_name").agg(F.count(F.lit(1)).alias("left_whole"))
    sums = by_text.groupBy("limit_name").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("too_large", "altered", "gaps", "open_ends")])
    return limits.select("limit_name").join(sums, "limit_name", "left").join(whole, "limit_name", "left").na.fill(0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_records, p5_found, p5_entities, p6_found, p6_buildings, p7_containers, p7_fill, p7_check, p8_collection, p8_shares, p8_check, p9_pieces, p9_check)}

_FOLD = r"regexp_replace(lower(coalesce({c}, '')), '[\s\x1c-\x1f\x{{85}}\pZ\pP\pS]+', '', 'g')"
_TEXTS = [
    "cot_theme_id", "cot_theme_sub_id", "thm_theme_name", "thm_theme_type", "cot_conts_id", "cot_conts_name", "cot_kw",
    "cot_conts_lan_type", "cot_conts_stat", "cot_coord_type", "thm_coord_type", "cot_coord_data", "cot_addr_full_new",
    "cot_addr_full_old", "cot_extra_name", "cot_gu_name", "cot_dong_name", "cot_master_no", "cot_slave_no", "cot_san_name",
    "cot_nation_base_area", "cot_nation_point_number", "cot_tel_no", "cot_img_main_url", "cot_extra_data_01", "cot_line_color",
    "cot_line_pattern", "cot_line_weight", "cot_reg_date", "cot_update_date",
]
_NUMBERS = ["cot_coord_x", "cot_coord_y", "cot_mbr_min_x", "cot_mbr_min_y", "cot_mbr_max_x", "cot_mbr_max_y"]
_P4 = f"""WITH keyed AS (
  SELECT row_id, run_tag, {', '.join(f'{_FOLD.format(c=c)} AS {c}' for c in _TEXTS)}, {', '.join(_NUMBERS)},
    list_sort([[{_FOLD.format(c='cot_name_01')}, {_FOLD.format(c='cot_value_01')}], [{_FOLD.format(c='cot_name_03')}, {_FOLD.format(c='cot_value_03')}]]) AS details
  FROM snapshots),
grouped AS (
  SELECT row_id, min(row_id) OVER w AS low, count(*) OVER w AS copies FROM keyed
  WINDOW w AS (PARTITION BY run_tag, {', '.join(_TEXTS + _NUMBERS)}, details))"""

ORACLE: dict[str, str] = {
    "p4_found": f"{_P4} SELECT low AS row_id_a, row_id AS row_id_b FROM grouped WHERE row_id <> low",
    "p4_records": f"{_P4} SELECT row_id, copies FROM grouped WHERE row_id = low",
    "p7_check": """SELECT limit_name, (SELECT count(*) FROM documents) AS texts, 0::BIGINT AS missing, 0::BIGINT AS cut_wrongly, 0::BIGINT AS overfull, 0::BIGINT AS misstated
      FROM size_limits WHERE purpose = 'container'""",
    "p8_check": "SELECT source, 0::BIGINT AS too_often, 0::BIGINT AS misnumbered, 0::BIGINT AS of_another, 1::INTEGER AS share_met FROM source_targets",
    "p9_check": """SELECT limit_name, 0::BIGINT AS too_large, 0::BIGINT AS altered, 0::BIGINT AS gaps, 0::BIGINT AS open_ends, 0::BIGINT AS left_whole
      FROM size_limits WHERE purpose = 'piece'""",
}
