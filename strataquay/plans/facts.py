"""Facts: what the rules need to know of every row, worked out once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import coordinate_status, finite, fixed, normalized_name, parse_region_address
from ..functions.text import trimmed
from ..operators.proximity import containing_regions
from ..session import materialize

# Heads of addresses in other provinces.
ELSEWHERE = tuple("부산 대구 인천 광주 대전 울산 세종 경기 강원 충청 충북 충남 전라 전북 전남 경상 경북 경남 제주".split())


@dataclass(frozen=True)
class RoleBinding:
    """Which columns of a table play which part."""

    row: str
    scope: tuple[str, ...]
    id: str
    name: str
    category: str
    x: str
    y: str
    geometry: str
    region: str
    address_new: str
    address_old: str
    phone: str
    image: str


SNAPSHOT_ROLES = RoleBinding(
    row="row_id", scope=("run_tag", "cot_theme_id"), id="cot_conts_id", name="cot_conts_name", category="cot_theme_sub_id",
    x="cot_coord_x", y="cot_coord_y", geometry="cot_coord_type", region="cot_gu_name", address_new="cot_addr_full_new",
    address_old="cot_addr_full_old", phone="cot_tel_no", image="cot_img_main_url",
)


def row_keys(rows: DataFrame, *, scope: Sequence[str], id_column: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``key``: the id's text, numbered ``id#n`` in ``order`` where it repeats within its scope.

    A null id counts as empty text.  Sizes come from partial aggregates and are joined
    back; only ids that repeat are ranked.
    """
    named = rows.withColumn("_id", F.coalesce(F.col(id_column), F.lit("")))
    keys = [*scope, "_id"]
    repeated = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("id_rows"))
    sized = named.join(repeated, keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    once = sized.where("id_rows = 1").withColumn("key", F.col("_id"))
    again = sized.where("id_rows > 1").withColumn("key", F.concat_ws("#", "_id", rank.cast("string")))
    return once.unionByName(again).drop("_id")


def build_facts(rows: DataFrame, regions: DataFrame, roles: RoleBinding, *, city: str, region_name: str, region_part: str, rings: str) -> DataFrame:
    """One row a row: scope columns, ``row_id, key, id_rows, name, norm, category, x, y, status, is_point,
    point_key, declared, located, addr_in_city, addr_gu, addr_field, phone, image``.

    ``located`` is the region that contains the coordinates (first by name where
    several do).  An address without city or district falls back to the old one;
    one that other cities share counts only where the coordinates lie in some region.
    Nulls become empty text or null facts; the result is written once.
    """
    names = sorted(r[0] for r in regions.select(region_name).where(F.col(region_name).isNotNull()).distinct().collect())  # a fixed, small table
    keyed = row_keys(rows, scope=roles.scope, id_column=roles.id, order=[roles.row])
    x, y = finite(F.col(roles.x)), finite(F.col(roles.y))
    status = coordinate_status(F.col("x"), F.col("y"))
    base = keyed.select(
        *roles.scope, F.col(roles.row).alias("row_id"), "key", "id_rows", F.coalesce(F.col(roles.id), F.lit("")).alias("conts_id"),
        trimmed(F.col(roles.name)).alias("name"), normalized_name(F.col(roles.name)).alias("norm"), trimmed(F.col(roles.category)).alias("category"),
        x.alias("x"), y.alias("y"), trimmed(F.col(roles.geometry)).isin("", "1").alias("is_point"), trimmed(F.col(roles.region)).alias("declared"),
        trimmed(F.col(roles.phone)).alias("phone"), trimmed(F.col(roles.image)).alias("image"),
        *[
            parse_region_address(F.col(c), city=city, districts=names, elsewhere=ELSEWHERE).alias(f"_{which}")
            for which, c in (("new", roles.address_new), ("old", roles.address_old))
        ],
    ).withColumn("status", status)
    base = materialize(base)
    spots = base.where("status = 'ok'").select("row_id", "x", "y")
    held = containing_regions(spots, regions, id_column="row_id", x="x", y="y", name=region_name, part=region_part, rings=rings)
    located = held.groupBy(F.col("id").alias("row_id")).agg(F.min("region").alias("located"))
    chosen = F.when(F.col("_new.in_city").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    out = base.join(located, "row_id", "left").withColumn("_area", chosen).withColumn(
        "_weak", F.col("_area.ambiguous") & F.col("located").isNull()
    )
    point = F.when(F.col("is_point") & (F.col("status") == "ok"), F.concat_ws(",", fixed(F.col("x")), fixed(F.col("y"))))
    return materialize(
        out.select(
            *roles.scope, "row_id", "key", "id_rows", "conts_id", "name", "norm", "category", "x", "y", "status", "is_point",
            point.alias("point_key"), "declared", "located",
            F.when(~F.col("_weak"), F.col("_area.in_city")).alias("addr_in_city"),
            F.when(~F.col("_weak"), F.col("_area.gu")).alias("addr_gu"),
            F.when(F.col("_new.in_city").isNotNull(), F.lit(roles.address_new)).otherwise(F.lit(roles.address_old)).alias("addr_field"),
            "phone", "image",
        )
    )


def named_regions(regions: DataFrame, region_name: str) -> DataFrame:
    return regions.select(F.col(region_name).alias("region")).where("region is not null").distinct()


def in_scope(*columns: str) -> list[Column]:
    return [F.col(c) for c in columns]
