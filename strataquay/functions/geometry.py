"""Distances between points and polygon edges on a local flat map."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.proximity import EARTH_RADIUS_M

METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180


def flat_metres(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance at the latitude of the first point."""
    east = (x2 - x1) * METRES_PER_DEGREE * F.cos(F.radians(y1))
    north = (y2 - y1) * METRES_PER_DEGREE
    return F.sqrt(east * east + north * north)


def metres_to_edge(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment; a segment of no length is its point."""
    scale = F.cos(F.radians(y)) * METRES_PER_DEGREE
    px, py = (ax - x) * scale, (ay - y) * METRES_PER_DEGREE
    dx, dy = (bx - ax) * scale, (by - ay) * METRES_PER_DEGREE
    along = F.coalesce(F.try_divide(-(px * dx + py * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ex, ey = px + t * dx, py + t * dy
    return F.sqrt(ex * ex + ey * ey)


def region_edges(regions: DataFrame, *, name: str, rings: str) -> DataFrame:
    """``region, ax, ay, bx, by``: consecutive points of every ring; null rings have none."""
    ring = regions.select(F.col(name).alias("region"), F.explode(rings).alias("ring"))
    steps = ring.where(F.size("ring") > 1).select("region", "ring", F.explode(F.sequence(F.lit(1), F.size("ring") - 1)).alias("i"))
    at = lambda k, d: F.element_at(F.element_at("ring", F.col("i") + k), d)
    return steps.select("region", at(0, 1).alias("ax"), at(0, 2).alias("ay"), at(1, 1).alias("bx"), at(1, 2).alias("by"))


def near_edges(points: DataFrame, edges: DataFrame, *, id_column: str, x: str, y: str, metres: float, max_latitude: float = 60.0) -> DataFrame:
    """``id`` of the points at most ``metres`` from some edge of ``edges`` (``ax, ay, bx, by``), each once.

    Points and edges meet in grid cells ten times as wide as the distance; an edge belongs to the cells along it,
    step by step, so long edges don't fill their whole extent.  Points with null or NaN coordinates are near nothing.
    """
    pad_y = metres / METRES_PER_DEGREE * 1.000001
    pad_x = pad_y / math.cos(math.radians(max_latitude)) * 1.000001
    wide, high = 10 * pad_x, 10 * pad_y
    steps = F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")) / wide, F.abs(F.col("by") - F.col("ay")) / high, F.lit(1.0))).cast("int")
    along = edges.withColumn("_n", steps).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    first, last = F.col("_k"), F.col("_k") + 1

    def cells(a: str, b: str, pad: float, size: float) -> Column:
        ends = at(a, b, first), at(a, b, last)
        return F.sequence(F.floor((F.least(*ends) - pad) / size), F.floor((F.greatest(*ends) + pad) / size))

    placed = (
        along.withColumn("_cx", F.explode(cells("ax", "bx", pad_x, wide))).withColumn("_cy", F.explode(cells("ay", "by", pad_y, high)))
        .select("ax", "ay", "bx", "by", "_cx", "_cy").distinct()
    )
    spots = points.select(F.col(id_column).alias("id"), F.col(x).alias("_x"), F.col(y).alias("_y")).where("not isnan(_x) and not isnan(_y)")
    met = spots.withColumns({"_cx": F.floor(F.col("_x") / wide), "_cy": F.floor(F.col("_y") / high)}).join(placed, ["_cx", "_cy"])
    far = metres_to_edge(F.col("_x"), F.col("_y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return met.where(far <= metres).select("id").distinct()


def edge_lists(regions: DataFrame, *, name: str, rings: str) -> DataFrame:
    """``region, edges``: each region's edges in one array, for joins by name."""
    edges = region_edges(regions, name=name, rings=rings)
    return edges.groupBy("region").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))


def metres_to_edges(x: Column, y: Column, edges: Column) -> Column:
    """Smallest distance to any edge of an array; infinite for no edges."""
    return F.aggregate(
        F.coalesce(edges, F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")),
        F.lit(float("inf")),
        lambda best, e: F.least(best, metres_to_edge(x, y, e["ax"], e["ay"], e["bx"], e["by"])),
    )
