"""Points near other points, and the region that contains a point.

Near points meet through an equi-join on grid cells no smaller than the
distance, crowded cells and places in blocks of bounded chunks; regions through an adaptive coverage of each polygon by quadtree
cells, where a cell wholly inside accepts its points at once and only points in
boundary cells are tested exactly, against the few edges of that cell's band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Cells and edges of a coverage that may be broadcast: about 60 bytes each, 30 MB at most.
BROADCAST_EDGES = 500_000
#: Mean Earth radius in metres (fixed value).
EARTH_RADIUS_M = 6_371_008.8


def great_circle_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance in metres on the sphere between two longitude/latitude points."""
    half_y = F.sin(F.radians(y2 - y1) / 2)
    half_x = F.sin(F.radians(x2 - x1) / 2)
    h = half_y * half_y + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * half_x * half_x
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def near_pairs(
    points: DataFrame,
    *,
    id_column: str,
    x: str,
    y: str,
    distance_m: float,
    differ: str | None = None,
    max_latitude: float = 60.0,
    rows_per_salt: int = 2000,
) -> DataFrame:
    """All pairs of rows at most ``distance_m`` apart: ``id_a < id_b``.

    With ``differ``, only pairs whose values in that column differ (null differs
    from any text; two nulls are equal).  Rows with a null or NaN coordinate
    have no neighbours.  Points beyond ``max_latitude`` (absolute) still pair
    correctly as long as cells there are wide enough; pass a larger bound for
    polar data.  Distances across the 180th meridian are not wrapped.

    Equal positions are joined as one location, locations meet by cells.  Both cells
    of many locations and locations of many rows are taken apart: their members are
    hashed into chunks of about ``rows_per_salt`` and every two chunks meet as a block
    of their own, so no task sees more than a chunk of either side, wherever rows crowd.
    """
    extra = [F.col(differ).alias("_differ")] if differ else []
    clean = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    rows = materialize(
        clean.select(
            F.col(id_column).alias("_id"), (F.col(x).cast("double") + 0.0).alias("_x"), (F.col(y).cast("double") + 0.0).alias("_y"), *extra
        )
    )
    height = math.degrees(distance_m / EARTH_RADIUS_M) * 1.000001
    width = height / math.cos(math.radians(max_latitude)) * 1.000001
    places = materialize(
        rows.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_cx": F.floor(F.col("_x") / width), "_cy": F.floor(F.col("_y") / height)})
    )
    # --- pairs of locations: cells by cells ------------------------------------------------
    # Each unordered pair of neighbouring cells is met once: the own cell and four forward ones.
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])

    def forward(frame: DataFrame, *kept: str) -> DataFrame:
        moved = frame.select(*kept, F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay"), F.explode(steps).alias("_s"))
        return moved.select(*kept, "_ax", "_ay", (F.col("_ax") + F.col("_s.dx")).alias("_cx"), (F.col("_ay") + F.col("_s.dy")).alias("_cy"))

    crowded = materialize(places.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_places")).where(F.col("_places") > rows_per_salt))
    many = ["_xa", "_ya", "_na", "_xb", "_yb", "_nb", "_same_cell"]
    side = lambda s: [F.col("_x").alias(f"_x{s}"), F.col("_y").alias(f"_y{s}"), F.col("_n").alias(f"_n{s}")]
    calm = places.join(crowded, ["_cx", "_cy"], "left_anti")
    same_cell = (F.col("_ax") == F.col("_cx")) & (F.col("_ay") == F.col("_cy"))
    met = (
        forward(calm.select(*side("a"), "_cx", "_cy"), "_xa", "_ya", "_na").withColumn("_same_cell", same_cell)
        .join(calm.select(*side("b"), "_cx", "_cy"), ["_cx", "_cy"]).select(*many)
    )
    if not crowded.isEmpty():
        cells = places.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_places"))
        both = (
            forward(cells.withColumnRenamed("_places", "_pa"), "_pa").join(cells.withColumnRenamed("_places", "_pb"), ["_cx", "_cy"])
            .where((F.col("_pa") > rows_per_salt) | (F.col("_pb") > rows_per_salt)).withColumn("_same_cell", same_cell)
            .select(F.struct("_ax", "_ay").alias("_ga"), F.struct("_cx", "_cy").alias("_gb"), F.col("_pa").alias("_na"), F.col("_pb").alias("_nb"), "_same_cell")
        )
        in_cell = places.select(F.struct("_cx", "_cy").alias("_g"), F.xxhash64("_x", "_y").alias("_h"), F.struct("_x", "_y", "_n").alias("_m"))
        named = in_cell.withColumn("_g", F.struct(F.col("_g._cx").alias("_ax"), F.col("_g._cy").alias("_ay")))
        blocks = _met_in_blocks(both, named, in_cell, rows_per_salt, "_same_cell")
        met = met.unionByName(
            blocks.select(
                *[F.col(f"_ma._{c}").alias(f"_{c}a") for c in "xyn"], *[F.col(f"_mb._{c}").alias(f"_{c}b") for c in "xyn"], "_same_cell"
            ).select(*many)
        )
    ordered = (F.col("_xa") < F.col("_xb")) | ((F.col("_xa") == F.col("_xb")) & (F.col("_ya") <= F.col("_yb")))
    met = met.where(~F.col("_same_cell") | ordered).where(great_circle_m(F.col("_xa"), F.col("_ya"), F.col("_xb"), F.col("_yb")) <= distance_m)
    # A location that has no neighbour and holds one row ends here.
    met = met.where((F.col("_xa") != F.col("_xb")) | (F.col("_ya") != F.col("_yb")) | (F.col("_na") > 1))
    # --- pairs of rows: locations by locations ---------------------------------------------
    fields = ["_id", "_differ"] if differ else ["_id"]
    member = lambda s: F.struct(*fields).alias(f"_m{s}")
    large = (F.col("_na") > rows_per_salt) | (F.col("_nb") > rows_per_salt)
    found = (
        met.where(~large).select("_xa", "_ya", "_xb", "_yb")
        .join(rows.select(F.col("_x").alias("_xa"), F.col("_y").alias("_ya"), member("a")), ["_xa", "_ya"])
        .join(rows.select(F.col("_x").alias("_xb"), F.col("_y").alias("_yb"), member("b")), ["_xb", "_yb"])
        .select(((F.col("_xa") == F.col("_xb")) & (F.col("_ya") == F.col("_yb"))).alias("_same_place"), "_ma", "_mb")
    )
    if not places.where(F.col("_n") > rows_per_salt).isEmpty():
        both = met.where(large).select(
            F.struct("_xa", "_ya").alias("_ga"), F.struct("_xb", "_yb").alias("_gb"), "_na", "_nb",
            ((F.col("_xa") == F.col("_xb")) & (F.col("_ya") == F.col("_yb"))).alias("_same_place"),
        )
        at = lambda s: rows.select(F.struct(F.col("_x").alias(f"_x{s}"), F.col("_y").alias(f"_y{s}")).alias("_g"), F.xxhash64("_id").alias("_h"), F.struct(*fields).alias("_m"))
        found = found.unionByName(_met_in_blocks(both, at("a"), at("b"), rows_per_salt, "_same_place").select("_same_place", "_ma", "_mb"))
    pairs = found.where(~F.col("_same_place") | (F.col("_ma._id") < F.col("_mb._id")))
    if differ:
        pairs = pairs.where(~F.col("_ma._differ").eqNullSafe(F.col("_mb._differ")))
    return pairs.select(F.least("_ma._id", "_mb._id").alias("id_a"), F.greatest("_ma._id", "_mb._id").alias("id_b"))


def _met_in_blocks(pairs: DataFrame, left: DataFrame, right: DataFrame, most: int, *kept: str) -> DataFrame:
    """``_ma, _mb`` and ``kept`` for all members of every pair of groups, chunk by chunk.

    ``pairs`` has groups ``_ga, _gb`` and their sizes ``_na, _nb``; ``left`` and ``right`` have a
    member's group ``_g``, a hash ``_h`` and its content ``_m``.
    """
    chunks = lambda n: F.ceil(F.col(n) / F.lit(most)).cast("int")
    blocks = materialize(
        pairs.select("_ga", "_gb", chunks("_na").alias("_sa"), chunks("_nb").alias("_sb"), *kept)
        .withColumn("_ka", F.explode(F.sequence(F.lit(0), F.col("_sa") - 1))).withColumn("_kb", F.explode(F.sequence(F.lit(0), F.col("_sb") - 1)))
    )

    def side(members: DataFrame, s: str) -> DataFrame:
        group, salts, chunk = f"_g{s}", f"_s{s}", f"_k{s}"
        sized = members.join(blocks.select(F.col(group).alias("_g"), F.col(salts).alias("_salts")).distinct(), "_g")
        own = sized.select(F.col("_g").alias(group), F.pmod("_h", F.col("_salts")).cast("int").alias(chunk), F.col("_m").alias(f"_m{s}"))
        return blocks.select("_ga", "_gb", "_ka", "_kb", *(kept if s == "a" else ())).join(own, [group, chunk])

    return side(left, "a").join(side(right, "b"), ["_ga", "_gb", "_ka", "_kb"])


def _touching(edges: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which edges meet the box: overlapping extents and box corners on both sides of the line."""
    ax, ay, bx, by = edges.T
    near = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
    side = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx in (x0, x1) for cy in (y0, y1)]
    return near & (np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)


def _inside(edges: np.ndarray, px: float, py: float) -> bool:
    ax, ay, bx, by = edges.T
    spans = (ay > py) != (by > py)
    if not spans.any():
        return False
    ax, ay, bx, by = ax[spans], ay[spans], bx[spans], by[spans]
    return bool((px < (bx - ax) * (py - ay) / (by - ay) + ax).sum() % 2)


def _cover(edges: np.ndarray, size: float, levels: int) -> Iterator[tuple[int, int, int, bool, list]]:
    """Quadtree cells of one polygon: level, column, row, wholly inside, edges of the cell's band."""
    low, high = edges[:, [0, 1]].min(axis=0), edges[:, [0, 1]].max(axis=0)
    todo = [
        (0, i, j, edges, edges)
        for i in range(math.floor(low[0] / size), math.floor(high[0] / size) + 1)
        for j in range(math.floor(low[1] / size), math.floor(high[1] / size) + 1)
    ]
    while todo:
        level, i, j, near, band = todo.pop()
        step = size / 2**level
        x0, y0 = i * step, j * step
        x1, y1 = x0 + step, y0 + step
        pad = step * 1e-9
        in_band = (np.minimum(band[:, 1], band[:, 3]) <= y1 + pad) & (np.maximum(band[:, 1], band[:, 3]) >= y0 - pad) & (np.maximum(band[:, 0], band[:, 2]) >= x0 - pad)
        band = band[in_band]
        near = near[_touching(near, x0 - pad, y0 - pad, x1 + pad, y1 + pad)]
        if not len(near):
            if _inside(band, (x0 + x1) / 2, (y0 + y1) / 2):
                yield level, i, j, True, []
        elif level == levels - 1:
            yield level, i, j, False, band.tolist()
        else:
            todo += [(level + 1, 2 * i + a, 2 * j + b, near, band) for a in (0, 1) for b in (0, 1)]


def polygon_coverage(regions: DataFrame, *, name: str, part: str, rings: str, size: float, levels: int) -> DataFrame:
    """``region, part, level, cell_x, cell_y, interior, edges`` for every polygon.

    Polygons are covered in parallel, one at a time; a polygon with null or
    empty rings, or rings of fewer than three points, covers nothing.
    """
    schema = "region string, part string, level int, cell_x bigint, cell_y bigint, interior boolean, edges array<array<double>>"

    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for region, piece, polygon in frame.itertuples(index=False):
                loops = [np.array([list(p) for p in ring], float) for ring in (polygon if polygon is not None else []) if ring is not None and len(ring) > 2]
                if not loops:
                    continue
                edges = np.vstack([np.hstack([loop, np.roll(loop, -1, axis=0)]) for loop in loops])
                edges = edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]
                found = [(region, piece, *cell) for cell in _cover(edges, size, levels)]
                if found:
                    yield pd.DataFrame(found, columns=["region", "part", "level", "cell_x", "cell_y", "interior", "edges"])

    chosen = regions.select(F.col(name).cast("string"), F.col(part).cast("string"), F.col(rings))
    return chosen.repartition(F.col(name), F.col(part)).mapInPandas(cover, schema)


def containing_regions(
    points: DataFrame, regions: DataFrame, *, id_column: str, x: str, y: str, name: str, part: str, rings: str, size: float = 0.08, levels: int = 5,
    broadcast_edges: int = BROADCAST_EDGES, salts: int = 16,
) -> DataFrame:
    """``id, region`` for every point and region that contains it (even-odd over all rings).

    A point in several parts of a region appears once per part; points with null
    or NaN coordinates, and points outside all regions, have no row.  Points on
    a border follow the half-open rule: lower and left edges belong inside.

    A coverage of at most ``BROADCAST_EDGES`` cells and edges is broadcast, its size having been
    counted; a larger one is joined by cells with points salted, so that the many
    points of a coarse interior cell or of a crowded place are spread over tasks.
    """
    cover = materialize(polygon_coverage(regions, name=name, part=part, rings=rings, size=size, levels=levels))
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(
        F.col(id_column).alias("id"), F.col(x).alias("_x"), F.col(y).alias("_y")
    )
    keys = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                F.floor(F.col("_x") / (size / 2**level)).alias("cell_x"),
                F.floor(F.col("_y") / (size / 2**level)).alias("cell_y"),
            )
            for level in range(levels)
        ]
    )
    placed = spots.select("*", F.explode(keys).alias("_k")).select("id", "_x", "_y", "_k.*")
    cell = ["level", "cell_x", "cell_y"]
    weight = cover.select(F.coalesce(F.sum(1 + F.greatest(F.size("edges"), F.lit(0))), F.lit(0))).first()[0]
    if weight <= broadcast_edges:
        cover = F.broadcast(cover)
    else:
        cover = cover.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        placed = placed.withColumn("_salt", F.pmod(F.xxhash64("id", "_x", "_y"), F.lit(salts)).cast("int"))
        cell = [*cell, "_salt"]
    inside = placed.join(cover.where("interior").select("region", *cell), cell).select("id", "region")
    crossings = F.aggregate(
        "edges",
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e[1] > F.col("_y")) != (e[3] > F.col("_y")))
            & (F.col("_x") < (e[2] - e[0]) * (F.col("_y") - e[1]) / F.nullif(e[3] - e[1], F.lit(0.0)) + e[0]),
            F.lit(1),
        ).otherwise(F.lit(0)),
    )
    tested = placed.join(cover.where("not interior").select("region", "edges", *cell), cell).where(crossings % 2 == 1).select("id", "region")
    return inside.unionByName(tested)
