"""Column-level data quality profile of the loads of a table, and its shifts.

The chosen columns are unpivoted and counted per value, range-sorted by
(column, group, value), and read once in order.  Each range partition reports
prefix counts of its slice; adding the totals of the slices before it turns
them into exact distinct counts, quantiles and, for two loads, the exact
Kolmogorov-Smirnov distance between their cumulative curves.  A slice streams
through its task batch by batch, whatever the skew of a column or group, and
only one small row per batch and group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import materialize, shuffle_partitions


@dataclass(frozen=True)
class ProfiledColumn:
    """A column to profile: ``unusable`` marks broken cells, ``numeric`` columns have means."""

    name: str
    numeric: bool = False
    unusable: Column | None = None


def cells(rows: DataFrame, columns: Sequence[ProfiledColumn], *, group: str, load: str, id_column: str | None = None) -> DataFrame:
    """One row per row and column: ``column_name, _group, _load, [row_id], _text, _number, _blank, _unusable``.

    A cell is blank if null, empty or white space (NaN isn't blank).  Negative
    zero counts as zero.
    """
    def cell(column: ProfiledColumn) -> Column:
        value = F.col(column.name)
        blank = value.isNull() if column.numeric else is_blank(value)
        unusable = F.coalesce(column.unusable, F.lit(False)) if column.unusable is not None else F.lit(False)
        number = (value.cast("double") + F.lit(0.0)) if column.numeric else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if column.numeric else value.cast("string")
        return F.struct(
            F.lit(column.name).alias("column_name"),
            F.when(~blank, text).alias("_text"),
            F.when(~blank, number).alias("_number"),
            blank.alias("_blank"),
            unusable.alias("_unusable"),
        )

    ids = [F.col(id_column).alias("_id")] if id_column else []
    return rows.select(
        F.col(group).alias("_group"), F.col(load).alias("_load"), *ids, F.explode(F.array(*map(cell, columns))).alias("_cell")
    ).select("_group", "_load", *(["_id"] if id_column else []), "_cell.*")


_SLICE_SCHEMA = "_part bigint, _pair bigint, _sum double, _low double, _high double, _jump double"


def _slice_curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk one range slice in order; report each curve's total, extremes and largest step, batch by batch.

    Rows come sorted by ``_pair`` and value; ``_value`` is a hash that tells
    neighbouring values apart, ``_share`` the row's signed share of its load.  The last value of
    a batch waits for the next one, where it may go on, so no step is seen in halves.
    """
    pair, value, share = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    part, seen = 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("_part")[0].as_py()
        pair, value, share = (np.r_[held, batch.column(c).to_numpy()] for held, c in ((pair, "_pair"), (value, "_value"), (share, "_share")))
        changes = np.flatnonzero((pair[1:] != pair[:-1]) | (value[1:] != value[:-1]))
        done = changes[-1] + 1 if len(changes) else 0
        if done:
            yield _steps_of((part << 32) + seen, pair[:done], value[:done], share[:done])
            seen += 1
        pair, value, share = pair[done:][:1], value[done:][:1], share[done:].sum(keepdims=True)
    if len(pair):
        yield _steps_of((part << 32) + seen, pair, value, share)


def _steps_of(part: int, pair: np.ndarray, value: np.ndarray, share: np.ndarray) -> pa.RecordBatch:
    new_pair = np.r_[True, pair[1:] != pair[:-1]]
    steps_at = np.flatnonzero(new_pair | np.r_[True, value[1:] != value[:-1]])
    steps = np.add.reduceat(share, steps_at)
    curve_at = np.flatnonzero(new_pair[steps_at])
    running = np.cumsum(steps)
    before = np.r_[0.0, running[curve_at[1:] - 1]]
    lengths = np.diff(np.r_[curve_at, len(steps)])
    running = running - np.repeat(before, lengths)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(curve_at), part), pa.int64()),
            pa.array(pair[steps_at][curve_at], pa.int64()),
            pa.array(np.add.reduceat(steps, curve_at)),
            pa.array(np.minimum.reduceat(running, curve_at)),
            pa.array(np.maximum.reduceat(running, curve_at)),
            pa.array(np.maximum.reduceat(np.abs(steps), curve_at)),
        ],
        ["_part", "_pair", "_sum", "_low", "_high", "_jump"],
    )


def _curves(weighed: DataFrame) -> DataFrame:
    """``_pair, <value columns>, _share`` to ``_pair, ks, max_jump`` by one range sort."""
    spark = weighed.sparkSession
    sliced = (
        weighed.repartitionByRange(shuffle_partitions(spark), "_pair", "_number", "_text")
        .sortWithinPartitions("_pair", "_number", "_text")
        .select(F.spark_partition_id().alias("_part"), "_pair", F.xxhash64("_number", "_text").alias("_value"), "_share")
    )
    slices = sliced.mapInArrow(_slice_curves, _SLICE_SCHEMA)
    earlier = Window.partitionBy("_pair").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        slices.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
        .groupBy("_pair")
        .agg(
            F.max(F.greatest(F.abs(F.col("_offset") + F.col("_low")), F.abs(F.col("_offset") + F.col("_high")))).alias("ks"),
            F.max("_jump").alias("max_jump"),
        )
    )


@dataclass(frozen=True)
class Profile:
    """The tables of a profile run; see :func:`profile_loads`."""

    values: DataFrame
    loads: DataFrame
    shifts: DataFrame


_VALUE_KEYS = ("column_name", "_group", "_load", "_text", "_number", "_blank", "_unusable")


def profile_loads(
    rows: DataFrame, columns: Sequence[ProfiledColumn], loads: DataFrame, *, group: str, load: str, load_order: str
) -> Profile:
    """Profile ``columns`` per group and load and compare each usable load with the one before.

    ``loads`` lists the usable loads (``group, load, load_order``); rows of any
    load are profiled, only usable ones are compared.  Returns

    * ``values``: the distinct cells with their counts;
    * ``loads``: per column, group and load ``rows, blank, unusable, distinct_values,
      mean_usable, min_number, max_number, min_text, max_text``;
    * ``shifts``: per column and usable load whose predecessor has rows both
      loads' figures (the earlier one's prefixed ``prev_``), ``ks``, the exact
      Kolmogorov-Smirnov distance of the cumulative curves over all rows (blank
      cells form the first value), and ``max_jump``, the largest change of one
      non-blank value's share of all rows.

    Null groups or loads are profiled but not compared; NaN is the greatest
    number; an empty table gives empty results; extra columns are not read.
    """
    long = cells(rows, columns, group=group, load=load)
    values = materialize(long.groupBy(*_VALUE_KEYS).agg(F.count(F.lit(1)).alias("_n")))
    usable_number = F.when(~F.col("_unusable") & ~F.isnan("_number"), F.col("_number"))
    figures = values.groupBy("column_name", "_group", "_load").agg(
        F.sum("_n").alias("rows"),
        F.sum(F.when(F.col("_blank"), F.col("_n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("_unusable"), F.col("_n")).otherwise(0)).alias("unusable"),
        F.count(F.when(~F.col("_blank"), True)).alias("distinct_values"),
        F.try_divide(
            F.sum(usable_number * F.col("_n")), F.sum(F.when(usable_number.isNotNull(), F.col("_n")))
        ).alias("mean_usable"),
        F.min("_number").alias("min_number"),
        F.max("_number").alias("max_number"),
        F.min("_text").alias("min_text"),
        F.max("_text").alias("max_text"),
    )
    figures = materialize(figures)
    order = Window.partitionBy("_group").orderBy(load_order)
    calendar = loads.select(F.col(group).alias("_group"), F.col(load).alias("_load"), load_order).withColumn(
        "_prev", F.lag("_load").over(order)
    )
    earlier = figures.select(
        "column_name", "_group", F.col("_load").alias("_prev"), *[F.col(c).alias(f"prev_{c}") for c in figures.columns[3:]]
    )
    pairs = (
        figures.join(calendar.drop(load_order), ["_group", "_load"])
        .join(earlier, ["column_name", "_group", "_prev"])
        .withColumn("_pair", F.xxhash64("column_name", "_group", "_prev", "_load"))
    )
    # A value enters the curve of its load's pair with its share and that of the next pair with its share negated.
    sides = pairs.select("column_name", "_group", F.col("_load"), "_pair", (1.0 / F.col("rows")).alias("_unit")).unionByName(
        pairs.select("column_name", "_group", F.col("_prev").alias("_load"), "_pair", (-1.0 / F.col("prev_rows")).alias("_unit"))
    )
    weighed = values.join(sides, ["column_name", "_group", "_load"]).select(
        "_pair", "_number", "_text", (F.col("_n") * F.col("_unit")).alias("_share"), "_blank"
    )
    curves = _curves(weighed.where(~F.col("_blank")).drop("_blank"))
    shifts = pairs.join(curves, "_pair", "left").drop("_pair").withColumns(
        {"ks": F.coalesce("ks", F.lit(0.0)), "max_jump": F.coalesce("max_jump", F.lit(0.0))}
    )
    return Profile(values, figures, shifts)


def number_shown(number: Column) -> Column:
    return F.when(F.isnan(number), "NaN").when(number.isNotNull(), F.format_string("%.6f", number))


def quantiles(values: DataFrame, points: Mapping[str, float]) -> DataFrame:
    """Exact lower quantiles per column, group and load from a profile's ``values``.

    The value of ``points[name]`` is the smallest non-blank value whose count,
    together with all smaller ones, reaches that part of the non-blank rows;
    numbers are given as text with six decimals.  Columns without values have no row.
    """
    key = ["column_name", "_group", "_load"]
    sliced = materialize(
        values.where(~F.col("_blank"))
        .repartitionByRange(shuffle_partitions(values.sparkSession), *key, "_number", "_text")
        .select(*key, "_number", "_text", "_n", F.spark_partition_id().alias("_part"))
    )
    by_part = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        sliced.groupBy(*key, "_part").agg(F.sum("_n").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(by_part), F.lit(0)))
        .withColumn("_total", F.sum("_sum").over(Window.partitionBy(*key)))
        .withColumnRenamed("_part", "_p").select(*[F.col(c).alias(f"_{c}") for c in key], "_p", "_offset", "_total")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    # a window never spans slices, so it never holds more than a slice
    local = Window.partitionBy(*key, "_part").orderBy("_number", "_text").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        sliced.withColumn("_local", F.sum("_n").over(local))
        .join(totals, [F.col("_part") == F.col("_p"), *same])
        .withColumn("_upto", F.col("_offset") + F.col("_local"))
    )
    shown = F.coalesce(number_shown(F.col("_number")), F.col("_text"))
    order = F.struct(F.col("_upto"), shown.alias("_shown"))
    picks = [
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_total") * F.lit(q)), order))["_shown"].alias(name) for name, q in points.items()
    ]
    return ranked.groupBy(*key).agg(*picks)
