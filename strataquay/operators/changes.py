"""What changed between consecutive full snapshots of a table.

Every key of every load is reduced to a fingerprint of its *set* of distinct
contents; a window over the load index then finds changed fingerprints (lag)
and gaps in the index (removals and later additions).  Only fixed-width hashes
are shuffled, so the cost does not depend on the width of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BITS_PER_MASK = 60


def content_hash(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row's values.

    Null differs from empty text (a bit mask of the nulls is hashed too), NaN
    equals NaN, and the second hash chains the columns in reverse order so the
    pair acts as one 128-bit value.  No columns give constant hashes.
    """
    masks = []
    for start in range(0, len(columns), _BITS_PER_MASK):
        bits = [
            F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            for i, c in enumerate(columns[start : start + _BITS_PER_MASK])
        ]
        total = bits[0]
        for bit in bits[1:]:
            total = total + bit
        masks.append(total)
    values = [F.col(c) for c in columns]
    return F.xxhash64(F.lit(17), *masks, *values), F.xxhash64(F.lit(29), *reversed(values), *masks)


def snapshot_changes(
    rows: DataFrame,
    loads: DataFrame,
    *,
    group: str,
    key: str,
    load: str,
    load_order: str,
    content: Sequence[str],
    dates: Sequence[str] = (),
) -> DataFrame:
    """Added, removed, modified and dates-only keys of each load against the one before.

    ``loads`` lists the usable loads (``group``, ``load``, ``load_order``); a
    load's predecessor is the usable load before it in its group, and rows of
    other loads, or with a null group or load, are ignored.  A key stands for
    the set of its distinct contents, so repeated delivery changes nothing.  A
    null key is a key of its own.  ``dates`` are the content columns whose
    change alone counts as ``dates_only``.  A load without rows removes every
    key of its predecessor.  Empty inputs give an empty result; columns of
    ``rows`` outside the named ones are not read.

    Returns ``group, key, prev_<load>, <load>, change_kind``; one row a case.
    """
    lasting = [c for c in content if c not in set(dates)]
    in_group = Window.partitionBy("_g").orderBy("_order")
    calendar = (
        loads.select(F.col(group).alias("_g"), F.col(load).alias("_load"), F.col(load_order).alias("_order"))
        .withColumn("_seq", F.row_number().over(in_group))
        .withColumn("_prev", F.lag("_load").over(in_group))
        .withColumn("_next", F.lead("_load").over(in_group))
        .drop("_order")
    )
    all_1, all_2 = content_hash(content)
    kept_1, kept_2 = content_hash(lasting)
    hashed = rows.select(
        F.col(group).alias("_g"),
        F.col(key).alias("_k"),
        F.col(load).alias("_load"),
        kept_1.alias("_d1"),
        kept_2.alias("_d2"),
        all_1.alias("_h1"),
        all_2.alias("_h2"),
    )
    placed = hashed.join(calendar.select("_g", "_load", "_seq"), ["_g", "_load"]).drop("_load")
    # Distinct contents first, then their exclusive-or: an order-free fingerprint of a
    # set that is built from partial aggregates only, however many contents a key has.
    contents = placed.select("_g", "_k", "_seq", "_d1", "_d2", "_h1", "_h2").distinct()
    by_lasting = contents.groupBy("_g", "_k", "_seq", "_d1", "_d2").agg(
        F.bit_xor("_h1").alias("_h1"), F.bit_xor("_h2").alias("_h2"), F.count(F.lit(1)).alias("_n")
    )
    sets = by_lasting.groupBy("_g", "_k", "_seq").agg(
        F.struct(F.bit_xor("_h1"), F.bit_xor("_h2"), F.sum("_n")).alias("_all"),
        F.struct(F.bit_xor("_d1"), F.bit_xor("_d2"), F.count(F.lit(1))).alias("_kept"),
    )
    # One row per load and key is left: a key's window is no longer than the list of loads.
    history = Window.partitionBy("_g", "_k").orderBy("_seq")
    seen = sets.join(calendar, ["_g", "_seq"]).select(
        "*",
        F.lag("_seq").over(history).alias("_seq_before"),
        F.lag("_all").over(history).alias("_all_before"),
        F.lag("_kept").over(history).alias("_kept_before"),
        F.lead("_seq").over(history).alias("_seq_after"),
    )

    def case(kind: Column, before: str, after: str) -> Column:
        return F.struct(F.col(before).alias("before"), F.col(after).alias("after"), kind.alias("kind"))

    came = (F.col("_seq") > 1) & (F.col("_seq_before").isNull() | (F.col("_seq_before") < F.col("_seq") - 1))
    changed = (F.col("_seq_before") == F.col("_seq") - 1) & (F.col("_all") != F.col("_all_before"))
    went = F.col("_next").isNotNull() & (F.col("_seq_after").isNull() | (F.col("_seq_after") > F.col("_seq") + 1))
    kind = F.when(F.col("_kept") == F.col("_kept_before"), F.lit("dates_only")).otherwise(F.lit("modified"))
    cases = F.array(
        F.when(came, case(F.lit("added"), "_prev", "_load")),
        F.when(changed, case(kind, "_prev", "_load")),
        F.when(went, case(F.lit("removed"), "_load", "_next")),
    )
    return (
        seen.select("_g", "_k", F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("_c"))
        .select(
            F.col("_g").alias(group),
            F.col("_k").alias(key),
            F.col("_c.before").alias(f"prev_{load}"),
            F.col("_c.after").alias(load),
            F.col("_c.kind").alias("change_kind"),
        )
    )
