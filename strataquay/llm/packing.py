"""Items of varying size laid into containers of fixed capacity.

Bounded-space online packing: every partition takes its items in a fixed random
order and keeps a fixed number of open windows; an item goes into the window it
fills best, and when none has room the fullest window is closed.  The windows
still open at the end are emptied and their items packed again by ever fewer
partitions, so leftovers of all partitions finally meet; only these last ones, the
items of a bounded number of windows, are laid largest first with all windows open.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def pack_in_order(sizes: list[int], capacity: int, windows: int | None) -> tuple[list[int], list[bool]]:
    """Window of each item and, per window, whether it was closed while packing."""
    free: list[tuple[int, int]] = []  # of the open windows, fullest first
    closed: list[bool] = []
    window_of: list[int] = []
    for size in sizes:
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, window = free.pop(at)
        else:
            if windows is not None and len(free) >= windows:
                closed[free.pop(0)[1]] = True
            left, window = capacity, len(closed)
            closed.append(False)
        window_of.append(window)
        if left > size or not size:
            insort(free, (left - size, window))
        else:
            closed[window] = True
    return window_of, closed


def pack_items(
    items: DataFrame,
    *,
    id_column: str,
    size: str,
    capacity: int,
    open_windows: int = 64,
    containers_per_partition: int = 500,
    items_per_partition: int = 500_000,
    fan_in: int = 16,
) -> DataFrame:
    """``id, part, size, container, fill`` with ``fill`` the container's used capacity.

    An item is never split unless it is larger than ``capacity``; then its parts
    0, 1, ... fill whole containers but the last, which is packed like any item.
    Null or negative sizes count as zero.  Items of size zero need no room and join a full container of
    their partition (or, if it has none, its fullest one, which is closed), so that they never gather.  Ids should be unique; equal ids are told apart by nothing but
    their own rows.  Empty input gives no containers.  The result does not depend
    on how Spark divides the work.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    whole = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    parts = items.select(F.col(id_column).alias("id"), whole.alias("_whole")).select(
        "id", "_whole", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_whole") / capacity) - 1, F.lit(0)).cast("int"))).alias("part")
    )
    parts = parts.select(
        "id", "part", F.least(F.lit(capacity).cast("bigint"), F.col("_whole") - F.col("part").cast("bigint") * capacity).alias("size")
    )
    parts = materialize(parts.withColumn("_order", F.xxhash64("id", "part")))
    rows, total = parts.agg(F.count(F.lit(1)), F.sum("size")).first()
    partitions = max(1, math.ceil((total or 0) / (capacity * containers_per_partition)), math.ceil(rows / items_per_partition))

    schema = "id bigint, part int, size bigint, _order bigint, _group bigint, _window int, _closed boolean"

    def packer(last: bool):
        def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            empty = frame[frame["size"] == 0]
            frame = frame[frame["size"] > 0]
            if last:  # a bounded number of windows' items: largest first
                frame = frame.sort_values(["size", "_order", "id", "part"], ascending=[False, True, True, True])
            else:
                frame = frame.sort_values(["_order", "id", "part"])
            sizes = frame["size"].tolist()
            windows, closed = pack_in_order(sizes, capacity, None if last else open_windows)
            closed = [closed_now or last for closed_now in closed]
            if len(empty):
                if not closed:
                    closed.append(True)
                if True not in closed:
                    filled = [0] * len(closed)
                    for size, window in zip(sizes, windows, strict=True):
                        filled[window] += size
                    closed[filled.index(max(filled))] = True
                windows = windows + [closed.index(True)] * len(empty)
                frame = pd.concat([frame, empty])
            out = frame[["id", "part", "size", "_order"]].copy()
            out["_group"], out["_window"] = key[0], windows
            out["_closed"] = [closed[w] for w in windows]
            return out

        return pack

    level, todo, done = 0, parts.withColumn("_group", F.pmod("_order", F.lit(partitions))), None
    while True:
        last = partitions == 1 and level > 0
        packed = materialize(todo.groupBy("_group").applyInPandas(packer(last), schema))
        named = packed.where("_closed").select("id", "part", "size", F.concat_ws("-", F.lit(level), "_group", "_window").alias("container"))
        done = named if done is None else done.unionByName(named)
        if last:
            break
        todo = packed.where("not _closed").select("id", "part", "size", "_order", F.floor(F.col("_group") / fan_in).alias("_group"))
        partitions, level = math.ceil(partitions / fan_in), level + 1
    fills = done.groupBy("container").agg(F.sum("size").alias("fill"))
    return done.join(fills, "container").select("id", "part", "size", "container", "fill")
