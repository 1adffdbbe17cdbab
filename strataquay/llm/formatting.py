"""Records that are the same but for the way they are written.

A record's canonical key sets white space, punctuation, symbols, letter case
and the order of interchangeable fields aside.  Copies are grouped by key: keys
that hold many rows are found exactly by counting, and only those are salted
into a two-level aggregation; all others meet their copies in one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Unicode separators, punctuation, symbols and white-space controls.
UNWRITTEN = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}\p{P}\p{S}]+"
_FIELD, _PAIR = "\x01", "\x02"


def folded(text: Column) -> Column:
    """Lower case without white space, punctuation and symbols; null gives empty text."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNWRITTEN, "")


def canonical_key(columns: Sequence[tuple[str, str]], swappable: Sequence[Sequence[tuple[str, str]]]) -> tuple[Column, Column]:
    """128-bit key over ``(name, type)`` columns.

    ``swappable`` lists sets of column pairs that may stand in either order.
    Numbers count by value (NaN equals NaN, minus zero equals zero, null is a
    value of its own); null text counts as empty.
    """
    loose = {c for group in swappable for pair in group for c in pair}
    texts = [c for c, kind in columns if kind == "string" and c not in loose]
    numbers = [c for c, kind in columns if kind in ("double", "float")]
    others = [c for c, kind in columns if kind not in ("string", "double", "float") and c not in loose]
    # one pass over the joined text; the separator is none of the characters that are set aside
    parts: list[Column] = [folded(F.concat_ws(_FIELD, *[F.coalesce(F.col(c), F.lit("")) for c in texts]))] if texts else []
    for group in swappable:
        pairs = [folded(F.concat_ws(_PAIR, *[F.coalesce(F.col(c), F.lit("")) for c in pair])) for pair in group]
        parts.append(F.concat_ws(_FIELD, F.array_sort(F.array(*pairs))))
    for c in numbers:
        parts += [F.col(c).cast("double") + F.lit(0.0), F.col(c).isNull()]
    for c in others:
        parts += [F.col(c), F.col(c).isNull()]
    return F.xxhash64(F.lit(3), *parts), F.xxhash64(F.lit(5), *reversed(parts))


@dataclass(frozen=True)
class Copies:
    """``groups``: ``representative, copies`` of every record; ``members``: ``representative, row`` of the other copies."""

    groups: DataFrame
    members: DataFrame


def collapse_copies(
    rows: DataFrame,
    *,
    id_column: str,
    within: Sequence[str],
    content: Sequence[str],
    swappable: Sequence[Sequence[tuple[str, str]]] = (),
    hot_rows: int = 10_000,
    hot_keys: int = 10_000,
    salts: int = 64,
) -> Copies:
    """Group rows of equal ``within`` values whose ``content`` is the same but for writing.

    The representative is the smallest id.  A key is hot from ``hot_rows`` rows
    or the ``1/hot_keys`` part of the table on, whichever is more, so there are
    never more than ``hot_keys`` of them and their list may be broadcast.
    Exact copies, and rows all of whose content is null or blank, count as copies of
    each other within their group.  Null ``within`` values form a group.
    """
    kinds = dict(rows.dtypes)
    key_1, key_2 = canonical_key([(c, kinds[c]) for c in content], swappable)
    scope = [x for c in within for x in (F.col(c), F.col(c).isNull())]
    keys = materialize(
        rows.select(
            F.xxhash64(key_1, *scope).alias("_k1"), F.xxhash64(key_2, F.lit(7), *scope).alias("_k2"), F.col(id_column).alias("row")
        )
    )
    key = ["_k1", "_k2"]
    threshold = max(hot_rows, keys.count() // hot_keys)
    hot = materialize(keys.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > threshold).select(*key))
    # at most hot_keys pairs of longs: a few hundred kilobytes
    hot_rows_df = keys.join(F.broadcast(hot), key)
    cold_rows = keys.join(F.broadcast(hot), key, "left_anti")

    salted = hot_rows_df.groupBy(*key, F.pmod(F.xxhash64("row"), F.lit(salts)).alias("_salt")).agg(
        F.min("row").alias("_low"), F.count(F.lit(1)).alias("_n")
    )
    hot_groups = salted.groupBy(*key).agg(F.min("_low").alias("representative"), F.sum("_n").alias("copies"))
    hot_members = hot_rows_df.join(F.broadcast(hot_groups.select(*key, "representative")), key).select("representative", "row")

    same = Window.partitionBy(*key)
    cold = cold_rows.select("row", F.min("row").over(same).alias("representative"), F.count(F.lit(1)).over(same).alias("copies"))
    groups = cold.where("row = representative").select("representative", "copies").unionByName(hot_groups.select("representative", "copies"))
    members = cold.select("representative", "row").unionByName(hot_members).where("row <> representative")
    return Copies(groups, members)
