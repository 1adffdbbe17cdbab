"""Differences between two states of a table, and between two sets of findings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changes import content_hash


def canonical_text(column: str, kind: str) -> Column:
    """A value as text that is the same in every engine; null keeps a mark of its own.

    Numbers have nine decimals, from 100,000 on four.
    """
    value = F.col(column)
    if kind in ("double", "float"):
        small, large = F.format_string("%.9f", value + 0.0), F.format_string("%.4f", value + 0.0)
        text = F.when(F.isnan(value), "NaN").when(F.abs(value) < 1e5, small).when(value.isNotNull(), large)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("\x00"))


def snapshot_hashes(rows: DataFrame, *, scope: Sequence[str], columns: Sequence[str], buckets: int = 4096) -> DataFrame:
    """``scope, rows, content_hash``: a hash of each scope's rows that their order doesn't change.

    Row hashes are ordered and hashed within buckets of the hash's first digits, then
    the buckets' hashes are; a bucket holds the 1/``buckets`` part of a scope.  The column
    names belong to the hash; null differs from empty text, repeated rows count.
    """
    kinds = dict(rows.dtypes)
    digits = max(1, (buckets - 1).bit_length() // 4)
    ordered = sorted(columns)
    row_hash = F.sha2(F.concat_ws("\x1f", *[canonical_text(c, kinds[c]) for c in ordered]), 256)
    hashed = rows.select(*scope, row_hash.alias("_h"))
    # every bucket is a group of its own: no task sees a whole scope
    parts = hashed.groupBy(*scope, F.substring("_h", 1, digits).alias("_bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ","), 256).alias("_part"), F.count(F.lit(1)).alias("_n")
    )
    header = ",".join(ordered)
    return parts.groupBy(*scope).agg(
        F.sum("_n").alias("rows"),
        F.sha2(
            F.concat(F.lit(header), F.lit(";"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_part"))), lambda p: F.concat(p["_bucket"], F.lit(":"), p["_part"])), ",")),
            256,
        ).alias("content_hash"),
    )


def stored_hashes(rows: DataFrame, *, scope: Sequence[str], columns: Sequence[str], id_column: str) -> DataFrame:
    """``scope, rows, stored_hash``: sha256 of a scope's rows as one JSON text, header included.

    The text is ``{"columns":[...],"rows":[[...],...]}`` with columns by name and rows by id, then by their JSON; null stands for
    missing values.  Sorted rows stream through the hash, so a task never holds a scope; yet one scope is
    read by one task, as the hash of one text must be: use :func:`snapshot_hashes` where no stored hash has to be met.
    Values are written as Spark's JSON does; only texts and whole numbers are the same in other writers.
    """
    named = sorted(columns)
    head = json.dumps({"columns": named}, ensure_ascii=False, separators=(",", ":"))[:-1] + ',"rows":['
    cells = [F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in named]
    line = F.concat(F.lit("["), F.concat_ws(",", *[F.substring(c, F.lit(6), F.length(c) - 6) for c in cells]), F.lit("]"))
    keys = [f"_k{n}" for n in range(len(scope))]
    listed = rows.select(*[F.col(c).cast("string").alias(k) for c, k in zip(scope, keys, strict=True)], F.coalesce(F.col(id_column), F.lit("")).alias("_id"), line.alias("_line"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, n, out = None, None, 0, []
        for frame in frames:
            for *key, text in frame[[*keys, "_line"]].itertuples(index=False, name=None):
                key = tuple(None if k is None or k != k else k for k in key)
                if state is None or key != current:
                    if state is not None:
                        out.append((*current, n, state))
                    current, state, n = key, hashlib.sha256(head.encode()), 0
                if n:
                    state.update(b",")
                state.update(text.encode())
                n += 1
        if state is not None:
            out.append((*current, n, state))
        for *_, state in out:
            state.update(b"]}")
        yield pd.DataFrame([(*key, n, state.hexdigest()) for *key, n, state in out], columns=[*scope, "rows", "stored_hash"])

    schema = ", ".join(f"`{c}` string" for c in scope) + ", rows bigint, stored_hash string"
    return listed.repartition(*keys).sortWithinPartitions(*keys, "_id", "_line").mapInPandas(digest, schema)


def hashed_rows(keyed: DataFrame, *, keep: Sequence[str], columns: Sequence[str], dates: Sequence[str] = ()) -> DataFrame:
    """``keep`` and two 128-bit hashes of every row: of all ``columns``, and of those that aren't ``dates``."""
    whole, lasting = content_hash(columns), content_hash([c for c in columns if c not in dates])
    return keyed.select(*keep, F.struct(*[h.alias(f"h{n}") for n, h in enumerate(whole)]).alias("_whole"), F.struct(*[h.alias(f"h{n}") for n, h in enumerate(lasting)]).alias("_lasting"))


def key_changes(hashed: DataFrame, pairs: DataFrame, *, group: str, load: str, key: str) -> DataFrame:
    """``group, prev_<load>, <load>, key, change``: keys added, removed, modified, or with other dates only.

    ``hashed`` comes from :func:`hashed_rows`; ``pairs`` (``group, prev_<load>, <load>``) names the states to
    compare.  Only keys and fixed-width hashes meet in the join.
    """
    prev = f"prev_{load}"
    side = lambda s: [F.col("_whole").alias(f"_whole_{s}"), F.col("_lasting").alias(f"_lasting_{s}")]
    after = hashed.join(pairs, [group, load]).select(group, prev, load, key, *side("after"))
    before = hashed.withColumnRenamed(load, prev).join(pairs, [group, prev]).select(group, prev, load, key, *side("before"))
    met = after.join(before, [group, prev, load, key], "full_outer")
    change = (
        F.when(F.col("_whole_before").isNull(), "added").when(F.col("_whole_after").isNull(), "removed")
        .when(F.col("_lasting_before") == F.col("_lasting_after"), "dates_only").otherwise("modified")
    )
    return met.where(~F.col("_whole_before").eqNullSafe(F.col("_whole_after"))).select(group, prev, load, key, change.alias("change"))


def field_changes(keyed: DataFrame, changes: DataFrame, *, group: str, load: str, key: str, columns: Sequence[str]) -> DataFrame:
    """``group, prev_<load>, <load>, key, column, before, after`` for every changed field of keys that are in both states.

    Values are compared as canonical text; a null is told from empty text.  ``columns`` may be the union of both states'
    columns: one that a state lacks is null in ``keyed``.
    """
    kinds = dict(keyed.dtypes)
    prev = f"prev_{load}"
    moved = changes.where("change in ('modified', 'dates_only')").select(group, prev, load, key)
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[canonical_text(c, kinds[c]) for c in columns]))
    after = keyed.join(moved, [group, load, key]).select(group, prev, load, key, F.explode(values).alias("column", "_after"))
    before = keyed.withColumnRenamed(load, prev).join(moved, [group, prev, key]).select(group, prev, load, key, F.explode(values).alias("column", "_before"))
    plain = lambda c: F.when(F.col(c) != "\x00", F.col(c))
    return (
        after.join(before, [group, prev, load, key, "column"])
        .where("_after <> _before")
        .select(group, prev, load, key, "column", plain("_before").alias("before"), plain("_after").alias("after"))
    )


def finding_changes(before: DataFrame, after: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """``keys, fingerprint, change, severity_before, severity_after`` of two sets of findings.

    A fingerprint that occurs several times counts once, with its gravest severity.
    ``change`` is ``added``, ``resolved``, ``severity_changed`` or ``unchanged``.
    """
    # Severities in order of gravity.
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "suspect", 1).otherwise(2)

    def gravest(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*keys, "fingerprint").agg(F.min_by("severity", rank).alias(name))

    met = gravest(before, "severity_before").join(gravest(after, "severity_after"), [*keys, "fingerprint"], "full_outer")
    change = (
        F.when(F.col("severity_before").isNull(), "added")
        .when(F.col("severity_after").isNull(), "resolved")
        .when(F.col("severity_before") != F.col("severity_after"), "severity_changed")
        .otherwise("unchanged")
    )
    return met.select(*keys, "fingerprint", change.alias("change"), "severity_before", "severity_after")
