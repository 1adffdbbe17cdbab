"""Profiles against brute force: counts, quantiles, exact distribution distances."""

import random
from bisect import bisect_right

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataquay.operators.profile import ProfiledColumn, _slice_curves, profile_loads, quantiles

SCHEMA = "g string, run string, t string, x double, _number double, column_name string"


def profile(spark, rows, loads):
    frame = spark.createDataFrame(rows, SCHEMA)
    columns = [ProfiledColumn("t"), ProfiledColumn("x", True, F.col("x").isNotNull() & (F.isnan("x") | (F.col("x") > 9)))]
    return profile_loads(frame, columns, spark.createDataFrame(loads, "g string, run string, n int"), group="g", load="run", load_order="n")


def key(v):
    return ((1, 0.0) if v != v else (0, v)) if isinstance(v, float) else v


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    random.seed(seed)
    rows = [
        (g, r, random.choice(["a", "b", "c", " ", "", None, "ㄱ" * 5000]), random.choice([1.0, 2.5, -1.0, 0.0, -0.0, 12.0, None, float("nan")]), 7.0, "clash")
        for g in ("p", "q") for r in ("r0", "r1", "r2") for _ in range(random.randrange(1, 60))
    ]
    loads = [(g, r, n) for g in ("p", "q") for n, r in enumerate(("r0", "r1", "r2"))]
    got = profile(spark, rows, loads)
    cells = {}
    for g, r, t, x, *_ in rows:
        cells.setdefault(("t", g, r), []).append(t if t and t.strip() else None)
        cells.setdefault(("x", g, r), []).append(None if x is None else x + 0.0)
    for row in got.loads.collect():
        have = cells[(row["column_name"], row["_group"], row["_load"])]
        filled = [v for v in have if v is not None]
        assert row["rows"] == len(have) and row["blank"] == len(have) - len(filled)
        assert row["distinct_values"] == len({"nan" if v != v else v for v in filled})
        if row["column_name"] == "x":
            good = [v for v in filled if v == v and v <= 9]
            assert row["unusable"] == len(filled) - len(good)
            assert row["mean_usable"] == (pytest.approx(sum(good) / len(good)) if good else None)
    for row in got.shifts.collect():
        a, b = (cells[(row["column_name"], row["_group"], row[c])] for c in ("_prev", "_load"))
        sides = [sorted(key(v) for v in side if v is not None) for side in (a, b)]
        points = sorted(set(sides[0]) | set(sides[1]))
        shares = [[bisect_right(s, p) / len(whole) for p in points] for s, whole in zip(sides, (a, b))]
        ks = max((abs(u - v) for u, v in zip(*shares)), default=0)
        jump = max((abs(sides[1].count(p) / len(b) - sides[0].count(p) / len(a)) for p in points), default=0)
        assert row["ks"] == pytest.approx(ks) and row["max_jump"] == pytest.approx(jump)
    for row in quantiles(got.values, {"q": 0.5}).collect():
        have = sorted((key(v) for v in cells[(row["column_name"], row["_group"], row["_load"])] if v is not None))
        want = have[-(-len(have) // 2) - 1]
        want = ("NaN" if want[0] == 1 else f"{want[1]:.6f}") if isinstance(want, tuple) else want
        assert row["q"] == want


@pytest.mark.parametrize("size", [1, 3, 50])
def test_a_slice_streams_in_batches(size):
    random.seed(3)
    rows = sorted((random.randrange(4), random.randrange(9), random.choice([0.25, -0.25, 0.5])) for _ in range(200))
    table = pa.table({"_part": pa.array([5] * 200, pa.int32()), "_pair": [r[0] for r in rows], "_value": [r[1] for r in rows], "_share": [r[2] for r in rows]})

    def curves(batches):
        found, offset = {}, {}
        for r in sorted((r for b in _slice_curves(iter(batches)) for r in b.to_pylist()), key=lambda r: r["_part"]):
            before, (low, high, jump) = offset.get(r["_pair"], 0.0), found.get(r["_pair"], (9.0, -9.0, 0.0))
            found[r["_pair"]] = min(low, before + r["_low"]), max(high, before + r["_high"]), max(jump, r["_jump"])
            offset[r["_pair"]] = before + r["_sum"]
        return found, offset

    assert curves(table.to_batches(max_chunksize=size)) == curves(table.combine_chunks().to_batches()) and curves([])[0] == {}


def test_empty_and_unlisted_loads(spark):
    empty = profile(spark, [], [])
    assert empty.loads.count() == 0 and empty.shifts.count() == 0 and quantiles(empty.values, {"q": 0.5}).count() == 0
    alone = profile(spark, [(None, None, None, None, None, None), ("p", "r9", "a", 1.0, None, None)], [("p", "r0", 0)])
    assert alone.loads.count() == 4 and alone.shifts.count() == 0
