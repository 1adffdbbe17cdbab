"""Near points and containing regions against brute force."""

import math
import random

import pytest

from strataquay.functions.geometry import METRES_PER_DEGREE, near_edges
from strataquay.operators.proximity import containing_regions, near_pairs

R = 6_371_008.8


def metres(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(h))


def near(spark, rows, **more):
    frame = spark.createDataFrame(rows, "id bigint, name string, x double, y double, _x double, _n int")
    return {tuple(r) for r in near_pairs(frame, id_column="id", x="x", y="y", distance_m=10, differ="name", **more).collect()}


def brute(rows):
    ok = [r for r in rows if r[2] is not None and r[3] is not None and r[2] == r[2] and r[3] == r[3]]
    return {
        (min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(ok) for b in ok[i + 1 :] if a[1] != b[1] and metres(a[2:4], b[2:4]) <= 10
    }


def test_near_pairs(spark):
    random.seed(5)
    rows = [(i, random.choice(["a", "b", None]), 127 + random.random() * 1e-3, random.choice([37.0, 0.0, -37.0]) + random.random() * 1e-3, 0.0, 0) for i in range(300)]
    rows += [(1000 + i, str(i), 127.0001, 37.0001, 0.0, 0) for i in range(30)]
    rows += [(2000, "n", None, 37.0, 0.0, 0), (2001, "n", float("nan"), 37.0, 0.0, 0), (2002, "z", 0.0, 0.0, 0.0, 0), (2003, "y", -0.0, 0.0, 0.0, 0)]
    assert near(spark, rows, rows_per_salt=4) == brute(rows)


@pytest.mark.parametrize("salt", [2, 7, 1000])
def test_near_pairs_of_one_crowded_place(spark, salt):
    """A third of all rows at one position and a third in one cell: chunks of every size give all pairs once."""
    random.seed(6)
    rows = [(i, random.choice(["a", "b"]), 127.0, 37.0, 0.0, 0) for i in range(60)]
    rows += [(100 + i, random.choice(["a", "b", None]), 127.00005 + random.random() * 2e-5, 37.0 + random.random() * 2e-5, 0.0, 0) for i in range(60)]
    rows += [(200 + i, random.choice(["a", "b"]), 127 + random.random() * 1e-3, 37 + random.random() * 1e-3, 0.0, 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "id bigint, name string, x double, y double, _x double, _n int")
    got = [tuple(r) for r in near_pairs(frame, id_column="id", x="x", y="y", distance_m=10, differ="name", rows_per_salt=salt).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_near_edges(spark):
    random.seed(9)
    edges = [(127 + random.random(), 37 + random.random(), 127 + random.random(), 37 + random.random()) for _ in range(12)] + [(127.5, 37.5, 127.5, 37.5)]
    points = [(i, 127 + random.random(), 37 + random.random()) for i in range(400)] + [(900, None, 37.0), (901, float("nan"), 37.0), (902, 127.5, 37.5)]

    def apart(x, y, e):
        k = METRES_PER_DEGREE * math.cos(math.radians(y))
        (px, py), (dx, dy) = ((e[0] - x) * k, (e[1] - y) * METRES_PER_DEGREE), ((e[2] - e[0]) * k, (e[3] - e[1]) * METRES_PER_DEGREE)
        t = max(0.0, min(1.0, -(px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(px + t * dx, py + t * dy)

    want = {i for i, x, y in points if x is not None and x == x and any(apart(x, y, e) <= 1500 for e in edges)}
    frame, lines = spark.createDataFrame(points, "id bigint, x double, y double"), spark.createDataFrame(edges, "ax double, ay double, bx double, by double")
    call = lambda f, l: [r.id for r in near_edges(f, l, id_column="id", x="x", y="y", metres=1500).collect()]
    got = call(frame, lines)
    assert len(got) == len(set(got)) and set(got) == want and want and call(frame.limit(0), lines) == call(frame, lines.limit(0)) == []


def test_near_pairs_empty(spark):
    assert near(spark, []) == set()


def inside(point, rings):
    x, y = point
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def ring(cx, cy, r, n, wobble=0.4):
    points = [[cx + r * (1 + wobble * random.random()) * math.cos(2 * math.pi * k / n), cy + r * (1 + wobble * random.random()) * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return [*points, points[0]]


def test_containing_regions(spark):
    random.seed(8)
    regions = [("a", 1, [ring(127, 37, 0.2, 40), ring(127, 37, 0.05, 8)]), ("a", 2, [ring(128, 37, 0.01, 5)]), ("b", 1, [ring(127.6, 37, 0.15, 400)]), ("none", 1, None), ("flat", 1, [[[1.0, 1.0], [1.0, 1.0]]])]
    points = [(i, 126.6 + random.random() * 1.6, 36.6 + random.random() * 0.8) for i in range(1500)] + [(9001, None, 37.0), (9002, float("nan"), 37.0)]
    frame = spark.createDataFrame(points, "id bigint, x double, y double")
    areas = spark.createDataFrame(regions, "name string, part int, rings array<array<array<double>>>")
    got = {tuple(r) for r in containing_regions(frame, areas, id_column="id", x="x", y="y", name="name", part="part", rings="rings").collect()}
    want = {(i, n) for i, x, y in points if x is not None and x == x for n, _, rs in regions if rs and inside((x, y), rs)}
    assert got == want
    salted = containing_regions(frame, areas, id_column="id", x="x", y="y", name="name", part="part", rings="rings", broadcast_edges=0, salts=3)
    assert {tuple(r) for r in salted.collect()} == want
    none = containing_regions(frame.limit(0), areas, id_column="id", x="x", y="y", name="name", part="part", rings="rings")
    assert none.count() == 0
    assert containing_regions(frame, areas.limit(0), id_column="id", x="x", y="y", name="name", part="part", rings="rings").count() == 0
