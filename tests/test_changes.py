"""Snapshot changes against a brute-force version."""

import random

from strataquay.operators.changes import snapshot_changes

SCHEMA = "g string, k string, run string, a string, b double, d string, _k string, key string"


def brute(rows, loads):
    out = set()
    order = {}
    for g, run, n in loads:
        order.setdefault(g, []).append((n, run))
    norm = lambda v: "nan" if v != v else v
    for g, runs in order.items():
        runs = [r for _, r in sorted(runs)]
        for before, after in zip(runs, runs[1:]):
            state = []
            for run in (before, after):
                full, kept = {}, {}
                for rg, k, rr, a, b, d, *_ in rows:
                    if rg == g and rr == run:
                        full.setdefault(k, set()).add((a, norm(b), d))
                        kept.setdefault(k, set()).add((a, norm(b)))
                state.append((full, kept))
            (f0, k0), (f1, k1) = state
            for k in f0.keys() | f1.keys():
                if k not in f0:
                    out.add((g, k, before, after, "added"))
                elif k not in f1:
                    out.add((g, k, before, after, "removed"))
                elif f0[k] != f1[k]:
                    out.add((g, k, before, after, "dates_only" if k0[k] == k1[k] else "modified"))
    return out


def run(spark, rows, loads):
    frame = spark.createDataFrame(rows, SCHEMA)
    calendar = spark.createDataFrame(loads, "g string, run string, n int")
    got = snapshot_changes(frame, calendar, group="g", key="k", load="run", load_order="n", content=["a", "b", "d"], dates=["d"]).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_random_histories(spark):
    random.seed(3)
    runs = [f"r{n}" for n in range(6)]
    loads = [(g, r, n) for g in ("x", "y") for n, r in enumerate(runs) if (g, n) != ("y", 2)]
    rows = []
    for g in ("x", "y", None):
        for r in runs:
            for k in [None, "", "A", "a", *"bcdefgh"]:
                for _ in range(random.choice([0, 1, 1, 2])):
                    b = random.choice([1.0, float("nan"), None])
                    rows.append((g, k, r, random.choice(["", None, "v"]), b, random.choice(["1", "2"]), "clash", "clash"))
    assert run(spark, rows, loads) == brute(rows, [x for x in loads])


def test_gap_load_without_rows_and_repeats(spark):
    loads = [("x", "r0", 0), ("x", "r1", 1), ("x", "r2", 2)]
    rows = [("x", "a", "r0", "v", 1.0, "1", None, None)] * 3 + [("x", "a", "r2", "v", 1.0, "1", None, None)]
    assert run(spark, rows, loads) == {("x", "a", "r0", "r1", "removed"), ("x", "a", "r1", "r2", "added")}


def test_zero_signs_are_one_value_and_null_differs_from_empty(spark):
    loads = [("x", "r0", 0), ("x", "r1", 1)]
    rows = [("x", "z", "r0", "v", 0.0, "1", None, None), ("x", "z", "r1", "v", -0.0, "1", None, None)]
    rows += [("x", "n", "r0", None, 0.0, "1", None, None), ("x", "n", "r1", "", 0.0, "1", None, None)]
    assert run(spark, rows, loads) == {("x", "n", "r0", "r1", "modified")}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [("x", "r0", 0), ("x", "r1", 1)]) == set()


def test_one_key_holds_most_rows(spark):
    rows = [("x", "hot", r, f"v{i}", 1.0, "1", None, None) for r in ("r0", "r1") for i in range(3000)]
    rows.append(("x", "hot", "r1", "new", 1.0, "1", None, None))
    assert run(spark, rows, [("x", "r0", 0), ("x", "r1", 1)]) == {("x", "hot", "r0", "r1", "modified")}
