import random

from strataquay.operators.components import connected_components


def test_against_union_find(spark):
    random.seed(1)
    for n, m in ((30, 20), (60, 0), (40, 120)):
        edges = [(random.randrange(n), random.randrange(n)) for _ in range(m)] or [(i, i + 1) for i in range(n - 1)]
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 1), (3, None)], "a bigint, b bigint")).collect()}
        assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
