"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (two bigint columns ``a, b``).

    A component's label is its smallest node.  Alternating star contraction:
    every node first points its larger neighbours at its smallest one, then
    its smaller neighbours; the number of rounds grows with the logarithm of
    the longest path, and hubs shrink by partial aggregation.  Each round is written to
    the shared folder.  Nulls and loops are ignored; no edges give no rows.
    """
    pair = [F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")]
    current = materialize(edges.select(*pair).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # settled once every node that points somewhere points to one node that itself points nowhere
        ends = current.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("hit")).unionByName(
            current.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("hit"))
        )
        loose = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("hit").alias("hit")).where("out > 1 or (out = 1 and hit = 1)")
        if loose.isEmpty():
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # both sides grow with the edges: never broadcast
        # large star: greater neighbours of a move to the smallest of a's surroundings
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        current = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
