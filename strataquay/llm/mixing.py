"""Records of several sources mixed to target shares of the total size.

Poisson replication: each record's number of copies is the inverse of a Poisson
distribution, cut off at the source's cap, at a uniform number hashed from the
record's id and a seed.  The distribution's parameter is calibrated on the sizes
really drawn, which only grow with it, so that the shares come out as asked although
sizes vary widely: one histogram of sizes over the uniform numbers brackets every
source's parameter, and only the few records whose copies are still open are
looked at once more.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions


@dataclass(frozen=True)
class Mixture:
    """``drawn``: the copies in random order; ``shares``: what each source was asked for and gave."""

    drawn: DataFrame
    shares: DataFrame


def copy_steps(rate: float, cap: int) -> list[float]:
    """Where the number of copies rises: a record at ``u`` has as many copies as there are steps below ``u``.

    The steps are the Poisson distribution with parameter ``rate`` given at most ``cap``, up to
    ``cap - 1``.  Weights are kept as logarithms, so neither large rates nor large caps overflow.
    """
    if cap <= 0:
        return []
    if rate <= 0:
        return [1.0] * cap
    if math.isinf(rate):
        return [0.0] * cap
    logs = [k * math.log(rate) - math.lgamma(k + 1) for k in range(cap + 1)]
    top = max(logs)
    upto = list(accumulate(math.exp(w - top) for w in logs))
    return [min(1.0, w / upto[-1]) for w in upto[:-1]]


def _bracket(goal: float, cap: int, tails: list[int], bins: int) -> tuple[float, float]:
    """Rates that surely draw at most, and surely at least, ``goal``; ``tails[b]`` is the size from bin ``b`` on."""
    sure = lambda rate: sum(tails[min(bins, math.floor(t * bins) + 1)] for t in copy_steps(rate, cap))
    possible = lambda rate: sum(tails[min(bins, math.floor(t * bins))] for t in copy_steps(rate, cap))

    def turn(rises) -> tuple[float, float]:
        low, high = -40.0, 60.0 + math.log1p(cap)  # logarithms of rates without any and with full replication
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if rises(math.exp(middle)) else (middle, high)
        return low, high

    return math.exp(turn(lambda r: possible(r) > goal)[0]), math.exp(turn(lambda r: sure(r) >= goal)[1])


def mix_sources(
    records: DataFrame,
    targets: DataFrame,
    *,
    id_column: str,
    source: str,
    size: str,
    share: str,
    cap: str,
    total_size: int | None = None,
    seed: int = 42,
    bins: int = 1024,
    grid: int = 64,
    rounds: int = 2,
) -> Mixture:
    """Draw copies so that each source has its share of the total size.

    ``targets`` has one row a source with ``share`` and ``cap`` (copies of one
    record at most; its whole part counts); it is a small table.  Without ``total_size`` the largest
    total is taken that every source can fill within its cap.  Records of size
    zero or null, with a null source or one without target are not drawn; a target without
    records has an actual share of zero and doesn't bound the total.  Sources keep the given
    share exactly up to the size of single records.  Equal ids draw equal numbers
    of copies.
    """
    wanted = targets.select(
        F.col(source).alias("source"), F.col(share).cast("double").alias("target_share"), F.floor(F.col(cap)).cast("int").alias("cap"),
        F.col(cap).cast("double").alias("max_repeats"),
    ).where("source is not null")
    own = records.select(F.col(id_column).alias("id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size")).where("size > 0")
    own = materialize(
        own.join(wanted.select("source"), "source", "left_semi")
        .withColumn("uniform", (F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(1 << 40)) + 0.5) / float(1 << 40))
    )
    spark = records.sparkSession
    # --- one histogram a source: at most ``bins`` rows each come to the driver -------------
    plan = {r["source"]: r for r in wanted.collect()}
    held: dict[str, list[int]] = {}
    number: dict[str, int] = {}
    for r in own.groupBy("source", F.floor(F.col("uniform") * bins).cast("int").alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        held.setdefault(r["source"], [0] * (bins + 1))[r["bin"]] = r["size"]
        number[r["source"]] = number.get(r["source"], 0) + r["n"]
    tails = {s: list(accumulate(reversed(h)))[::-1] for s, h in held.items()}
    available = {s: t[0] for s, t in tails.items()}
    bounds = [max(0, plan[s]["cap"] or 0) * n / plan[s]["target_share"] for s, n in available.items() if (plan[s]["target_share"] or 0) > 0]
    total = float(min(bounds, default=0.0) if total_size is None else total_size)
    # --- bracket each source's rate; where it can't reach its goal it is filled to the cap -
    chosen: dict[str, float] = {}
    span: dict[str, tuple[float, float]] = {}
    caps = {s: max(0, plan[s]["cap"] or 0) for s in available}
    goals = {s: total * (plan[s]["target_share"] or 0.0) for s in available}
    for s, n in available.items():
        if goals[s] <= 0 or not caps[s]:
            chosen[s] = 0.0
        elif goals[s] >= caps[s] * n:
            chosen[s] = math.inf
        else:
            span[s] = _bracket(goals[s], caps[s], tails[s], bins)
    opened = {
        s: sorted(
            {
                b
                for t, u in zip(copy_steps(high, caps[s]), copy_steps(low, caps[s]), strict=True)
                for b in range(math.floor(t * bins), min(bins - 1, math.floor(u * bins)) + 1)
            }
        )
        for s, (low, high) in span.items()
    }
    count_at = lambda steps: F.size(F.filter(steps, lambda t: t < F.col("uniform")))
    nearest: dict[str, tuple[float, float]] = {}  # smallest miss so far and its rate
    for _ in range(rounds if span else 0):
        tried = {}
        for s, (low, high) in span.items():
            half = grid // 2
            tried[s] = sorted({low + (high - low) * k / (half - 1) for k in range(half)} | {low * (high / low) ** (k / (half - 1)) for k in range(half)})
        # up to grid rows a target, each with as many steps as its cap
        ladders = spark.createDataFrame(
            [(s, [copy_steps(r, caps[s]) for r in rates], opened[s]) for s, rates in tried.items()], "source string, ladders array<array<double>>, opened array<int>"
        )
        loose = own.join(F.broadcast(ladders), "source").where(F.array_contains("opened", F.floor(F.col("uniform") * bins).cast("int")))
        scored = loose.select("source", "size", "uniform", F.posexplode("ladders").alias("k", "steps"))
        drawn_at: dict[str, dict[int, int]] = {}
        for r in scored.groupBy("source", "k").agg(F.sum(count_at(F.col("steps")) * F.col("size")).alias("drawn")).collect():
            drawn_at.setdefault(r["source"], {})[r["k"]] = r["drawn"]
        for s, rates in tried.items():
            shut = set(opened[s])
            # in the other bins no step falls at any of these rates: all records of a bin have the same copies
            steps = copy_steps(rates[0], caps[s])
            sure = sum(n * bisect_left(steps, (b + 0.5) / bins) for b, n in enumerate(held[s][:bins]) if n and b not in shut)
            low, high = span[s]
            for k, rate in enumerate(rates):
                got = sure + drawn_at.get(s, {}).get(k, 0)
                nearest[s] = min(nearest.get(s, (math.inf, 0.0)), (abs(got - goals[s]), rate))
                low, high = (max(low, rate), high) if got <= goals[s] else (low, min(high, rate))
            span[s] = (low, max(low, high))
    chosen |= {s: rate for s, (_, rate) in nearest.items()}
    rows = [(s, caps[s], copy_steps(rate, caps[s])) for s, rate in chosen.items()]
    # the list holds one row a target
    steps = F.broadcast(spark.createDataFrame(rows, "source string, cap int, steps array<double>"))
    counted = own.join(steps, "source").withColumn("copies", F.least(count_at(F.col("steps")), F.col("cap")))
    drawn = counted.where("copies > 0").select("id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    shuffled = (
        drawn.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), F.col("id").cast("string"), "copy"))
        .repartitionByRange(shuffle_partitions(spark), "shuffle_key")
        .sortWithinPartitions("shuffle_key", "id", "copy")
    )
    by_source = counted.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("drawn_size"), F.sum("copies").alias("drawn_records"), F.max("copies").alias("most_copies")
    )
    stock = spark.createDataFrame([(s, n) for s, n in available.items()], "source string, available bigint")
    shares = (
        wanted.join(stock, "source", "left").join(by_source, "source", "left")
        .withColumn("_all", F.sum("drawn_size").over(Window.partitionBy()))  # one row a target
        .select(
            "source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available_size"),
            F.coalesce("drawn_records", F.lit(0)).alias("drawn_records"), F.coalesce("drawn_size", F.lit(0)).alias("drawn_size"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce(F.try_divide(F.col("drawn_size"), F.col("_all")), F.lit(0.0)).alias("actual_share"),
        )
    )
    return Mixture(shuffled, shares)
