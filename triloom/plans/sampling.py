"""Join size and skew from samples: bifocal, but unbiased.

Dense keys (many rows in either sample) take the product of both samples' counts over the squared rate. All other keys
come from a correlated sample: keys are chosen by a hash, the same on both sides, and all their rows are counted,
so products are exact and scale by the rate alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JoinEstimate:
    rows: float
    skewness: float


def estimate_join(left: DataFrame, right: DataFrame, on: list[str], rate: float = 0.05, dense: int = 1000, seed: int = 42) -> JoinEstimate:
    """Size of the natural join and max - mean of its keys' products; only sums come to the driver."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))

    keys = [F.col(k).isNotNull() for k in on]
    for k in keys:
        left, right = left.where(k), right.where(k)
    some = counts(left.sample(rate, seed), "a").join(counts(right.sample(rate, seed + 1), "b"), on, "full").na.fill(0, ["a", "b"])
    hot = some.where((F.col("a") >= dense * rate) | (F.col("b") >= dense * rate))
    product = F.col("a") * F.col("b") / (rate * rate)
    first = hot.agg(F.sum(product).alias("s"), F.max(product).alias("m"), F.count(F.lit(1)).alias("n")).first()
    chosen = F.pmod(F.xxhash64(*on), F.lit(1_000_000)) < int(rate * 1_000_000)
    names = hot.select(*on)
    rest = counts(left.where(chosen).join(names, on, "left_anti"), "a").join(counts(right.where(chosen).join(names, on, "left_anti"), "b"), on)
    exact = F.col("a") * F.col("b")
    second = rest.agg(F.sum(exact).alias("s"), F.max(exact).alias("m"), F.count(F.lit(1)).alias("n")).first()
    rows = float(first["s"] or 0) + float(second["s"] or 0) / rate
    n = (first["n"] or 0) + (second["n"] or 0) / rate
    return JoinEstimate(rows, max(float(first["m"] or 0), float(second["m"] or 0)) - (rows / n if n else 0.0))
