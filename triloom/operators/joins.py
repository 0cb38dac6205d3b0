"""Natural joins: shuffled or broadcast as Spark decides, salted by hot keys where asked, products by counted sizes."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast once they are counted, and bytes that the optimizer may expect of it.
SMALL, BROADCAST_BYTES = 100_000, 64 << 20


def narrow(df: DataFrame) -> bool:
    """Whether the optimizer expects no more than BROADCAST_BYTES (few rows may hold long texts)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner", small: int = SMALL) -> DataFrame:
    """Join on all shared columns; a product if there are none."""
    on = [c for c in left.columns if c in right.columns]
    return left.join(right, on, how) if on else product(left, right, how, small)


def product(left: DataFrame, right: DataFrame, how: str = "inner", small: int = SMALL) -> DataFrame:
    """All pairs of rows; `left` keeps rows of the left if the right has none. A side that is counted to be small is broadcast, two
    large ones are paired partition by partition."""
    few = right.limit(small + 1).count()
    if few == 0 or few <= small and narrow(right):
        return left.join(F.broadcast(right), F.lit(True), how)
    # the right has rows, so a left join is a product too
    if narrow(left) and left.limit(small + 1).count() <= small:
        return F.broadcast(left).crossJoin(right)
    return left.crossJoin(right.hint("shuffle_replicate_nl"))


def compatible_join(left: DataFrame, right: DataFrame, maybe: set[str], how: str = "inner", small: int = SMALL) -> DataFrame:
    """Join where shared columns in `maybe` match anything if unbound; others join by equality.

    Rows are parted by which of those columns they have; each pair of parts is a join by equality on the columns both have.
    """
    on = [c for c in left.columns if c in right.columns]
    loose = [c for c in on if c in maybe]
    if not loose:
        return natural_join(left, right, how, small)
    masks = list(itertools.product((True, False), repeat=len(loose)))

    def part(df: DataFrame, mask: tuple) -> DataFrame:
        for c, bound in zip(loose, mask, strict=True):
            df = df.where(F.col(c).isNotNull() if bound else F.col(c).isNull())
        return df

    rest, out = [c for c in right.columns if c not in on], None
    for m in masks:
        mine = part(left, m)
        lonely = mine
        for n in masks:
            theirs = part(right, n)
            keys = [c for c in on if c not in loose or m[loose.index(c)] and n[loose.index(c)]]
            free = [c for c in on if c not in keys]
            renamed = theirs.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in free else F.col(f"`{c}`") for c in right.columns])
            got = natural_join(mine, renamed, "inner", small)
            got = got.select(*[F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if c in free else F.col(f"`{c}`") for c in left.columns], *rest)
            out = got if out is None else out.unionByName(got)
            if how == "left":
                lonely = lonely.join(theirs.select(*keys), keys, "left_anti") if keys else lonely.join(theirs.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti")
        if how == "left":
            out = out.unionByName(lonely.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in rest]))
    return out


def hot_keys(df: DataFrame, on: list[str], rate: float, dense: int, most: int) -> DataFrame:
    """The keys with the most rows in a sample, above dense * rate of them; at most `most` rows."""
    counts = df.sample(rate, 17).groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, dense * rate))
    rows = counts.orderBy(F.desc("n"), *on).limit(most).select(*on).collect()
    return df.sparkSession.createDataFrame(rows, df.select(*on).schema)


def skew_join(left: DataFrame, right: DataFrame, how: str = "inner", rate: float = 0.05, dense: int = 1000, most: int = 1000, salts: int = 32) -> DataFrame:
    """Rows of hot keys of the left are dealt to `salts` parts of their key, by a hash of the row and its partition; the right's rows of such keys are
    in each of them. Both sides are read once and shuffled once, whatever their size."""
    on = [c for c in left.columns if c in right.columns]
    if not on or how not in ("inner", "left"):
        return natural_join(left, right, how)
    hot = F.broadcast(hot_keys(left, on, rate, dense, most).withColumn("__hot", F.lit(True)))  # at most `most` rows
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    dealt = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(hot, on, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return dealt.join(spread, [*on, "__salt"], how).drop("__salt")
