"""Connected components of a distributed graph, by alternating large and small stars.

Links first shrink inside each partition to a forest (union by smallest id). Then, until nothing changes: every node hands
its larger neighbours its smallest one (large star), and its smaller neighbours likewise (small star). Minima are
aggregated before the shuffle and joined back, so no task holds a node's whole neighbourhood. Each round is
written to the shared folder. Rounds grow with the logarithm of the longest path; if `rounds` don't do, that is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_schema, ddl, discard, stored


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Root of each node, its component's smallest id."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def contract(links: DataFrame) -> DataFrame:
    """Links u, v of each partition as stars (u the larger id, v the root); memory grows with a partition's links."""
    schema = arrow_schema(u="long", v="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = forest(p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        out = [(x, r) for x, r in roots.items() if x != r]
        for k in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[k : k + 50_000], strict=True)], schema=schema)

    return links.select("u", "v").mapInArrow(run, ddl(schema))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links u, v (longs, any order) to rows node, root: every node that has a link, with its component's smallest id."""
    links = contract(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v"))
    links = stored(links.distinct(), "links")
    state = None
    for _ in range(rounds):
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (now["n"], now["s"]) or not now["n"]:
            break
        state = (now["n"], now["s"])
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # all links now point from the larger to the smaller id
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, stored(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(links.select("v", "v").distinct())
