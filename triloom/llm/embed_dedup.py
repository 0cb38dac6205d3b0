"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, where a cosine of t is a distance of eps = sqrt(2 - 2t), and turned to the principal axes of
a bounded sample (any turn keeps distances, so the sample only steers the work). The leading coordinates name a cell of a
grid of width eps; vectors are sorted by cell and cut into blocks, which go to the shared folder. Only the blocks' boxes (over
all coordinates) are joined: two blocks meet if their boxes can come within eps. A task gets numbers of blocks and
fetches them by range reads; there the two sequences are halved again and again, skipping parts whose boxes are
too far apart. The leaves are multiplied in single precision with a margin for its error, and what may reach
the threshold is decided in double precision.

Equal vectors join as one class with a count, so copies cost nothing. A pair of blocks yields the number of links of
each vector and the least linked one, never the pairs.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, have no links and are their own
component, as are vectors of different length to each other; rows with equal ids keep their own rows; a null id
takes the smallest id of its component (null if none) and is not kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import Reader, Writer
from .runtime import arrow_schema, ddl, discard, remove, shared_path, sliced, small_batches, stored

#: Coordinates in a cell's name; vectors of a block and of a leaf.
CELL_DIMS, BLOCK, LEAF = 6, 2048, 256
#: Pairs of blocks in a task.
PAIRS = 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that squares neither overflow nor vanish."""
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, the leading first, as columns."""
    _, v = np.linalg.eigh(np.cov(sample.T, bias=True) if len(sample) > 1 else np.eye(sample.shape[1]))
    return v[:, ::-1]


def box(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return y.min(axis=0), y.max(axis=0)


def apart(a: tuple, b: tuple, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) > (eps * (1 + 1e-9) + 1e-9) ** 2


def close_pairs(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, eps: float, t: float, a: int = 0, b: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with cosine >= t, by recursive halving of both sequences; tx and ty are turned coordinates."""
    if apart(box(tx), box(ty), eps):
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        margin = max(1e-4, x.shape[1] * 2.0**-20)  # far beyond the rounding of a single-precision product
        i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(t - margin))
        close = np.einsum("ij,ij->i", x[i], y[j]) >= t
        if close.any():
            yield i[close] + a, j[close] + b
        return
    if len(x) >= len(y):
        h = len(x) // 2
        yield from close_pairs(x[:h], y, tx[:h], ty, eps, t, a, b)
        yield from close_pairs(x[h:], y, tx[h:], ty, eps, t, a + h, b)
    else:
        h = len(y) // 2
        yield from close_pairs(x, y[:h], tx, ty[:h], eps, t, a, b)
        yield from close_pairs(x, y[h:], tx, ty[h:], eps, t, a, b + h)


def least_linked(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each place the least id that links i, j lead to."""
    label = ids.copy()
    while True:
        before = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        if (label == before).all():
            return label


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, sample_rows: int = 5000) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    eps = float(np.sqrt(2 - 2 * threshold))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    given = given.withColumn("v", F.when(F.col("v").isNotNull() & sound, F.col("v")))
    classes = given.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = stored(classes.select("v", "least", "copies", F.monotonically_increasing_id().alias("cid")), "classes")
    total = classes.count()
    some = classes.sample(min(1.0, sample_rows / max(1, total)), seed=3).select("v").limit(2 * sample_rows).toArrow()["v"].to_pylist() if total else []
    turn: dict[int, np.ndarray] = {}
    for d in {len(v) for v in some}:
        turn[d] = axes(unit(np.array([v for v in some if len(v) == d])))

    def turned(u: np.ndarray) -> np.ndarray:
        return u @ turn[u.shape[1]] if u.shape[1] in turn else u

    cells = [f"c{k}" for k in range(CELL_DIMS)]
    grid_schema = arrow_schema(cid="long", copies="long", dim="int", **{c: "int" for c in cells}, y="double", raw="binary")

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat, offsets = np.asarray(column.values, dtype=np.float64), np.asarray(column.offsets)
            sizes = np.diff(offsets)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                u = unit(flat[offsets[rows][:, None] + np.arange(d)])
                y = turned(u)
                c = np.zeros((len(rows), CELL_DIMS), np.int32)
                k = min(CELL_DIMS, int(d))
                c[:, :k] = np.floor(y[:, :k] / eps)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(rows), d, np.int32)), *(pa.array(c[:, i]) for i in range(CELL_DIMS)), pa.array(np.ascontiguousarray(y[:, 0])), pa.array([x.tobytes() for x in u], pa.binary())], schema=grid_schema)

    order = ["dim", *cells, "y", "cid"]
    ordered = classes.select("cid", "copies", "v").mapInArrow(sliced(grid), ddl(grid_schema)).repartitionByRange(*order).sortWithinPartitions(*order)
    folder = shared_path(vectors.sparkSession, "blocks")
    numbers = pa.list_(pa.float64())
    block_schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("lo", numbers), ("hi", numbers), ("n", pa.int64()), ("uri", pa.string()), ("at", pa.int64()), ("bytes", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId() << 36, None
        held: list[tuple] = []

        def put() -> pa.RecordBatch:
            nonlocal held, number, out
            out = out or Writer(folder, "block")
            u = np.frombuffer(b"".join(r[3] for r in held)).reshape(len(held), -1)
            lo, hi = box(turned(u))
            place = out.append(np.array([(r[0], r[1]) for r in held], np.int64).tobytes() + u.tobytes())
            got = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, held[0][2], lo.tolist(), hi.tolist(), len(held), out.uri, *place), block_schema, strict=True)], schema=block_schema)
            number, held = number + 1, []
            return got

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("cid", "copies", "dim", "raw")), strict=True):
                if held and (len(held) == BLOCK or held[0][2] != row[2]):
                    yield put()
                held.append(row)
        if held:
            yield put()
        if out:
            out.close()

    blocks = stored(ordered.select("cid", "copies", "dim", "raw").mapInArrow(sliced(cut), "block long, dim int, lo array<double>, hi array<double>, n long, uri string, at long, bytes long"), "block-places")
    # boxes that can come within eps share a cell of the two leading axes, if one of them is widened by eps
    cell = lambda x, i: F.floor(F.coalesce(F.get(x, F.lit(i)), F.lit(0.0)) / eps).cast("int")
    spread = lambda df, w: df.withColumn("x", F.explode(F.sequence(cell(F.col("lo"), 0) - w, cell(F.col("hi"), 0) + w))).withColumn("z", F.explode(F.sequence(cell(F.col("lo"), 1) - w, cell(F.col("hi"), 1) + w)))
    meta = blocks.select("block", "dim", "lo", "hi")
    left = spread(meta, 0)
    right = spread(meta, 1).select(F.col("block").alias("other"), "dim", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "x", "z")
    gap = F.aggregate(F.arrays_zip(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("lo2").alias("c"), F.col("hi2").alias("d")), F.lit(0.0), lambda s, r: s + F.pow(F.greatest(F.lit(0.0), r["a"] - r["d"], r["c"] - r["b"]), F.lit(2.0)))
    pairs = stored(left.join(right, ["dim", "x", "z"]).where("block <= other").where(gap <= (eps * (1 + 1e-9) + 1e-9) ** 2).select("block", "other").distinct(), "block-pairs")
    places = blocks.select("block", "dim", F.struct("n", "uri", "at", "bytes").alias("place"))
    work = pairs.join(places, "block").join(places.select(F.col("block").alias("other"), F.col("place").alias("place2")), "other")
    # so many pairs to a task, dealt evenly; those of one block lie together, so that it is fetched once for them
    tasks = max(1, min(pairs.count() // PAIRS + 1, 20_000))
    work = work.repartitionByRange(tasks, "block", "other").sortWithinPartitions("block", "other").select((F.col("block") == F.col("other")).alias("same"), "dim", "place.*", *[F.col(f"place2.{c}").alias(f"{c}2") for c in ("n", "uri", "at", "bytes")])
    found_schema = arrow_schema(cid="long", links="long", to="long")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers, last = (Reader(), Reader()), [None, None]

        def fetch(side: int, dim: int, n: int, *place) -> tuple:
            if last[side] is None or last[side][0] != place:
                data = readers[side].read(*place)
                u = np.frombuffer(data, np.float64, offset=16 * n).reshape(n, dim)
                last[side] = place, np.frombuffer(data, np.int64, 2 * n).reshape(n, 2), u, turned(u)
            return last[side][1:]

        for batch in batches:
            for same, dim, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, x, tx = fetch(0, dim, *place[:4])
                b, y, ty = fetch(1, dim, *place[4:])
                parts = [(i[i < j], j[i < j]) if same else (i, j) for i, j in close_pairs(x, y, tx, ty, eps, threshold)]
                if not sum(len(i) for i, _ in parts):
                    continue
                i, j = (np.concatenate(z) for z in zip(*parts, strict=True))
                ids, copies = np.concatenate([a[:, 0], b[:, 0]]), np.concatenate([a[:, 1], b[:, 1]])
                j = j + len(a)
                n = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
                to, some = least_linked(ids, i, j), n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(to[some])], schema=found_schema)
        for r in readers:
            r.close()

    found = stored(work.mapInArrow(sliced(join), ddl(found_schema)), "found")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("u"), F.col("to").alias("v")))
    known = classes.join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("v", "cid", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    known = stored(known, "known")
    for done in (classes, blocks, pairs, found):
        discard(done)
    remove(vectors.sparkSession, folder)
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = known.join(smallest, "root").select("v", "copies", "links", "component_id")
    out = given.join(per_class, "v", "left")
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
