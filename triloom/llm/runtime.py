"""What the operators of this package share: the shared folder, Arrow batches and typed output."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that are taken from an Arrow batch at a time. Spark bounds a batch by bytes too (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is `spark.checkpoint.dir` of the session. Only where that is unset and Spark runs in one process
    (tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        # with its scheme, so that Spark, Hadoop and Arrow all mean the same file system
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file:" + tempfile.mkdtemp(prefix="triloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/triloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table that `stored` made, once all that was made from it is stored or collected."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def sliced(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = BATCH_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over slices of so many rows, which bounds the Python objects alive at once. What the task leaves free goes back to the system:
    Spark keeps its workers, and idle ones would hold it from the executor's other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS, which keeps Spark's own buffers small; a session that says how many it wants keeps its number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_ROWS))


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def arrow_schema(**kinds: str) -> pa.Schema:
    known = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "longs": pa.list_(pa.int64())}
    return pa.schema([(k, known[v]) for k, v in kinds.items()])


def ddl(schema: pa.Schema) -> str:
    """The same schema for Spark."""
    known = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"`{f.name}` {known[f.type]}" for f in schema)
