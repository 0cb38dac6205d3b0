"""Results as tab-separated text, and a record of what each query cost."""

from __future__ import annotations

import csv
import time
import uuid
from dataclasses import astuple, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One line per row, no header; null is an empty field."""
    df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).write.mode("overwrite" if overwrite else "errorifexists").option("sep", "\t").option("quote", "").option("escapeQuotes", "false").option("emptyValue", "").csv(path)


@dataclass
class Statistic:
    """What a query cost: jobs, bytes and records read and written, bytes spilled, seconds of all tasks and by the clock."""

    name: str
    expression: str
    jobs: int
    bytes_in: int
    bytes_out: int
    spilled: int
    records_in: int
    rows: int
    task_seconds: float
    seconds: float
    started: float
    sample_rate: float


class Recorder:
    """Statistics of queries, kept in memory and appended to a file if one is named."""

    def __init__(self, path: str = ""):
        self.path, self.rows = path, []

    def timed(self, name: str, expression: str, df: DataFrame, action, rate: float = 1.0) -> Statistic:
        """Run action(df) and record its time, its number of rows, counted on the way, and what its jobs read and wrote."""
        spark = df.sparkSession
        tag, seen, began = f"triloom-{uuid.uuid4().hex}", Observation(), time.time()
        spark.addTag(tag)
        try:
            action(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        finally:
            spark.removeTag(tag)
        took = time.time() - began
        self.rows.append(Statistic(name, expression, **job_metrics(spark, tag), rows=seen.get["rows"], seconds=took, started=began, sample_rate=rate))
        if self.path:
            fresh = not Path(self.path).exists()
            with open(self.path, "a", newline="") as f:
                out = csv.writer(f)
                if fresh:
                    out.writerow([x.name for x in fields(Statistic)])
                out.writerow(astuple(self.rows[-1]))
        return self.rows[-1]


def job_metrics(spark, tag: str) -> dict:
    """Sums over the stages of the jobs with a tag; zeros where the driver's status store can't be reached (a remote session)."""
    total = {"jobs": 0, "bytes_in": 0, "bytes_out": 0, "spilled": 0, "records_in": 0, "task_seconds": 0.0}
    try:
        store = spark.sparkContext._jsc.sc().statusStore()
    except Exception:
        return total
    jobs, stages = store.jobsList(None), set()
    for k in range(jobs.size()):
        job = jobs.apply(k)
        tags = job.jobTags().mkString("\n").split("\n")
        if any(t.endswith(tag) for t in tags):
            total["jobs"] += 1
            stages |= {int(x) for x in job.stageIds().mkString(",").split(",") if x}
    for stage in stages:
        s = store.lastStageAttempt(stage)
        total["bytes_in"] += s.inputBytes()
        total["bytes_out"] += s.outputBytes()
        total["spilled"] += s.diskBytesSpilled()
        total["records_in"] += s.inputRecords()
        total["task_seconds"] += s.executorRunTime() / 1000
    return total
