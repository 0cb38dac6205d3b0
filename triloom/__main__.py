"""python -m triloom INPUT QUERIES OUTPUT [SETTINGS.ini]: run a file of queries over N-Triples."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .conf import Conf
from .engine import Engine


def main(args: list[str]) -> int:
    if len(args) not in (3, 4):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("triloom").getOrCreate()
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(args[1]).collect())
    conf = Conf.load(args[3] if len(args) == 4 else None, spark)
    conf.statistics_file = conf.statistics_file or "statistics.csv"
    Engine.from_ntriples(spark, args[0], conf, cache=True).run_file(text, args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
