"""N-Triples as a DataFrame of s, p, o.

Lines are read by Spark's text source, so files compressed as .bz2 or .gz work by their suffix (LZO needs a codec that isn't
on the class path). Escapes stay raw; datatype and language tags go unless keep_tags is set; lines that aren't triples are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# subject: an IRI or what stands before white space; predicate: an IRI; object: IRI, literal up to the first quote after no
# backslash, or blank node; then anything; and a dot at the end
LINE = r'^(<[^>]*>|[^<\s]\S*)\s+(<[^>]*>)\s*(<[^>]*>|"(?:[^"\\]|\\.)*"{tag}|_\S*).*\.\s*$'
TAG = r"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?"


def parse_lines(lines: DataFrame, column: str = "value", keep_tags: bool = False) -> DataFrame:
    """Triples of a column of lines."""
    line, pattern = F.col(column), LINE.replace("{tag}", TAG if keep_tags else "")
    parts = [F.nullif(F.regexp_extract(line, pattern, k), F.lit("")).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))]
    return lines.where(F.length(line) >= 3).select(*parts).where("s is not null and p is not null and o is not null")


def read_ntriples(spark: SparkSession, path: str | list[str], dedupe: bool = False, keep_tags: bool = False) -> DataFrame:
    """Triples of files or folders; dedupe gives set semantics, keep_tags keeps datatype and language of literals."""
    got = parse_lines(spark.read.text(path), keep_tags=keep_tags)
    return got.distinct() if dedupe else got


def write_triples(triples: DataFrame, path: str) -> None:
    """Parquet with a folder for each predicate, so that a bound predicate reads its folder only.

    Rows are dealt by predicate and a salt, so that a frequent predicate is no single task.
    """
    triples.withColumn("_salt", F.pmod(F.xxhash64("s"), F.lit(32))).repartition("p", "_salt").drop("_salt").write.mode("errorifexists").partitionBy("p").parquet(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("s string, o string, p string").parquet(path).select("s", "p", "o")
