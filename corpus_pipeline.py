"""A corpus in five stages: quality classifier, quality rules, n-gram Jaccard join, personal data, packing.

Each stage gets what its predecessor kept. All but the last return the columns of `documents`; the last returns the
pieces of packed sequences.

Defined cases, for all stages: a null text counts as empty (masking leaves it null); null and repeated ids are rows like others (of
a group of copies the row with the smallest id stays, null ids last, of several the first); an empty table gives no rows;
further columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.llm import packing, pii, quality_cnn, quality_rules, setjoin
from triloom.llm.queries import fitted, table, tokenizer_path
from triloom.llm.runtime import stored


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality network predicts as good; it learns from the labelled rows of the given documents."""
    got = quality_cnn.score(docs, fitted(spark, docs, sf_dir), threshold=0.3, keep=tuple(docs.columns))
    return got.where("predicted = 1").select("_kept.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the rules and the hosts' verdicts keep."""
    got = quality_rules.verdicts(docs, keep=tuple(docs.columns))
    return got.where("kept").select("_kept.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: that with the group's smallest id (null ids last), of several with it the first."""
    # numbered names, so that no column of the documents is taken for one of the operator's
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    keyed = stored(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.monotonically_increasing_id().alias("_row")), "keyed")
    found = setjoin.jaccard_components(keyed, id_col="_row", text_col=names["text"], size=4, percent=85)
    found = stored(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), "groups")
    # only rows of groups of several are shuffled
    several = found.where("_group <> _row").select("_group").distinct()
    members = found.join(several, "_group", "left_semi").join(keyed.select("_row", F.col(names["doc_id"]).alias("_id")), "_row")
    best = members.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).getField("_row").alias("_best"))
    dropped = stored(members.join(best, "_group").where("_row <> _best").select("_row"), "dropped")
    return keyed.join(dropped, "_row", "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind; n_chars follows the text."""
    got = pii.redact(docs, pii.train())
    return got.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), longest=2048, end_id=1, keep_ids=False)
    return got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", classify), ("quality rules", rules), ("n-gram jaccard join", deduplicate), ("personal data", mask), ("packing", pack)]

#: Learned weights and subword vocabularies are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
