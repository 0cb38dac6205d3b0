"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured by itself: words, symbols, repeated lines, words in repeated windows of eight words. A base
failure rejects it. Softer rules only count: failures are aggregated by host (`source`), a host's failure rate is
shrunk towards all hosts' by a beta prior fitted to their rates (by moments), and the verdicts are joined
back. A document that breaks one soft rule is rejected on a host whose shrunk rate reaches `bad_host`, and one that
breaks `severe` of them on any host.

Defined cases: a null or empty text has no words and fails the base rules; a null host counts as a host of
its own; null ids and repeated rows are measured row by row; an empty table gives no rows; clashing further columns are
carried only where named in `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stored

#: Characters of white space that part words, and symbols counted (fixed values).
BLANKS = " \t\n\x0b\f\r"
BLANK = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows that stand in the text twice or more; hashes has the hash of each window in order."""

    def covered(rows: Column) -> Column:
        twin = F.filter(rows, lambda e, i: F.coalesce(e["h"] == F.get(rows, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(rows, i + 1)["h"], F.lit(False)))
        places = F.array_sort(F.transform(twin, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])

    rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(rows, covered))


def measures(docs: DataFrame, *, id_col: str, text_col: str, host_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The counts of each row, with host and the columns to keep."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    first = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_kept") if keep else F.lit(None).alias("_kept"),
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("s:"), F.col(host_col).cast("string")), F.lit("none")).alias("_host"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK)).alias("_words"),
        F.char_length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
    )
    places = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    second = first.select("*", F.size("_words").cast("long").alias("n_words"), let(F.col("_words"), lambda w: F.transform(places, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).alias("_hashes"))
    return second.select(
        "_kept", "_id", "_host", "n_words", "word_chars", "n_symbols", F.col("_lines.dup").cast("long").alias("n_dup_lines"), F.col("_lines.n").cast("long").alias("_n_lines"), repeated_words(F.col("_hashes")).cast("long").alias("n_repeat_words")
    )


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = (), bad_host: float = 0.5, severe: int = 2, broadcast_hosts: int = 100_000) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed (number of
    soft rules broken), host_rate (shrunk) and kept, with the columns in `keep` as struct `_kept`."""
    m = measures(docs, id_col=id_col, text_col=text_col, host_col=host_col, keep=keep)
    n = F.col("n_words")
    soft = [
        4 * F.col("n_symbols") > n,
        100 * F.col("n_dup_lines") > 30 * F.col("_n_lines"),
        10 * F.col("n_repeat_words") > n,
        (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    ]
    m = m.withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)).withColumn("soft_failed", sum(s.cast("int") for s in soft))
    # the measures are used twice, for the hosts and for the documents: they are stored, not computed again
    m = stored(m.withColumn("_failed", (F.col("base_failed") | (F.col("soft_failed") > 0)).cast("long")), "rules")
    hosts = stored(m.groupBy("_host").agg(F.count("*").alias("n"), F.sum("_failed").alias("failed")), "hosts")
    prior = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.avg(F.col("failed") / F.col("n")).alias("mean"), F.var_pop(F.col("failed") / F.col("n")).alias("var"), F.avg(1 / F.col("n")).alias("inverse")).first()
    alpha, beta = beta_prior(prior)
    rated = hosts.select("_host", ((F.col("failed") + alpha) / (F.col("n") + (alpha + beta))).alias("host_rate"))
    # a counted bound decides; beyond it the join shuffles, and splits hot hosts at run time
    rated = F.broadcast(rated) if prior["hosts"] <= broadcast_hosts else rated
    judged = m.join(rated, "_host")
    allowed = F.when(F.col("host_rate") >= bad_host, 1).otherwise(severe)
    return judged.select(
        "_kept", F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed", "host_rate", (~F.col("base_failed") & (F.col("soft_failed") < allowed)).alias("kept")
    )


def beta_prior(s) -> tuple[float, float]:
    """Alpha and beta by moments from the spread of the hosts' rates beyond what chance gives; one row in, two numbers out."""
    if not s["hosts"]:
        return 1.0, 1.0
    mean = min(max(s["failed"] / s["n"], 1e-4), 1 - 1e-4)
    spread = max((s["var"] or 0.0) - mean * (1 - mean) * s["inverse"], 1e-6)
    strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 1e6)
    return mean * strength, (1 - mean) * strength
