"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, digits as 0, everything but letters and digits as one blank) and hashed. For every
host the distinct documents that hold a line are counted, equal texts as one document. A line above the limit is removed
from all documents of the host; a document that is left with too few words, or less than half of its words, is depleted
and rejected. The limit is an absolute number of documents, whatever the host's size, and lower for lines of many words,
which do not meet by chance. Beside that, plain per-document rules are evaluated.

Skew: equal texts are merged before counting, and counts are pre-aggregated before their shuffle. Removed lines stay
distributed, as they grow with the corpus: up to ``SMALL`` of them (counted) are broadcast, more are joined on host and
hash, a line that very many texts hold dealt to several tasks. So are the copies of a text when they get its result.

Defined results: a null text has no words and fails the base rules. A null host is a host of its own. Repeated rows
repeat in the result and count once in the line frequencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsforest.operators.skew import split_join
from epsforest.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the contract.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30
#: A line is removed if more documents of its host hold it, fewer for a line of LONG normalised words or more.
DOCUMENTS, LONG_DOCUMENTS, LONG = 10, 2, 50
#: What must be left of a document.
LEFT_WORDS, LEFT_SHARE = 20, 0.5
#: Up to so many removed lines are broadcast (some 5 MB).
SMALL = 100_000


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normalised(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}", "0"), r"[^\p{L}\p{N}]+", " ")
    return F.trim(plain)


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: the base measures, keys of its host and text, and its lines as (hash of the normalised line, whether it is long, words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    x = x.withColumn("w", words_in(F.col("t"))).withColumn("l", lines)
    x = x.withColumn("n_words", F.size("w")).withColumn("h", F.transform("w", lambda s: F.xxhash64(s)))
    grams = F.transform(F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))
    x = x.withColumn("g", F.when(F.col("n_words") >= WINDOW, grams).otherwise(F.array().cast("array<long>")))
    pairs = F.sort_array(F.transform("g", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    twice = F.size(F.array_distinct("g")) < F.size("g")
    plain = F.transform("l", lambda s: F.struct(normalised(s).alias("n"), F.size(words_in(s)).alias("words")))
    x = x.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host"), "n_words", F.md5("t").alias("text_key"), F.length(F.array_join("w", "")).alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).alias("n_symbols"), (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.when(twice, pairs).otherwise(F.array().cast("array<struct<v:long,i:int>>")).alias("s"),
        F.transform(plain, lambda s: F.struct(F.xxhash64(s["n"]).alias("line"), (F.size(F.split(s["n"], " ")) >= LONG).alias("long"), s["words"].alias("words"))).alias("lines"),
    )
    same = lambda p, k: (p["v"] == F.get("s", k - 1)["v"]) | (p["v"] == F.get("s", k + 1)["v"])
    at = F.transform("s", lambda p, k: F.when(same(p, k), p["i"]))
    x = x.withColumn("at", F.sort_array(F.filter(at, lambda i: i.isNotNull()))).drop("s")
    run = F.transform("at", lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get("at", k + 1) - p), F.lit(WINDOW)))
    x = x.withColumn("n_repeat_words", F.aggregate(run, F.lit(0), lambda a, b: a + b)).drop("at")
    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        x = x.withColumn(c, F.col(c).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return x.withColumn("base_failed", failed)


def frequent_lines(texts: DataFrame) -> DataFrame:
    """host, line, n: the lines above the limit and how many texts hold them. texts: (host, text_key, lines), distinct."""
    held = F.array_distinct(F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["long"].alias("long"))))
    counts = texts.select("host", F.explode(held).alias("x")).groupBy("host", F.col("x.line").alias("line")).agg(F.count("*").alias("n"), F.bool_or("x.long").alias("long"))
    return counts.where(F.col("n") > F.when(F.col("long"), LONG_DOCUMENTS).otherwise(DOCUMENTS)).drop("long")


def removed_words(texts: DataFrame, small: int) -> DataFrame:
    """host, text_key, gone: the words of removed lines, of texts that hold such lines."""
    frequent = cut(frequent_lines(texts), "frequent")
    lines = texts.select("host", "text_key", F.explode("lines").alias("x")).select("host", "text_key", "x.line", "x.words")
    size = frequent.agg(F.count("*").alias("lines"), F.sum("n").alias("n")).first()
    if size["lines"] <= small:
        found = lines.join(F.broadcast(frequent.drop("n")), ["host", "line"])
    else:
        found = split_join(lines, frequent.drop("n"), ["host", "line"], frequent, size["n"])
    return found.groupBy("host", "text_key").agg(F.sum("words").alias("gone"))


def apply_rules(docs: DataFrame, host: str = "source", small: int = SMALL) -> DataFrame:
    """One row per row of ``docs``: the base measures, base_failed, n_removed_words, n_left_words, kept."""
    measured = cut(measures(docs, host), "lines")
    texts = cut(measured.groupBy("host", "text_key").agg(F.first("lines").alias("lines"), F.count("*").alias("n")), "texts")
    gone = texts.drop("lines").join(removed_words(texts, small), ["host", "text_key"], "left")
    gone = cut(gone.select("host", "text_key", "n", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed_words")), "removed")
    total = texts.agg(F.sum("n")).first()[0] or 0
    x = split_join(measured.drop("lines"), gone.drop("n"), ["host", "text_key"], gone.select("host", "text_key", "n"), total)
    x = x.withColumn("n_left_words", F.col("n_words") - F.col("n_removed_words"))
    enough = (F.col("n_left_words") >= LEFT_WORDS) & (F.col("n_left_words") >= LEFT_SHARE * F.col("n_words"))
    measured_columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return x.select(*measured_columns, "n_removed_words", "n_left_words", (~F.col("base_failed") & enough).alias("kept"))
