"""Quality rules: length-normalised log-likelihood ratio of hashed word n-grams, and base rules, in built-in functions only.

1. Words and word pairs of every whole text are hashed into ``buckets`` bins. One pass counts the bins over all
   documents (raw) and over those that the labels trust (target): two smoothed multinomials.
2. A bin's weight is log(target share / raw share), rounded to 2**-20 so that sums are exact in any order.
3. A text's verdict is the mean weight of its n-grams against a fixed threshold: deterministic, no sampling.

The weight table has ``buckets`` rows whatever the input, so it is broadcast; counts are aggregated before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Saved, small_side

BUCKETS = 1 << 18
#: In nats a gram: texts like the trusted ones have a mean about 0, texts of other kinds one well below.
THRESHOLD = -0.25
SMOOTHING = 8.0
MIN_WORDS = 50
#: Weights are whole multiples of this, so a text's sum does not depend on the order of its n-grams.
STEP = 2.0**-20
_SPACE = " \t\n\x0b\f\r"


def _trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))


def words_column(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    bare = _trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))


def _rest(values: Column | str, first: int, fewer: int) -> Column:
    """Elements from ``first`` (1-based), ``fewer`` in all than the array has."""
    return F.slice(values, first, F.greatest(F.size(values) - fewer, F.lit(0)))


def ngram_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, target, bucket) of each word and word pair. ``docs`` has doc_id, target and text."""
    words = docs.select("doc_id", "target", words_column(F.col("text")).alias("w"))
    # words become rows before they are hashed: expressions on rows are compiled, functions over array elements are not
    near = words.select("doc_id", "target", F.explode(F.arrays_zip(F.col("w").alias("a"), _rest("w", 2, 1).alias("b"))).alias("z"))
    first = F.xxhash64("z.a")
    pair = F.when(F.col("z.b").isNotNull(), F.xxhash64(first, F.xxhash64("z.b")))
    rows = near.select("doc_id", "target", F.explode(F.array(first, pair)).alias("gram")).where("gram IS NOT NULL")
    return rows.select("doc_id", "target", F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket"))


def bucket_weights(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, weight) of every bin that occurs; ``docs`` has doc_id, target (true: trusted) and text."""
    counts = Saved(ngram_buckets(docs, buckets).groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("target").alias("trusted")), "counts").df
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("trusted").alias("all_trusted"))
    # the target's pseudo-counts have the raw proportions, so a bin that the target does not single out has weight 0 at any size
    scale = F.col("all_trusted") / F.col("all_raw")
    ratio = F.when(F.col("all_trusted") > 0, F.log((F.col("trusted") + smoothing * scale) / ((F.col("raw") + smoothing) * scale))).otherwise(0.0)
    return counts.join(F.broadcast(totals)).select("bucket", F.round(ratio / STEP).cast("long").alias("weight"))


def _base_rules(docs: DataFrame) -> DataFrame:
    """Counts of each whole text. Windows and lines are sorted within the row, so no text is shuffled."""
    words = docs.select("doc_id", "text", words_column(F.col("text")).alias("w"))
    hashed = words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(_SPACE)) != "").alias("lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    paired = hashed.select("*", F.zip_with(_rest("h", 1, 1), _rest("h", 2, 1), lambda a, b: F.xxhash64(a, b)).alias("p"))
    windows = F.zip_with(_rest("p", 1, 1), _rest("h", 3, 2), lambda p, c: F.xxhash64(p, c))
    counted = paired.select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("k"))
    found = counted.select("*", (F.size("k") == F.size(F.array_distinct("k"))).alias("all_differ"))
    ordered = found.select("*", F.when(F.col("all_differ"), None).otherwise(F.sort_array(F.transform("k", lambda x, i: F.struct(x.alias("k"), i.alias("p"))))).alias("s"))
    again = F.zip_with(_rest("s", 1, 1), _rest("s", 2, 1), lambda a, b: F.when(a["k"] == b["k"], F.array(a["p"], a["p"] + 1, a["p"] + 2, b["p"], b["p"] + 1, b["p"] + 2)))
    repeated = F.size(F.array_distinct(F.flatten(F.filter(again, lambda x: x.isNotNull()))))
    return ordered.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("all_differ"), 0).otherwise(repeated).cast("long").alias("n_repeat_words"))


def quality_verdicts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; further columns are ignored).

    ``trusted`` has the doc_id of the trusted-target documents; repeated and null ones do no harm. Columns: doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr (mean weight, in nats).
    Null and empty texts have zero counts and fail the base rules, with a null llr. Rows that repeat a doc_id are
    judged each on its own text. Without any trusted document all weights are alike and only the base rules decide.
    """
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    keyed = docs.select("doc_id", "text").join(small_side(ids), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    weights = bucket_weights(keyed, buckets)
    return _verdicts(docs, weights, buckets, threshold)


def _verdicts(docs: DataFrame, weights: DataFrame, buckets: int, threshold: float) -> DataFrame:
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("doc_id"), "text")
    grams = ngram_buckets(rows.withColumn("target", F.lit(False)), buckets)
    # rows that repeat an identifier and its text share a mark, and the mean over all of them is that of each
    scored = grams.join(F.broadcast(weights), "bucket").groupBy("doc_id").agg((F.sum("weight") * STEP / F.count("*")).alias("llr"))
    scored = scored.select(F.col("doc_id.doc_id").alias("other"), F.col("doc_id.mark").alias("mark"), "llr")
    base = _base_rules(rows).withColumns({"mark": F.col("doc_id.mark"), "doc_id": F.col("doc_id.doc_id")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.coalesce("llr", F.lit(0.0)) >= threshold)
    joined = base.join(scored, (base["mark"] == scored["mark"]) & base["doc_id"].eqNullSafe(scored["other"]), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "llr")
