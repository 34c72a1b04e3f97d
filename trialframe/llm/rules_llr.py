"""Quality rules: base counts plus a hashed n-gram log-likelihood ratio.

Two multinomials over ``2**bits`` buckets of hashed word 1- and 2-grams are
counted: one over trusted documents, one over all documents, both with additive
smoothing. A document's score is the sum of log(trusted / raw) over its
n-grams divided by their number; it passes if the score reaches ``min_score``.
The raw counts cover every document, the trusted ones every document whose id
is given.

All of it runs as array and map functions on the row that holds the text, so
no word or window is shuffled; only bucket counts are, and, if there are more
than MAX_BROADCAST_IDS trusted ids, each text once to meet them.

Edge cases: null and empty texts have no words: all counts 0, base_failed true
and score null. One word has one n-gram. Repeated rows are counted each time
and judged alike; a null id is never trusted; without trusted ids the score is
null and only the base decides; an empty table returns no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
# fixed values: separators of words, and the characters that count as symbols
SEPARATORS = ["\t", "\n", "\x0b", "\f", "\r", " "]
SYMBOLS = list("#*$%&|<>")
MAX_BROADCAST_IDS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of WORD; splitting at one plain character needs no regex."""
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SEPARATORS[:-1], F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(spaced, " "), "")


def _length_without(text: Column, chars: list[str]) -> Column:
    return F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text))


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, F.lit(1 + by), F.greatest(F.size(values) - by, F.lit(0)))


def _repeated_positions(words: Column, bits: Column) -> Column:
    """Sorted positions of the 3-word windows that a text holds twice or more.

    A window is one long: its hash, shifted up to make room for its position,
    so that sorting longs brings equal windows together (for a text of n words
    64 - bits of the hash remain, bits = log2(n)). Arrays are zipped with shifted ones
    and not indexed in a lambda, so an optimiser that inlines them never
    evaluates one per element.
    """
    third = F.arrays_zip(words.alias("a"), _shifted(words, 1).alias("b"), _shifted(words, 2).alias("c"))
    packed = F.transform(third, lambda x, i: F.call_function("shiftleft", F.xxhash64(x["a"], x["b"], x["c"]), bits).bitwiseOR(i.cast("long")))
    ordered = F.sort_array(F.slice(packed, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    pairs = F.zip_with(ordered, _shifted(ordered, 1), lambda a, b: F.when(F.call_function("shiftright", a.bitwiseXOR(b), bits) == 0, F.array(place(a), place(b))))
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _words and the base counts."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    d = docs.withColumn("_text", F.col(text_col)).withColumn("_words", words_of(text))
    covered = F.aggregate(
        F.col("_dup"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"],
    )
    return (
        d.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_bits", F.ceil(F.log2(F.size("_words") + 1.0)).cast("int"))
        .withColumn("_dup", _repeated_positions(F.col("_words"), F.col("_bits")))
        .withColumn("n_repeat_words", F.when(F.size("_dup") > 0, covered).otherwise(F.lit(0)).cast("long"))
        .withColumn("word_chars", _length_without(text, SEPARATORS).cast("long"))
        .withColumn("n_symbols", (F.length(text) - _length_without(text, SYMBOLS)).cast("long"))
        .withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_dup", "_lines", "_text", "_bits")
    )


def _exploded(docs: DataFrame, keep: list[str], bits: int) -> DataFrame:
    """A row for each word: keep, and the buckets one (1-gram) and two (the
    2-gram it begins, null at the end). Texts without words keep one row."""
    pair = F.arrays_zip(F.col("_words").alias("a"), _shifted(F.col("_words"), 1).alias("b"))
    mask = F.lit((1 << bits) - 1).cast("long")
    a, b = F.col("_p.a"), F.col("_p.b")
    return docs.select(*keep, F.explode_outer(pair).alias("_p")).select(
        *keep,
        F.when(a.isNotNull(), F.xxhash64(a).bitwiseAND(mask).cast("int")).alias("one"),
        F.when(b.isNotNull(), F.xxhash64(a, b).bitwiseAND(mask).cast("int")).alias("two"),
    )


def trusted_sample(ids: DataFrame, max_trusted: int) -> DataFrame:
    """At most max_trusted distinct non-null ids, those of the smallest hashes."""
    col = ids.columns[0]
    one = ids.select(F.col(col).alias("_id")).where("_id is not null").distinct()
    return one.orderBy(F.xxhash64("_id"), "_id").limit(max_trusted)


def with_trusted(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_text, _trusted) of docs: _trusted is 1 for the ids given, else null."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    one = ids.select(F.col(ids.columns[0]).alias("_id")).where("_id is not null").distinct().withColumn("_trusted", F.lit(1))
    if one.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        return d.join(F.broadcast(one), "_id", "left").select("_text", "_trusted")
    # by a shuffle; null ids, which would meet in one task, stay where they are
    known = d.where("_id is not null").join(one.hint("merge"), "_id", "left").select("_text", "_trusted")
    return known.unionByName(d.where("_id is null").select("_text", F.lit(None).cast("int").alias("_trusted")))


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, bits: int, smooth: float, id_col: str, text_col: str) -> DataFrame:
    """One row: weights, an array of log(trusted / raw) by bucket (null without trusted n-grams)."""
    d = with_trusted(docs, trusted_ids, id_col, text_col).select("_trusted", words_of(F.col("_text")).alias("_words"))
    grams = _exploded(d, ["_trusted"], bits).select("_trusted", F.explode(F.array("one", "two")).alias("b")).where("b is not null")
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("trusted"))
    every = docs.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    one = every.agg(
        F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"), F.sort_array(F.collect_list(F.struct("b", "raw", "trusted"))).alias("c")
    )
    size = smooth * (1 << bits)
    return one.select(F.transform("c", lambda x: F.when(
        F.col("trusted") > 0,
        F.round(F.log((x["trusted"] + smooth) / (F.col("trusted") + size)) - F.log((x["raw"] + smooth) / (F.col("raw") + size)), 9),
    )).alias("weights"))


def judge(
    docs: DataFrame,
    trusted_ids: DataFrame,
    min_score: float = -0.075,
    bits: int = 16,
    smooth: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs -> (id, the base counts, base_failed, llr, kept), one row for each."""
    # 2**bits doubles whatever the corpus: as a folded literal, since a column would be copied into every row
    found = log_ratios(docs, trusted_ids, bits, smooth, id_col, text_col).first()["weights"]
    weights = F.split(F.lit(",".join("" if w is None else repr(w) for w in found)), ",").try_cast("array<double>")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    d = with_base(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")), "_body")
    d = _exploded(d.withColumn("_row", F.monotonically_increasing_id()), ["_row", "_id", *base], bits)
    # a text's words are all in one task: each task sends on one row for each of its texts
    score = F.coalesce(F.get(weights, F.col("one")), F.lit(0.0)) + F.coalesce(F.get(weights, F.col("two")), F.lit(0.0))
    d = d.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in ["_id", *base]), F.sum(score).alias("_s"), (F.count("one") + F.count("two")).alias("_n")
    )
    trusted = any(w is not None for w in found)
    return d.withColumn("llr", F.round(F.col("_s") / F.nullif(F.col("_n"), F.lit(0)), 6) if trusted else F.lit(None).cast("double")).select(
        F.col("_id").alias(id_col), *base, "llr",
        (~F.col("base_failed") & F.coalesce(F.col("llr") >= min_score, F.lit(True))).alias("kept"),
    )
