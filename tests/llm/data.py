"""Small awkward tables for the operators of trialframe.llm."""

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} lorem" for i in range(30_000))


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 70),
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 70),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 70),
        (3, None, "en", "a", 0),
        (4, "", None, None, None),
        (5, " \t\n \x0b\f\r ", "en", "b", 7),
        (None, "no id here but some words to look at", "en", "b", 30),
        (6, LONG, "en", "b", len(LONG)),
        (7, "é", "fr", "c", 1),
        (8, "one two", "fr", "c", 7),
        (9, "übergroß ça y est\n\n\nübergroß ça y est", "de", "c", 30),
    ]
    df = spark.createDataFrame(rows, DOCUMENT)
    from pyspark.sql import functions as F

    for extra in ("score", "key", "rows", "n", "_text", "_id", "rep", "root", "node", "a", "b", "item", "windows", "copy_no", "spans", "kept"):
        df = df.withColumn(extra, F.lit(f"own {extra}"))
    return df


def empty(spark):
    return awkward(spark).limit(0)
