"""A long copy of an item with one swapped number, and the window hashes."""

import pytest
from pyspark.sql import functions as F

from trialframe.llm import decontaminate

WORDS = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]


def _found(spark, docs, item):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items).collect()
    return {r["doc_id"]: (r["contaminated"], r["n_windows"]) for r in got}


def test_long_copy_with_one_swapped_number(spark):
    item = [*WORDS[:10], "12", *WORDS[10:40], "7", *WORDS[40:45], "12", *WORDS[45:50]]
    swapped = [*item]
    swapped[10] = "7"  # another number of the item's own
    short = [*WORDS[:10], "7", *WORDS[10:16], "7", *WORDS[16:20], "12", *WORDS[20:24]]
    short_item = [*WORDS[:10], "12", *WORDS[10:16], "7", *WORDS[16:20], "12", *WORDS[20:24]]
    got = _found(spark, [" ".join(item), " ".join(swapped), "other text"], " ".join(item))
    assert got[0] == (True, len(item) - 7) and got[1][0] and got[1][1] == len(item) - 11 - 7 and not got[2][0]
    assert not _found(spark, [" ".join(short)], " ".join(short_item))[0][0]


@pytest.mark.parametrize("length", range(1, 9))
def test_windows_are_equal_where_their_tokens_are(spark, length):
    rows = [[1, 2, 3, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 2], [1, 2], []]
    df = spark.createDataFrame([(r,) for r in rows], "h array<long>")
    got = [r["h"] for r in decontaminate.with_windows(df, "h", length).collect()]
    want = [[tuple(r[i : i + length]) for i in range(len(r) - length + 1)] for r in rows]
    assert [len(g) for g in got] == [len(w) for w in want]
    pairs = {(a, b) for g, w in zip(got, want) for a, b in zip(g, w)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_names_of_a_row_are_one_token_in_both_forms(spark):
    texts = ["Anna met New York City's mayor O'Neil-Smith", "O'neil Smith and A4 Paper", "Über Österreich, Bern", "", None, "x Y z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for read, written in (decontaminate.FORMS[1],):
        got = df.select(F.size(decontaminate.words_of(decontaminate.template(read(F.col("t"))))), F.size(decontaminate.values(written(F.col("t"))))).collect()
        assert all(a == b for a, b in got) and [a for a, _ in got] == [5, 5, 2, 0, 0, 3]
