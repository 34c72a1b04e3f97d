"""Benchmark decontamination on templates.

Texts are canonicalised: numbers, the units behind them and names (capitalised
words inside a sentence) become typed placeholders, the rest lower case without
punctuation. A second reading takes every capitalised word as a name, the first
of a sentence too, and several in a row as one. Windows of WINDOW template tokens are hashed and joined with those
of the benchmark. Hits of a document and an item on one diagonal (document
position minus item position) form a run; at the places that its windows cover
the slots must be consistent: one value of the item always stands for one value
of the document. That catches re-parameterised questions, not only copies. A
document is contaminated by an item if a consistent part of a run has
``min_windows`` windows, or MIN_SHARE of the item's if that is fewer, in either
reading. A run in
which a value of the item stands for two, one of them another of the item's own
values, is no hit: it asks something else. But VERBATIM tokens in a row, values
included, are a copy whatever the rest of the run says.

Benchmark windows need MIN_LITERAL tokens that are no placeholders. Items that
have no such window (under WINDOW tokens, or dense in numbers and names) are
found by exact copies of all their tokens, values included and punctuation
aside; an item of one word is found in every text that holds the word.

Edge cases: null and empty texts are clean; rows with the same id (null too) are
one document; repeated items are each reported; with an empty benchmark every
document is clean; empty documents return no rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.helpers import checkpointed
from trialframe.llm.rules_llr import _shifted, words_of

WINDOW = 8
MIN_LITERAL = 5
MIN_WINDOWS = 6
MAX_BROADCAST_WINDOWS = 200_000
MAX_BROADCAST_RUNS = 10_000
# fixed values: punctuation that is dropped, and the units behind numbers
PUNCTUATION = list(".,;:!?\"()[]")
UNITS = "kmh|km|kg|cm|mm|ml|min|mph|m|g|l|s|h|usd|eur"
NAME = r"([\p{Ll},;] )\p{Lu}\p{L}*"
# of names() only: a capitalised word anywhere, also one of several parts, and those that follow each other
JOINT = "\x01"
ONE_NAME = r"\p{Lu}\p{L}*+(?:['’-]++\p{Lu}\p{L}*+)*+"
NAMES = rf"(?<![\p{{L}}\p{{N}}]){ONE_NAME}(?: {ONE_NAME})*+"
NEXT_NAME = rf"(?<![\p{{L}}\p{{N}}])({ONE_NAME}) (?=\p{{Lu}})"
MIN_SHARE = 0.6
VERBATIM = 30
NUMBER = r"[0-9]+([.,][0-9]+)*"


def _bare(text: Column) -> Column:
    """One pass of a regex: a replacement for each character takes longer."""
    return F.regexp_replace(text, "[" + re.escape("".join(PUNCTUATION)) + "]", "")


def template(text: Column) -> Column:
    """Canonical text; white space, and so the tokens' order, is as it was."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), NAME, "$1<name>")
    t = F.regexp_replace(t, NUMBER, "<num>")
    t = F.regexp_replace(F.lower(t), rf"<num>( ?)({UNITS})\b", "<num>$1<unit>")
    return _bare(t)


def names(text: Column) -> Column:
    """Text for template() in which every capitalised word, the first of a
    sentence too, is a name, and a run of them one name."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), NAMES, "<name>")


def _joint(text: Column) -> Column:
    """The text with the names that names() takes as one joined to one word."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), NEXT_NAME, f"$1{JOINT}")


def _plain(text: Column) -> Column:
    return text


# how a text is read for its template and for its values: names inside sentences (as the SQL has it), and all names
FORMS = ((_plain, _plain), (names, _joint))


def values(text: Column) -> Column:
    """Tokens as written, one for each template token."""
    return words_of(_bare(F.coalesce(text, F.lit(""))))


def token_hashes(text: Column) -> Column:
    return F.transform(words_of(template(text)), lambda t: F.xxhash64(t))


def with_windows(df: DataFrame, col: str, length: int = WINDOW) -> DataFrame:
    """Replaces a column of token hashes by the hashes of its windows of
    ``length`` tokens, an array of longs.

    Windows of twice the length are made from pairs of windows, in a step of
    their own (an expression used twice would be computed twice), so a token is
    hashed with log2(length) others and not with all of its window."""
    made = 1
    while made < length:
        by = min(made, length - made)
        df = df.withColumn(col, F.zip_with(col, _shifted(F.col(col), by), lambda a, b: F.xxhash64(a, b)))
        made += by
    return df.withColumn(col, F.slice(col, F.lit(1), F.greatest(F.size(col) - (length - 1), F.lit(0))))


def _is_slot(token: Column) -> Column:
    return token.contains("<num>") | token.contains("<name>")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, form=FORMS[0]) -> DataFrame:
    text = form[0](F.col(text_col))
    b = benchmark.select(F.col(item_col).alias("item"), words_of(template(text)).alias("_t"), token_hashes(text).alias("_h"))
    b = with_windows(b, "_h").select("item", "_t", F.posexplode_outer("_h").alias("bpos", "w")).where("w is not null")
    literal = F.size(F.filter(F.slice("_t", F.col("bpos") + 1, F.lit(WINDOW)), lambda t: ~_is_slot(t)))
    return b.where(literal >= MIN_LITERAL).select("item", "bpos", "w")


def runs(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, form=FORMS[0]) -> DataFrame:
    """(doc_id, item, diagonal, at) of the aligned hits; at: their places in the document, sorted."""
    grams = checkpointed(benchmark_windows(benchmark, item_col, item_text_col, form))
    if grams.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS:
        grams = F.broadcast(grams)
    d = docs.select(F.col(id_col).alias("doc_id"), token_hashes(form[0](F.col(text_col))).alias("_h"))
    # outer, so that no filter on the array is derived, which would compute it twice
    d = with_windows(d, "_h").select("doc_id", F.posexplode_outer("_h").alias("dpos", "w"))
    hits = d.join(grams, "w").select("doc_id", "item", (F.col("dpos") - F.col("bpos")).alias("diagonal"), "dpos")
    return hits.groupBy("doc_id", "item", "diagonal").agg(F.sort_array(F.collect_set("dpos")).alias("at"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _covers(w: Column, p: Column) -> Column:
    return (w <= p) & (p < w + WINDOW)


def consistent_windows(at: Column, slots: Column) -> Column:
    """Windows of the largest consistent part of a run.

    at: places of its windows, sorted; slots: (p, b, d), the values b and d of
    item and document at place p, of the places that a window covers. A part is
    a range of windows along which a value of the item always stands for one of
    the document, or all windows with unchanged values. A value that stands for
    two, one of them another of the item's own, mixes up the item's slots, which
    makes it another question: 0.
    """
    differs = lambda s, q: (q["b"] == s["b"]) & (q["d"] != s["d"])
    mixed = F.exists(slots, lambda s: (s["b"] != s["d"]) & F.exists(slots, lambda q: differs(s, q)) & F.exists(slots, lambda q: q["b"] == s["d"]))
    # of each slot: the first window over it (counted from 1), and the last window over the slot before it that disagrees
    clash = F.transform(slots, lambda s: F.struct(
        (F.size(F.filter(at, lambda w: w + (WINDOW - 1) < s["p"])) + 1).alias("first"),
        F.array_max(F.transform(F.filter(slots, lambda q: (q["p"] < s["p"]) & differs(s, q)), lambda q: F.size(F.filter(at, lambda w: w <= q["p"])))).alias("last"),
    ))
    part = _let(F.filter(clash, lambda c: c["last"].isNotNull()), lambda cs: F.array_max(F.transform(
        F.concat(F.array(F.size(at)), F.transform(cs, lambda c: c["first"] - 1)),
        lambda j: j - F.coalesce(F.array_max(F.transform(F.filter(cs, lambda c: c["first"] <= j), lambda c: c["last"])), F.lit(0)),
    )))
    unchanged = F.filter(at, lambda w: ~F.exists(slots, lambda s: _covers(w, s["p"]) & (s["b"] != s["d"])))
    # the longest row of windows that follow each other
    zero = F.struct(F.lit(-2).alias("w"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a, w):
        n = F.when(w == a["w"] + 1, a["n"] + 1).otherwise(F.lit(1))
        return F.struct(w.cast("int").alias("w"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    stretch = F.aggregate(unchanged, zero, step, lambda a: a["best"])
    copied = F.when(stretch + (WINDOW - 1) >= VERBATIM, stretch).otherwise(F.lit(0))
    return F.when(mixed, copied).otherwise(F.greatest(part, F.size(unchanged))).cast("long")


def consistent(
    found: DataFrame, docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, form=FORMS[0]
) -> DataFrame:
    """(doc_id, item, windows) of the runs with the windows of their largest
    consistent part; all windows of runs without slots."""
    first, last = F.element_at("at", 1), F.element_at("at", -1)
    span = last - first + WINDOW
    b = benchmark.select(F.col(item_col).alias("item"), words_of(template(form[0](F.col(item_text_col)))).alias("_bt"), values(form[1](F.col(item_text_col))).alias("_bv"))
    b = b.dropDuplicates(["item"])
    start = F.greatest(first - F.col("diagonal"), F.lit(0)) + 1
    found = found.join(b, "item").withColumn("_slots", F.slice("_bt", start, span)).withColumn("_bv", F.slice("_bv", start, span))
    found = checkpointed(found.withColumn("_has", F.exists("_slots", _is_slot)).drop("_bt"))
    plain = found.where("not _has").select("doc_id", "item", F.size("at").cast("long").alias("windows"))
    todo = found.where("_has").drop("_has")
    few = todo.limit(MAX_BROADCAST_RUNS + 1).count()
    if not few:
        return plain
    todo = F.broadcast(todo) if few <= MAX_BROADCAST_RUNS else todo
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    j = d.join(todo, F.col("_id").eqNullSafe(F.col("doc_id")))
    z = F.arrays_zip(F.col("_slots").alias("t"), F.col("_bv").alias("b"), F.slice(values(form[1](F.col("_text"))), first + 1, span).alias("d"))
    placed = F.transform(z, lambda x, i: F.struct((i + first).alias("p"), x["t"].alias("t"), x["b"].alias("b"), x["d"].alias("d")))
    slots = F.filter(placed, lambda s: _is_slot(s["t"]) & F.exists("at", lambda w: _covers(w, s["p"])))
    return plain.unionByName(j.select("doc_id", "item", _let(slots, lambda s: consistent_windows(F.col("at"), s)).alias("windows")))


def whole_copies(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(doc_id, item, windows) of exact copies of the items without benchmark
    windows, values included. An item is cut into pieces of WINDOW tokens (one
    piece if it is shorter), the last one flush with its end; a copy has all of
    them on one diagonal."""
    known = benchmark_windows(benchmark, item_col, item_text_col).select(F.col("item").alias("_known")).distinct()
    raw = lambda text: F.transform(values(text), lambda t: F.xxhash64(t))
    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(item_text_col).alias("key"), raw(F.col(item_text_col)).alias("_h"))
    items = items.where("size(_h) > 0").join(known, F.col("item") == F.col("_known"), "left_anti").dropDuplicates(["item", "key"])
    items = checkpointed(items.withColumn("n", F.size("_h")).withColumn("length", F.least(F.col("n"), F.lit(WINDOW))))
    parts = []
    for length in sorted(r["length"] for r in items.select("length").distinct().collect()):  # WINDOW values at most
        pieces = with_windows(items.where(F.col("length") == length), "_h", length).select("item", "key", "n", F.posexplode("_h").alias("bpos", "w"))
        pieces = checkpointed(pieces.where((F.col("bpos") % length == 0) | (F.col("bpos") == F.col("n") - length)))
        if pieces.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS:
            pieces = F.broadcast(pieces)
        d = docs.select(F.col(id_col).alias("doc_id"), raw(F.col(text_col)).alias("_h"))
        d = with_windows(d, "_h", length).select("doc_id", F.posexplode_outer("_h").alias("dpos", "w"))
        hits = d.join(pieces, "w").groupBy("doc_id", "item", "key", "n", (F.col("dpos") - F.col("bpos")).alias("diagonal"))
        whole = F.ceil(F.col("n") / F.lit(length))
        parts.append(hits.agg(F.countDistinct("bpos").alias("met")).where(F.col("met") == whole).select(
            "doc_id", "item", F.greatest(F.col("n") - (WINDOW - 1), F.lit(1)).cast("long").alias("windows")
        ))
    return reduce(DataFrame.unionByName, parts) if parts else None


def find(
    docs: DataFrame, benchmark: DataFrame, min_windows: int = MIN_WINDOWS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """docs -> (id, contaminated, n_windows, items): one row for each of docs;
    n_windows of its longest run, items sorted."""
    cols = (id_col, text_col, item_col, item_text_col)
    parts = []
    for k, form in enumerate(FORMS):
        need = benchmark_windows(benchmark, item_col, item_text_col, form).groupBy("item").agg(F.countDistinct("bpos").alias("of_item"))
        need = need.select("item", F.least(F.lit(min_windows), F.ceil(F.col("of_item") * MIN_SHARE)).alias("least"))
        found = runs(docs, benchmark, *cols, form).join(need, "item").where(F.size("at") >= F.col("least")).drop("least")
        found = consistent(found, docs, benchmark, *cols, form).join(need, "item").where("windows >= least")
        parts.append(found.select("doc_id", "item", "windows", F.lit(k).alias("form")))
    copies = whole_copies(docs, benchmark, *cols)
    if copies is not None:
        parts.append(copies.withColumn("form", F.lit(len(FORMS))))
    found = reduce(DataFrame.unionByName, parts)
    # n_windows is of the first form that found the document
    hit = found.groupBy("doc_id").agg(F.max(F.struct(-F.col("form"), "windows"))["windows"].alias("n_windows"), F.sort_array(F.collect_set("item")).alias("items"))
    hit = hit.withColumnRenamed("doc_id", "_d")
    return docs.select(F.col(id_col).alias("_id")).join(hit, F.col("_id").eqNullSafe(F.col("_d")), "left").select(
        F.col("_id").alias(id_col), F.col("n_windows").isNotNull().alias("contaminated"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )
