"""Deterministic sampling and fold assignment.

Randomness is a hash: ``h = first 32 bits of md5(id || ':' || seed)``, the
same in Spark and in SQL engines, so folds are reproducible anywhere and do
not depend on partitioning or task retries (``rand()`` does).

Positions in hash order inside a class come from the chunked scan (chunk =
high bits of the hash), so even a class holding most rows is ranked by many
tasks, and the per-class sizes needed for allocation are tiny aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.operators import ordered
from trialframe.operators.joins import attach

HASH_CHUNK_BITS = 16  # 65 536 ordered chunks per class


def hash32(id_col: str | Column, seed: int | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    s = F.lit(seed) if isinstance(seed, int) else seed
    key = F.concat(c.cast("string"), F.lit(":"), s.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_position(df: DataFrame, id_col: str, seed: int | Column, by: Sequence[str] = (),
                  pos: str = "_pos", size: str | None = None) -> DataFrame:
    """0-based position of each row in hash order within ``by`` (+ group
    size when ``size`` is given)."""
    d = df.withColumn("_h", hash32(id_col, seed))
    chunk = F.shiftright(F.col("_h"), 32 - HASH_CHUNK_BITS)
    totals = {size: ("count", None)} if size else None
    return ordered.scan(d, list(by), ["_h", id_col], chunk, pos=pos, totals=totals).drop("_h")


def sample_fraction(df: DataFrame, id_col: str, frac: float, seed: int = 42,
                    by: Sequence[str] = ()) -> DataFrame:
    """M1/M2: exactly ``round_half_even(frac * n)`` rows per stratum (pandas
    ``sample(frac)`` per group), chosen by hash order."""
    d = hash_position(df, id_col, seed, by, pos="_pos", size="_n")
    return d.where(F.col("_pos") < F.bround(F.col("_n") * frac)).drop("_pos", "_n")


def _allocate(counts: DataFrame, cls: str, n_col: str, total_draw: Column) -> DataFrame:
    """Largest-remainder allocation of ``total_draw`` over classes (the
    stratified split's per-class test counts). ``counts`` has one row per
    class, so the ranking window runs over a handful of rows."""
    tot = F.sum(n_col).over(Window.partitionBy())
    cont = total_draw * F.col(n_col) / tot
    c = counts.withColumns({"_cont": cont, "_floor": F.floor(cont)})
    c = c.withColumn("_rem", F.col("_cont") - F.col("_floor"))
    need = total_draw - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_rem"), F.col(cls))) - 1
    return c.withColumn("n_draw", (F.col("_floor") + F.when(rank < need, 1).otherwise(0)).cast("long")).select(
        cls, "n_draw")


def train_test_split(df: DataFrame, id_col: str, test_frac: float = 0.2, seed: int = 42,
                     stratify: str | None = None, out: str = "split") -> DataFrame:
    """M3: test size = ceil(n * test_frac) (481 -> 97), allocated over
    classes by largest remainder when stratified; rows chosen by hash."""
    by = [stratify] if stratify else []
    d = hash_position(df, id_col, seed, by, pos="_pos")
    if stratify:
        counts = df.groupBy(stratify).agg(F.count(F.lit(1)).alias("_n"))
        n_total = df.agg(F.count(F.lit(1))).scalar()
        alloc = _allocate(counts, stratify, "_n", F.ceil(n_total * test_frac))
        d = attach(d, alloc, stratify, "inner")
        is_test = F.col("_pos") < F.col("n_draw")
    else:
        n_total = df.agg(F.count(F.lit(1))).scalar()
        is_test = F.col("_pos") < F.ceil(n_total * test_frac)
    d = d.withColumn(out, F.when(is_test, "test").otherwise("train"))
    return d.drop("_pos", *(["n_draw"] if stratify else []))


def _contiguous_fold(pos: Column, n: Column, k: int) -> Column:
    """KFold sizes: the first n % k folds get n//k + 1 rows."""
    q = (n / k).cast("long")
    r = n - q * k
    big = r * (q + 1)
    return F.when(pos < big, (pos / (q + 1)).cast("long")).otherwise(r + ((pos - big) / F.greatest(q, F.lit(1))).cast("long")).cast("int")


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """M4: shuffled k-fold, contiguous fold sizes like KFold."""
    d = hash_position(df, id_col, seed, [], pos="_pos", size="_n")
    return d.withColumn(out, _contiguous_fold(F.col("_pos"), F.col("_n"), k)).drop("_pos", "_n")


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """M5: every class dealt round-robin over the folds in hash order, so
    each fold holds floor/ceil(n_c / k) rows of class c."""
    d = hash_position(df, id_col, seed, [label], pos="_pos")
    return d.withColumn(out, (F.col("_pos") % k).cast("int")).drop("_pos")


def greedy_deal(runs: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """The lightest-fold deal of groups in descending size, without the groups.

    ``runs`` are (size, number of groups of that size), sizes descending. Each
    group goes to the lightest fold, the lowest on ties. Equal groups fall to
    the folds in a repeating order as long as no further fold comes level, so a
    run has at most ``k`` stretches: (size, first, number, folds) says that the
    groups first .. first + number - 1 of the run go to ``folds`` in turn."""
    weight = [0] * k
    out = []
    for size, count in runs:
        first = 0
        entry = sorted(range(k), key=lambda i: (weight[i], i))
        level = 1
        while count:
            # folds that take part, and how many groups they get before the next one is the lightest
            turn = sorted(entry[:level], key=lambda i: (weight[i], i))
            n = count
            if level < k:
                limit, rival = weight[entry[level]], entry[level]
                n = min(n, sum(max(0, -(-(limit + (i < rival) - weight[i]) // size)) for i in turn))
            if n:
                out.append((size, first, n, turn))
                for at, i in enumerate(turn):
                    weight[i] += size * (n // level + (at < n % level))
            first, count, level = first + n, count - n, min(level + 1, k)
    return out


def group_kfold(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """M6: a group never spans folds; groups in descending size (equal sizes by
    a hash of the group), each to the lightest fold. The driver holds one row
    for each distinct size, of which n rows have sqrt(2 n) at most, and deals
    whole runs of equal groups; the groups themselves are numbered within their
    size by a chunked scan, also where most of them share one size."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).withColumn("_gh", hash32(group, 0))
    runs = [(r["_size"], r["n"]) for r in sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_size")).collect()]
    deal = df.sparkSession.createDataFrame(greedy_deal(runs, k), "_of long, _first long, _number long, _turn array<int>")
    chunk = F.shiftright(F.col("_gh"), 32 - HASH_CHUNK_BITS)
    ranked = ordered.scan(sizes, ["_size"], ["_gh", group], chunk, pos="_r")
    here = (F.col("_size") == F.col("_of")) & (F.col("_r") >= F.col("_first")) & (F.col("_r") < F.col("_first") + F.col("_number"))
    turn = ((F.col("_r") - F.col("_first")) % F.size("_turn")).cast("int")
    folds = ranked.join(deal, here).select(group, F.get("_turn", turn).alias(out))
    return attach(df, folds, group, "inner")


def leave_one_group_out(df: DataFrame, group: str, out: str = "fold") -> DataFrame:
    """M7: fold = rank of the group among the distinct groups, a null group
    first; they are ranked in ranges over many tasks."""
    g = ordered.range_chunked(df.select(group).distinct(), group)
    g = ordered.scan(g, [], [group], F.col("_range"), pos="_p").select(group, F.col("_p").cast("int").alias(out))
    return attach(df, g, group, "inner")


def repeated_kfold(df: DataFrame, id_col: str, k: int = 5, n_iter: int = 2, base_seed: int = 42,
                   label: str | None = None) -> DataFrame:
    """M9: (iteration, fold) per row; iteration i reshuffles with seed
    base+i. Rows are replicated per iteration by ``explode`` (the output is
    genuinely n_iter x rows), never by a join."""
    d = df.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    seed = F.lit(base_seed) + F.col("iteration")
    by = ["iteration"] + ([label] if label else [])
    d = hash_position(d, id_col, seed, by, pos="_pos", size=None if label else "_n")
    if label:
        return d.withColumn("fold", (F.col("_pos") % k).cast("int")).drop("_pos")
    return d.withColumn("fold", _contiguous_fold(F.col("_pos"), F.col("_n"), k)).drop("_pos", "_n")


def cv_splitter(name: str):
    """M8: splitter by name; unknown names fall back to plain k-fold with a
    warning."""
    table = {"kfold": kfold, "stratified": stratified_kfold, "group": group_kfold,
             "logo": leave_one_group_out}
    if name not in table:
        import warnings

        warnings.warn(f"unknown cv type {name!r}; using k-fold", stacklevel=2)
        return kfold
    return table[name]
