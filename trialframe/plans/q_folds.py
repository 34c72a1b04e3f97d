"""Sampling, splitting and preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import prep, quality, split
from trialframe.plans.q_wide import NUM_FEATURES, TRIALS, WIDE_SQL, wide_sessions
from trialframe.plans.registry import register
from trialframe.sources.tables import table
from trialframe.streaming.ingest import shared_path

SEED = 42


def h_sql(id_expr: str, seed: str | int = SEED) -> str:
    return f"CAST(('0x' || substr(md5(concat(CAST({id_expr} AS VARCHAR), ':', CAST({seed} AS VARCHAR))), 1, 8)) AS BIGINT)"


@register("stratified_sample", f"""
WITH p AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {h_sql('doc_id')}, doc_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality FROM p WHERE pos < round_even(n * 0.2, 0)""")
def q_stratified_sample(spark, sf):
    """M2: exactly round(0.2 * n_c) rows of each class, hash-chosen."""
    lab = table(spark, sf, "labels", "doc_id", "quality")
    return split.sample_fraction(lab, "doc_id", 0.2, SEED, by=["quality"])


@register("simple_sample", f"""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {h_sql('o_orderkey')}, o_orderkey) - 1 AS pos,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM p WHERE pos < round_even(n * 0.1, 0)""")
def q_simple_sample(spark, sf):
    """M1: exactly round(0.1 * n) orders."""
    o = table(spark, sf, "orders", "o_orderkey")
    return split.sample_fraction(o, "o_orderkey", 0.1, SEED)


@register("stratified_folds", f"""
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {h_sql('doc_id')}, doc_id) - 1) % 5 AS INTEGER)
  AS fold FROM labels""")
def q_stratified_folds(spark, sf):
    """M5."""
    lab = table(spark, sf, "labels", "doc_id", "quality")
    return split.stratified_kfold(lab, "doc_id", "quality", 5, SEED)


def _contig_sql(pos: str, n: str, k: int) -> str:
    q = f"({n} // {k})"
    r = f"({n} - {q} * {k})"
    big = f"({r} * ({q} + 1))"
    return (f"CAST(CASE WHEN {pos} < {big} THEN {pos} // ({q} + 1) "
            f"ELSE {r} + ({pos} - {big}) // greatest({q}, 1) END AS INTEGER)")


@register("kfold_plain", f"""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {h_sql('o_orderkey')}, o_orderkey) - 1 AS pos,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, {_contig_sql('pos', 'n', 5)} AS fold FROM p""")
def q_kfold(spark, sf):
    """M4: shuffled k-fold with KFold's contiguous fold sizes."""
    return split.kfold(table(spark, sf, "orders", "o_orderkey"), "o_orderkey", 5, SEED)


@register("repeated_folds", f"""
WITH r AS (SELECT o_orderkey, CAST(it AS INTEGER) AS iteration FROM orders, (SELECT unnest(range(0, 2)) AS it)),
p AS (SELECT o_orderkey, iteration,
        row_number() OVER (PARTITION BY iteration ORDER BY {h_sql('o_orderkey', f'{SEED} + iteration')}, o_orderkey) - 1 AS pos,
        count(*) OVER (PARTITION BY iteration) AS n FROM r)
SELECT o_orderkey, iteration, {_contig_sql('pos', 'n', 5)} AS fold FROM p""")
def q_repeated_folds(spark, sf):
    """M9: 2 iterations x 5 folds, seed = 42 + iteration."""
    o = table(spark, sf, "orders", "o_orderkey")
    return split.repeated_kfold(o, "o_orderkey", 5, 2, SEED).select("o_orderkey", "iteration", "fold")


_GROUP_FOLDS_SQL = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS size FROM labels JOIN documents USING (doc_id) GROUP BY source),
r AS (SELECT source, size, row_number() OVER (ORDER BY size DESC, {h_sql('source', 0)}, source) AS r FROM s),
deal(r, source, fold, w) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT r.r, r.source, CAST(list_position(w, list_min(w)) - 1 AS INTEGER),
    list_transform(w, lambda x, i: CASE WHEN i = list_position(w, list_min(w)) THEN x + r.size ELSE x END)
  FROM deal JOIN r ON r.r = deal.r + 1),
f AS (SELECT source, fold FROM deal WHERE r > 0)
SELECT doc_id, documents.source, f.fold FROM labels JOIN documents USING (doc_id) JOIN f ON f.source IS NOT DISTINCT FROM documents.source"""


def group_folds(spark, sf):
    lab = table(spark, sf, "labels", "doc_id")
    doc = table(spark, sf, "documents", "doc_id", "source")
    return split.group_kfold(lab.join(doc, "doc_id"), "source", 5).select("doc_id", "source", "fold")


@register("group_folds", _GROUP_FOLDS_SQL)
def q_group_folds(spark, sf):
    """M6: a source (subject stand-in) never spans folds; lightest fold first."""
    return group_folds(spark, sf)


@register("fold_leak_check", f"""
WITH g AS ({_GROUP_FOLDS_SQL})
SELECT fold, count(DISTINCT source) AS n_groups, count(*) AS n_rows,
  (SELECT count(*) FROM (SELECT source FROM g GROUP BY source HAVING count(DISTINCT fold) > 1)) AS n_leaking
FROM g GROUP BY fold""")
def q_fold_leak_check(spark, sf):
    """Per fold group/row counts and the number of groups seen in
    more than one fold (must be 0)."""
    g = group_folds(spark, sf)
    leaks = quality.group_leak(g, "source").agg(F.count(F.lit(1))).scalar()
    return g.groupBy("fold").agg(F.count_distinct("source").alias("n_groups"), F.count(F.lit(1)).alias("n_rows")
                                 ).withColumn("n_leaking", leaks)


@register("logo_folds", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS fold FROM documents""")
def q_logo(spark, sf):
    """M7: leave-one-group-out, one fold per language."""
    return split.leave_one_group_out(table(spark, sf, "documents", "doc_id", "lang"), "lang")


@register("train_test_split", f"""
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
t AS (SELECT ceil((SELECT count(*) FROM labels) * 0.2) AS draw),
a0 AS (SELECT quality, n, draw * n / (SELECT count(*) FROM labels) AS cont FROM c, t),
a1 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM a0),
a2 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, quality) - 1 AS rk,
              (SELECT draw FROM t) - sum(fl) OVER () AS need FROM a1),
a AS (SELECT quality, CAST(fl + CASE WHEN rk < need THEN 1 ELSE 0 END AS BIGINT) AS n_draw FROM a2),
p AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {h_sql('doc_id')}, doc_id) - 1 AS pos
      FROM labels)
SELECT doc_id, quality, CASE WHEN pos < n_draw THEN 'test' ELSE 'train' END AS split FROM p JOIN a USING (quality)""")
def q_train_test_split(spark, sf):
    """M3: stratified 80/20, test size rounded up, largest-remainder per class."""
    lab = table(spark, sf, "labels", "doc_id", "quality")
    return split.train_test_split(lab, "doc_id", 0.2, SEED, stratify="quality").select("doc_id", "quality", "split")


_FEATS = [f"trial{t}_{f}" for t in TRIALS for f in NUM_FEATURES]


@register("impute_scale", f"""
WITH w AS ({WIDE_SQL}),
l AS (SELECT * FROM (SELECT session_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FEATS)} FROM w)
      UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(_FEATS)}))),
s AS (SELECT *, CASE WHEN {h_sql('session_id')} % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM l),
m AS (SELECT feature, quantile_cont(value, 0.5) AS median FROM s WHERE part = 'train' GROUP BY 1),
st AS (SELECT feature, any_value(median) AS median, avg(coalesce(value, median)) AS mean,
              stddev_pop(coalesce(value, median)) AS std FROM s JOIN m USING (feature) WHERE part = 'train' GROUP BY 1)
SELECT session_id, feature, round((coalesce(value, median) - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS value_scaled
FROM s JOIN st USING (feature)""")
def q_impute_scale(spark, sf):
    """Median imputation + standardisation fit on the train
    sessions (hash bucket != 0 of 5), applied to all, in long form."""
    w = wide_sessions(spark, sf)
    cols = prep.feature_columns(w.select(*_FEATS), exclude=["session_id"])
    # made once: every pass of the fit would shuffle the trials again
    at = shared_path(spark, "impute-sessions")
    w.select("session_id", *cols).write.parquet(at)
    w = spark.read.parquet(at)
    long = prep.to_long(w, ["session_id"], cols)
    long = long.withColumn("_train", split.hash32("session_id", SEED) % 5 != 0)
    params = prep.fit_impute_scale(long, F.col("_train"))
    out = prep.apply_impute_scale(long, params)
    return out.select("session_id", "feature", F.round("value_scaled", 6).alias("value_scaled"))


@register("class_weights", """
WITH c AS (SELECT quality, count(*) AS n_c FROM labels GROUP BY 1)
SELECT quality, n_c, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * n_c), 6) AS weight,
  round((SELECT count(*) FILTER (WHERE quality = 0) FROM labels) / (SELECT count(*) FILTER (WHERE quality = 1) FROM labels), 6)
  AS pos_weight FROM c""")
def q_class_weights(spark, sf):
    """Balanced class weights and the neg/pos ratio."""
    w = prep.class_weights(table(spark, sf, "labels", "quality"), "quality")
    return w.select("quality", "n_c", F.round("weight", 6).alias("weight"), F.round("pos_weight", 6).alias("pos_weight"))
