"""Trials -> wide session rows, labels, band exclusion, class balance and
set operations (slice 0 of the build plan, A1-A3 A15-A19 F4 J7 Q3 Q10 U1-U3
W17).

Stand-ins (FIXTURES.md §3): a session is an order (``l_orderkey``), a trial
is a line item (``l_linenumber`` 1..7), the score of a session is its
customer's ``c_acctbal``; only completed orders (``o_orderstatus = 'F'``)
carry a score, so the label join has unmatched sessions, like sessions
without a questionnaire.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import clean, summary, wide
from trialframe.plans.registry import register
from trialframe.sources.tables import TRIAL_ROW_KEY_SQL, table, trial_row_key, trials

TRIALS = list(range(1, 8))
NUM_FEATURES = {"quantity": "l_quantity", "extendedprice": "l_extendedprice",
                "discount": "l_discount", "tax": "l_tax"}
FLAG_DOMAIN = ["A", "N", "R"]
# stand-in for the good/bad quality text: finished line = good
STATUS_MAP = {"F": 1, "O": 0}
THRESHOLD, BUFFER = 4500.0, 800.0

_ORD_SQL = TRIAL_ROW_KEY_SQL


def wide_sessions(spark, sf):
    t = trials(spark, sf, "l_returnflag", "l_linestatus")
    feats = {k: F.col(v) for k, v in NUM_FEATURES.items()}
    feats["status"] = clean.map_values("l_linestatus", STATUS_MAP).cast("int")
    return wide.pivot_first(
        t, "l_orderkey", "l_linenumber", TRIALS, feats, trial_row_key(),
        codes={"flag": ("l_returnflag", FLAG_DOMAIN)},
        session_first={"first_tax": F.col("l_tax"),
                       "first_status": clean.map_values("l_linestatus", STATUS_MAP).cast("int")},
    )


def session_scores(spark, sf):
    """(session_id, subject_id, score, label) for completed orders."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").where(
        F.col("o_orderstatus") == "F")
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal")
    s = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("c_acctbal").alias("score"),
    )
    s = clean.dedupe_first(s, "session_id", ["subject_id", "score"])
    return s.withColumn("label", (F.col("score") >= THRESHOLD).cast("int"))


def labelled_sessions(spark, sf):
    """Slice 0: wide rows <- left join scores -> band exclusion (nulls kept)."""
    w = wide_sessions(spark, sf)
    j = w.join(session_scores(spark, sf), "session_id", "left")
    return clean.band_exclude(j, "score", THRESHOLD, BUFFER)


# ------------------------------------------------------------------ SQL
def _wide_sql() -> str:
    sel = ["l_orderkey AS session_id"]
    for t in TRIALS:
        for f, c in NUM_FEATURES.items():
            sel.append(f"max(CASE WHEN l_linenumber = {t} AND rn = 1 THEN {c} END) AS trial{t}_{f}")
        sel.append(f"max(CASE WHEN l_linenumber = {t} AND rn = 1 THEN status END) AS trial{t}_status")
        sel.append(f"max(CASE WHEN l_linenumber = {t} AND rn = 1 THEN code END) AS trial{t}_flag")
    sel.append("max(CASE WHEN pos = 1 THEN l_tax END) AS first_tax")
    sel.append("max(CASE WHEN pos = 1 THEN status END) AS first_status")
    return f"""
WITH t AS (
  SELECT *,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORD_SQL}) AS rn,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORD_SQL}) AS pos,
    CAST(CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS INTEGER) AS status
  FROM lineitem),
fs AS (SELECT l_orderkey, l_returnflag, min(pos) AS fp FROM t GROUP BY 1, 2),
cd AS (SELECT l_orderkey, l_returnflag,
         CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY fp) - 1 AS INTEGER) AS code FROM fs),
x AS (SELECT t.*, cd.code FROM t JOIN cd USING (l_orderkey, l_returnflag))
SELECT {", ".join(sel)} FROM x GROUP BY l_orderkey"""


WIDE_SQL = _wide_sql()
SCORES_SQL = f"""
SELECT o_orderkey AS session_id, min(o_custkey) AS subject_id, min(c_acctbal) AS score,
       CAST(min(c_acctbal) >= {THRESHOLD} AS INTEGER) AS label
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY o_orderkey"""
LABELLED_SQL = f"""
WITH w AS ({WIDE_SQL}), s AS ({SCORES_SQL})
SELECT w.*, s.subject_id, s.score, s.label FROM w LEFT JOIN s USING (session_id)
WHERE NOT coalesce(s.score BETWEEN {THRESHOLD - BUFFER} AND {THRESHOLD + BUFFER}, false)"""


@register("session_wide_features", WIDE_SQL)
def q_session_wide_features(spark, sf):
    return wide.reorder_ids_first(wide_sessions(spark, sf), ["session_id"])


def _onehot_sql() -> str:
    sel = ["l_orderkey AS session_id"]
    for t in TRIALS:
        for v in FLAG_DOMAIN:
            sel.append(f"max(CASE WHEN l_linenumber = {t} AND rn = 1 THEN CAST(l_returnflag = '{v}' AS INTEGER) END)"
                       f" AS trial{t}_returnflag_{v}")
    return f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORD_SQL}) AS rn
           FROM lineitem)
SELECT {", ".join(sel)} FROM t GROUP BY l_orderkey"""


@register("session_wide_onehot", _onehot_sql())
def q_session_wide_onehot(spark, sf):
    t = trials(spark, sf, "l_returnflag")
    return wide.pivot_onehot(t, "l_orderkey", "l_linenumber", TRIALS, "l_returnflag",
                             FLAG_DOMAIN, trial_row_key(), feature="returnflag")


@register("session_first_seen_codes", f"""
WITH f AS (SELECT l_orderkey, l_returnflag, min({TRIAL_ROW_KEY_SQL}) AS fo FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag,
       CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY fo) - 1 AS INTEGER) AS code
FROM f""")
def q_session_first_seen_codes(spark, sf):
    t = trials(spark, sf, "l_returnflag")
    return wide.first_seen_codes(t, "l_orderkey", "l_returnflag", trial_row_key())


@register("missing_trials", """
WITH s AS (SELECT l_orderkey AS session_id, list(DISTINCT l_linenumber) AS have
           FROM lineitem GROUP BY 1)
SELECT session_id, CAST(d.trial AS INTEGER) AS trial
FROM s, (SELECT unnest(range(1, 8)) AS trial) d
WHERE NOT list_contains(have, CAST(d.trial AS INTEGER))""")
def q_missing_trials(spark, sf):
    t = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    return wide.missing_trials(t, "l_orderkey", "l_linenumber", TRIALS)


@register("label_join_report", f"""
WITH w AS (SELECT DISTINCT l_orderkey AS session_id FROM lineitem), s AS ({SCORES_SQL})
SELECT count(*) AS n_rows, count(s.score) AS n_matched,
       CAST(sum(CASE WHEN s.score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched
FROM w LEFT JOIN s USING (session_id)""")
def q_label_join_report(spark, sf):
    w = table(spark, sf, "lineitem", "l_orderkey").select(
        F.col("l_orderkey").alias("session_id")).distinct()
    return clean.label_join_report(w, session_scores(spark, sf), "session_id", "score")


@register("band_exclusion", f"""
WITH l AS ({LABELLED_SQL})
SELECT session_id, subject_id, score, label, trial1_quantity, first_status FROM l""")
def q_band_exclusion(spark, sf):
    return labelled_sessions(spark, sf).select(
        "session_id", "subject_id", "score", "label", "trial1_quantity", "first_status")


@register("class_balance", f"""
WITH l AS ({LABELLED_SQL}),
p AS (SELECT subject_id, arg_min(label, session_id) AS label FROM l
      WHERE subject_id IS NOT NULL GROUP BY subject_id)
SELECT label, count(*) AS n FROM p WHERE label IS NOT NULL GROUP BY label""")
def q_class_balance(spark, sf):
    l = labelled_sessions(spark, sf).where(F.col("subject_id").isNotNull())
    return summary.class_balance(l, "subject_id", "label", ["session_id"])


@register("label_distribution", f"""
WITH l AS ({LABELLED_SQL})
SELECT label, count(*) AS n FROM (SELECT DISTINCT session_id, label FROM l) GROUP BY label""")
def q_label_distribution(spark, sf):
    return summary.class_balance(labelled_sessions(spark, sf), "session_id", "label",
                                 ["session_id"], dropna=False)


@register("dataset_stats", f"""
WITH l AS ({LABELLED_SQL} AND s.subject_id IS NOT NULL),
p AS (SELECT subject_id, arg_min(label, session_id) AS label FROM l GROUP BY subject_id)
SELECT 'n_subjects' AS stat, count(DISTINCT subject_id) AS value FROM l
UNION ALL SELECT 'n_sessions', count(DISTINCT session_id) FROM l
UNION ALL SELECT 'n_pos', count(*) FILTER (WHERE label = 1) FROM p
UNION ALL SELECT 'n_neg', count(*) FILTER (WHERE label = 0) FROM p""")
def q_dataset_stats(spark, sf):
    l = labelled_sessions(spark, sf).where(F.col("subject_id").isNotNull())
    return summary.dataset_stats(l, "subject_id", "session_id", "label", ["session_id"])


@register("three_way_session_intersection", """
WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
c AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT (SELECT count(*) FROM a) AS n_scores, (SELECT count(*) FROM b) AS n_frames,
       (SELECT count(*) FROM c) AS n_surveys,
       (SELECT count(*) FROM a JOIN b USING (k)) AS n_scores_frames,
       (SELECT count(*) FROM a JOIN c USING (k)) AS n_scores_surveys,
       (SELECT count(*) FROM a JOIN b USING (k) JOIN c USING (k)) AS n_all""")
def q_three_way(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return summary.intersection_report({
        "scores": o.where(F.col("o_orderstatus") == "F"),
        "frames": table(spark, sf, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey"),
        "surveys": o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
    }, "o_orderkey")
