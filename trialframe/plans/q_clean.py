"""Cleaning, names, scalar functions, joins and data-quality queries
(P*, F*, X*, J9-J15, Q1-Q10, A5 A20-A24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions import names, scalar
from trialframe.operators import clean, joins, quality, summary
from trialframe.plans.q_wide import wide_sessions, WIDE_SQL, labelled_sessions, LABELLED_SQL
from trialframe.plans.registry import register
from trialframe.sources.tables import frames, table

R6 = 6


@register("incremental_keys", """
SELECT d.doc_id, d.source, d.n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_incremental_keys(spark, sf):
    """Documents not processed yet (no label row)."""
    docs = table(spark, sf, "documents", "doc_id", "source", "n_chars")
    done = table(spark, sf, "labels", "doc_id")
    return joins.not_yet_processed(docs, done, ["doc_id"])


# stand-in rule chain over part names, same shape as the task normaliser:
# case-insensitive regex, exact map, then plain regexes
PART_RULES = [
    ("regex", r".*RING.*", "ring", True),
    ("map", {"red widget": "widget_red", "blue rod": "rod"}),
    ("regex", r".*widget.*", "widget", False),
    ("regex", r".*bolt.*", "bolt", False),
    ("regex", r".*gear.*", "gear", False),
    ("regex", r".*plate.*", "plate", False),
    ("regex", r".*GIZMO.*", "gizmo", True),
]
PART_WHITELIST = ["ring", "widget", "bolt", "gear", "plate", "rod"]


def _rules_sql(col: str, rules) -> str:
    out = col
    for r in rules:
        if r[0] == "regex":
            flag = "(?i)" if r[3] else ""
            out = f"regexp_replace({out}, '{flag}{r[1]}', '{r[2]}', 'g')"
        else:
            cases = " ".join(f"WHEN {out} = '{k}' THEN '{v}'" for k, v in r[1].items())
            out = f"(CASE {cases} ELSE {out} END)"
    return out


@register("task_name_normalise", f"""
SELECT p_partkey, p_name, {_rules_sql('p_name', PART_RULES)} AS name_renamed,
       CAST({_rules_sql('p_name', PART_RULES)} IN ({", ".join(repr(w) for w in PART_WHITELIST)}) AS INTEGER) AS known,
       {_rules_sql("lower(p_type)", names.TASK_RULES)} AS type_renamed
FROM part""")
def q_task_name_normalise(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    renamed = names.apply_rules("p_name", PART_RULES)
    return p.select(
        "p_partkey", "p_name", renamed.alias("name_renamed"),
        renamed.isin(PART_WHITELIST).cast("int").alias("known"),
        names.normalise_task(F.lower("p_type")).alias("type_renamed"),
    )


@register("unknown_task_names", f"""
SELECT {_rules_sql('p_name', PART_RULES)} AS name_renamed, count(*) AS n FROM part
WHERE {_rules_sql('p_name', PART_RULES)} NOT IN ({", ".join(repr(w) for w in PART_WHITELIST)})
GROUP BY 1""")
def q_unknown_task_names(spark, sf):
    """Q5: normalised names outside the whitelist, with counts."""
    p = table(spark, sf, "part", "p_name").select(names.apply_rules("p_name", PART_RULES).alias("name_renamed"))
    return quality.outside_whitelist(p, "name_renamed", PART_WHITELIST)


_HOST = "regexp_extract(url, '://([^/]+)', 1)"


@register("url_tokens", f"""
SELECT page_id,
  string_split(url, '/')[-1] AS base,
  lower(regexp_extract(string_split(url, '/')[-1], '\\.([^.]+)$', 1)) AS ext,
  CAST(lower(regexp_extract(string_split(url, '/')[-1], '\\.([^.]+)$', 1)) IN ('html', 'htm') AS INTEGER) AS is_html,
  {_HOST} AS host,
  array_to_string(string_split({_HOST}, '.')[1:greatest(len(string_split({_HOST}, '.')) - 2, 0)], '.') AS site,
  array_to_string(list_concat(
      string_split({_HOST}, '.')[1:greatest(len(string_split({_HOST}, '.')) - 2, 0)], ['www'],
      string_split({_HOST}, '.')[greatest(len(string_split({_HOST}, '.')) - 2, 0) + 1:]), '.') AS www_host,
  coalesce(TRY_CAST(nullif(regexp_extract(url, '([0-9]{{13}})', 1), '') AS BIGINT),
           TRY_CAST(nullif(regexp_extract(url, '([0-9]{{10}})', 1), '') AS BIGINT),
           CAST(0 AS BIGINT)) AS epoch,
  TRY_CAST(nullif(regexp_extract(url, '([0-9]+)fps', 1), '') AS INTEGER) AS fps,
  split_part(url, '/', 4) AS lang
FROM pages""")
def q_url_tokens(spark, sf):
    """X2 X4-X8 over page URLs."""
    p = table(spark, sf, "pages", "page_id", "url")
    host = F.regexp_extract("url", "://([^/]+)", 1)
    return p.select(
        "page_id",
        names.base_name("url").alias("base"),
        names.extension("url").alias("ext"),
        names.has_extension("url", ["HTML", ".htm"]).cast("int").alias("is_html"),
        host.alias("host"),
        names.drop_last_tokens(host, 2, ".", strip=False).alias("site"),
        names.insert_token(host, "www", 2, ".", strip=False).alias("www_host"),
        names.epoch_from_name("url").alias("epoch"),
        names.fps_from_name("url").alias("fps"),
        F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"),
    )


@register("json_flatten", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CAST(json_extract_string(props, '$.error') IS NOT NULL AS INTEGER) AS has_error,
  CASE WHEN json_extract_string(props, '$.error') IS NULL THEN 1 ELSE 0 END AS detected
FROM events""")
def q_json_flatten(spark, sf):
    """Nested path extraction with default null and an error branch."""
    e = table(spark, sf, "events", "event_id", "props")
    err = F.get_json_object("props", "$.error")
    return e.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        err.isNotNull().cast("int").alias("has_error"),
        F.when(err.isNull(), 1).otherwise(0).alias("detected"),
    )


_DEVICE_SQL = """concat('iPhone ', CAST(p_size AS VARCHAR),
  CASE p_type WHEN 'LARGE' THEN ' Pro Max' WHEN 'PROMO' THEN ' Pro' WHEN 'MEDIUM' THEN ' Plus' ELSE '' END)"""


def device_name():
    return F.concat(F.lit("iPhone "), F.col("p_size").cast("string"),
                    F.when(F.col("p_type") == "LARGE", " Pro Max").when(F.col("p_type") == "PROMO", " Pro")
                    .when(F.col("p_type") == "MEDIUM", " Plus").otherwise(""))


def _geom_sql(i: int) -> str:
    g = scalar.DEVICE_GEOMETRY
    iph = " OR ".join(f"contains(device, 'iPhone {n}')" for n in range(12, 17))
    return (f"CASE WHEN contains(device, '{g[0][0]}') THEN {g[0][i]} WHEN contains(device, '{g[1][0]}') THEN {g[1][i]} "
            f"WHEN contains(device, '{g[2][0]}') THEN {g[2][i]} WHEN {iph} THEN {g[3][i]} ELSE {g[4][i]} END")


@register("device_coordinates", f"""
WITH d AS (
  SELECT l_orderkey, l_linenumber, l_partkey, {_DEVICE_SQL} AS device,
         l_quantity * 8 AS x_pt, l_discount * 5000 AS y_pt
  FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT *, ({_geom_sql(1)} - ((x_pt * 3) / 460) * 2.54) - {_geom_sql(2)} AS x_true,
             ((y_pt * 3) / 460) * 2.54 - {_geom_sql(3)} AS y_true FROM d),
r AS (SELECT l_partkey, max(x_true) - min(x_true) AS x_range FROM t GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, device,
       round(-x_true + x_range, 6) AS x, round(y_true, 6) AS y
FROM t JOIN r USING (l_partkey)""")
def q_device_coordinates(spark, sf):
    """Device geometry, point -> cm conversion, x mirrored by
    the group's range (group = part, i.e. one device)."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    pt = table(spark, sf, "part", "p_partkey", "p_size", "p_type")
    d = li.join(pt, li.l_partkey == pt.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", device_name().alias("device"),
        (F.col("l_quantity") * 8).alias("x_pt"), (F.col("l_discount") * 5000).alias("y_pt"))
    x, y = scalar.true_position("x_pt", "y_pt", scalar.device_geometry("device"))
    d = d.withColumns({"x_true": x, "y_true": y})
    m = joins.mirror_by_group_range(d, "l_partkey", "x_true", "x")
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "device",
                    F.round("x", R6).alias("x"), F.round("y_true", R6).alias("y"))


@register("frame_filters", """
SELECT event_id, user_id, event_type, value FROM (
  SELECT event_id, user_id, event_type, props,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)
WHERE event_type IN ('view', 'click', 'purchase', 'signup', 'error')
  AND NOT coalesce(event_type IN ('error'), false)
  AND NOT contains(props, '"k": 9')
  AND nullif(value, 0.0) IS NOT NULL""")
def q_frame_filters(spark, sf):
    """F2 F5 F6 F7 F13 chained; all pushed into the scan where possible."""
    ev = frames(spark, sf, "props")
    ev = ev.where(F.col("event_type").isin("view", "click", "purchase", "signup", "error"))
    ev = clean.exclude_values(ev, "event_type", ["error"])
    ev = clean.exclude_substrings(ev, "props", ['"k": 9'])
    ev = ev.withColumn("value", clean.sentinel_to_null("value"))
    return clean.drop_missing(ev, ["value"]).select("event_id", "user_id", "event_type", "value")


def _null_report_sql() -> str:
    from trialframe.plans.q_wide import NUM_FEATURES, TRIALS

    cols = [f"trial{t}_{f}" for t in TRIALS for f in [*NUM_FEATURES, "status", "flag"]]
    parts = [f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, "
             f"round((count(*) - count({c})) / count(*), 6) AS null_share FROM w" for c in cols]
    return f"WITH w AS ({WIDE_SQL}) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE null_share > 0.5"


@register("null_report", _null_report_sql())
def q_null_report(spark, sf):
    """Per-column null count and share over the wide session table,
    only columns with more than half missing."""
    w = wide_sessions(spark, sf)
    cols = [c for c in w.columns if c.startswith("trial")]
    r = clean.columns_mostly_missing(w, cols, 0.5)
    return r.select(F.col("column").alias("column_name"), "null_count",
                    F.round("null_share", R6).alias("null_share"))


@register("trial_feature_summary", """
SELECT feature, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max,
       round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25,
       round(quantile_cont(v, 0.75), 6) AS q75, round(max(v) - min(v), 6) AS range
FROM (UNPIVOT (SELECT l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount,
                      l_tax AS tax FROM lineitem)
      ON quantity, extendedprice, discount, tax INTO NAME feature VALUE v)
GROUP BY feature""")
def q_trial_feature_summary(spark, sf):
    """Eight-number summary per feature, long form (one groupBy)."""
    li = table(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    long = li.select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    ).unpivot([], ["quantity", "extendedprice", "discount", "tax"], "feature", "v")
    s = summary.eight_number(long, ["feature"], "v", extra=[F.count("v").alias("n")])
    return s.select("feature", "n", *[F.round(c, R6).alias(c) if c in ("mean", "std", "median", "q25", "q75", "range")
                                 else F.col(c) for c in ["mean", "std", "min", "max", "median", "q25", "q75", "range"]])


@register("value_counts", """
SELECT l_returnflag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share
FROM lineitem GROUP BY 1""")
def q_value_counts(spark, sf):
    """A22."""
    v = summary.value_counts(table(spark, sf, "lineitem", "l_returnflag"), "l_returnflag")
    return v.withColumn("share", F.round("share", R6))


@register("majority_value", """
WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, arg_max(l_quantity, (n, -l_quantity)) AS mode FROM c GROUP BY 1""")
def q_majority_value(spark, sf):
    """Most frequent value per group, smallest on ties."""
    li = table(spark, sf, "lineitem", "l_returnflag", "l_quantity")
    return summary.mode_smallest(li, "l_quantity", ["l_returnflag"])


@register("target_stats", f"""
WITH l AS ({LABELLED_SQL})
SELECT round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS min,
       max(score) AS max, count(*) - count(score) AS n_missing FROM l""")
def q_target_stats(spark, sf):
    """A23 on the labelled wide table."""
    l = labelled_sessions(spark, sf)
    return l.agg(F.round(F.avg("score"), R6).alias("mean"), F.round(F.stddev_samp("score"), R6).alias("std"),
                 F.min("score").alias("min"), F.max("score").alias("max"),
                 F.count_if(F.col("score").isNull()).alias("n_missing"))


@register("group_consistency", """
SELECT l_orderkey AS group_id, count(DISTINCT l_linestatus) AS n_labels,
       count(DISTINCT l_suppkey) AS n_devices, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)) AS first_device
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1 OR count(DISTINCT l_suppkey) > 1""")
def q_group_consistency(spark, sf):
    """Q1/Q8: groups with more than one label or more than one device,
    with the device that the pipeline would use (first by order)."""
    from trialframe.sources.tables import TRIAL_ORDER

    li = table(spark, sf, "lineitem", "l_orderkey", "l_linestatus", "l_suppkey", "l_linenumber",
               "l_partkey", "l_shipdate", "l_quantity")
    return quality.group_consistency(li, "l_orderkey", "l_linestatus", "l_suppkey", TRIAL_ORDER)


@register("quality_checks", """
SELECT 'null_ts' AS check_name, count(*) FILTER (WHERE ts IS NULL) AS n_violations FROM events
UNION ALL SELECT 'null_user', count(*) FILTER (WHERE user_id IS NULL) FROM events
UNION ALL SELECT 'negative_value', count(*) FILTER (WHERE value < 0) FROM events
UNION ALL SELECT 'value_out_of_range', count(*) FILTER (WHERE NOT value BETWEEN 0 AND 500) FROM events
UNION ALL SELECT 'negative_event_id', count(*) FILTER (WHERE event_id < 0) FROM events""")
def q_quality_checks(spark, sf):
    """Named checks, one violation count each, one scan."""
    ev = table(spark, sf, "events", "event_id", "ts", "user_id", "value")
    return quality.run_checks(ev, {
        "null_ts": F.col("ts").isNull(),
        "null_user": F.col("user_id").isNull(),
        "negative_value": F.col("value") < 0,
        "value_out_of_range": ~F.col("value").between(0, 500),
        "negative_event_id": F.col("event_id") < 0,
    })


@register("join_null_check", f"""
WITH w AS ({WIDE_SQL}),
s AS (SELECT o_orderkey AS session_id, o_orderpriority FROM orders)
SELECT (SELECT count(*) - count(trial1_quantity) FROM w) AS nulls_before,
       (SELECT count(*) - count(trial1_quantity) FROM w LEFT JOIN s USING (session_id)) AS nulls_after,
       (SELECT count(*) - count(o_orderpriority) FROM w LEFT JOIN s USING (session_id)) AS new_col_nulls""")
def q_join_null_check(spark, sf):
    """Q4: a left join must not add nulls to existing columns."""
    w = wide_sessions(spark, sf).select("session_id", "trial1_quantity")
    s = table(spark, sf, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderkey", "session_id")
    return quality.join_adds_no_nulls(w, s, "session_id", ["trial1_quantity"], "o_orderpriority")
