"""Remaining joins, aggregates, sorts, set operations and scalar functions
(J1 J2 J4 J12 J15 P3 P11 A4 A13 A14 K1 K3 K4 K7 U4 U5 W18 X14 X18-X23 F14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions import names, scalar
from trialframe.operators import clean, joins, metrics, ordered, series
from trialframe.plans.q_series import F_SQL, ORDER, REC, chunk, chunked
from trialframe.plans.q_wide import SCORES_SQL, session_scores
from trialframe.plans.registry import register
from trialframe.sources.tables import frames, table

R6 = 6


@register("second_score_join", f"""
WITH s AS ({SCORES_SQL}),
r AS (SELECT o_orderkey AS session_id, floor(o_totalprice) / 1000 AS score2 FROM orders
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT session_id, score, round(score2, 6) AS score2, round(score + score2, 6) AS score_sum,
       round(score * score2, 6) AS score_product FROM s LEFT JOIN r USING (session_id)""")
def q_second_score(spark, sf):
    """Primary scores <- left join a second instrument; sum and
    product are null when either side is missing."""
    s = session_scores(spark, sf).select("session_id", "score")
    r = table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderpriority").where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        F.col("o_orderkey").alias("session_id"), (F.floor("o_totalprice") / 1000).alias("score2"))
    j = s.join(r, "session_id", "left")
    return j.select("session_id", "score", F.round("score2", R6).alias("score2"),
                    F.round(F.col("score") + F.col("score2"), R6).alias("score_sum"),
                    F.round(F.col("score") * F.col("score2"), R6).alias("score_product"))


@register("frames_with_device", """
WITH d AS (SELECT DISTINCT o_orderkey, o_orderpriority AS device FROM orders)
SELECT device, count(*) AS n_frames, count(DISTINCT l_orderkey) AS n_sessions
FROM lineitem JOIN d ON l_orderkey = o_orderkey GROUP BY device""")
def q_frames_with_device(spark, sf):
    """Device per session de-duplicated AFTER projecting the two
    needed columns (a DISTINCT over all columns first would let duplicate
    keys fan the frames out), then joined to the frames."""
    d = table(spark, sf, "orders", "o_orderkey", "o_orderpriority").select(
        "o_orderkey", F.col("o_orderpriority").alias("device")).distinct()
    li = table(spark, sf, "lineitem", "l_orderkey")
    j = li.join(d, li.l_orderkey == d.o_orderkey)
    return j.groupBy("device").agg(F.count(F.lit(1)).alias("n_frames"),
                                   F.count_distinct("l_orderkey").alias("n_sessions"))


@register("composite_key_join", f"""
WITH {F_SQL},
g AS (SELECT user_id, event_type, avg(value) AS rec_mean FROM f GROUP BY 1, 2)
SELECT event_id, round(value - rec_mean, 6) AS deviation, round(rec_mean, 6) AS rec_mean
FROM f LEFT JOIN g USING (user_id, event_type)""")
def q_composite_key_join(spark, sf):
    """Rows <- left join per-(recording, task) statistics on a
    composite key."""
    fr = frames(spark, sf)
    g = fr.groupBy(*REC).agg(F.avg("value").alias("rec_mean"))
    j = joins.attach(fr, g, REC, "left")
    return j.select("event_id", F.round(F.col("value") - F.col("rec_mean"), R6).alias("deviation"),
                    F.round("rec_mean", R6).alias("rec_mean"))


@register("lookup_last_wins", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value
FROM events GROUP BY user_id""")
def q_lookup_last_wins(spark, sf):
    """Key -> values of its last row (dict(zip) semantics)."""
    ev = table(spark, sf, "events", "user_id", "event_type", "value", "ts", "event_id")
    r = joins.last_value_lookup(ev, "user_id", ["event_type", "value"], ORDER)
    return r.select("user_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))


@register("partial_update", f"""
WITH {F_SQL},
o AS (SELECT event_id, value AS v2 FROM events WHERE event_type <> 'error')
SELECT event_id, coalesce(f.value, o.v2) AS value FROM f LEFT JOIN o USING (event_id)""")
def q_partial_update(spark, sf):
    """Fill only the missing cells from another frame, keyed."""
    fr = frames(spark, sf).select("event_id", "value")
    other = table(spark, sf, "events", "event_id", "value", "event_type").where(F.col("event_type") != "error")
    return joins.fill_missing_from(fr, other.select("event_id", "value"), ["event_id"], ["value"])


@register("grouped_mean", """
SELECT l_suppkey, round(avg(l_quantity), 6) AS avg_l_quantity, round(avg(l_extendedprice), 6) AS avg_l_extendedprice,
       round(avg(l_discount), 6) AS avg_l_discount FROM lineitem GROUP BY 1""")
def q_grouped_mean(spark, sf):
    """A4 + P3: grouped means renamed with an ``avg_`` prefix."""
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    g = table(spark, sf, "lineitem", "l_suppkey", *cols).groupBy("l_suppkey").avg(*cols)
    g = g.withColumnsRenamed({f"avg({c})": f"avg_{c}" for c in cols})
    return g.select("l_suppkey", *[F.round(f"avg_{c}", R6).alias(f"avg_{c}") for c in cols])


@register("singleton_unique", """
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag,
       count(DISTINCT l_returnflag) AS n_distinct FROM lineitem GROUP BY 1""")
def q_singleton_unique(spark, sf):
    """The group's value when it has exactly one, else null."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag")
    return li.groupBy("l_orderkey").agg(
        F.when(F.count_distinct("l_returnflag") == 1, F.min("l_returnflag")).alias("flag"),
        F.count_distinct("l_returnflag").alias("n_distinct"))


@register("distinct_pairs", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_distinct_pairs(spark, sf):
    """SELECT DISTINCT after projection."""
    return table(spark, sf, "lineitem", "l_returnflag", "l_linestatus").distinct()


@register("top_accounts", """
SELECT c_custkey, c_acctbal, rank FROM (
  SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
WHERE rank <= 10""")
def q_top_accounts(spark, sf):
    """K1 K3 K4: top-10 report (the limit is the feature)."""
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal")
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    return metrics.top_k(top, [], [F.desc("c_acctbal"), F.asc("c_custkey")], 10).select(
        "c_custkey", "c_acctbal", F.col("rank").cast("long").alias("rank"))


@register("first_page_per_site", """
WITH p AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, split_part(url, '/', 4) AS lang, url,
      coalesce(TRY_CAST(nullif(regexp_extract(url, '([0-9]{13})', 1), '') AS BIGINT),
               TRY_CAST(nullif(regexp_extract(url, '([0-9]{10})', 1), '') AS BIGINT), 0) AS epoch
      FROM pages)
SELECT host, lang, arg_min(url, (epoch, url)) AS url, count(*) AS n_pages FROM p GROUP BY 1, 2""")
def q_first_page(spark, sf):
    """K7: first item per (site, kind) by embedded epoch, then name."""
    p = table(spark, sf, "pages", "url").select(
        F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"),
        "url", names.epoch_from_name("url").alias("epoch"))
    return p.groupBy("host", "lang").agg(F.min_by("url", F.struct("epoch", "url")).alias("url"),
                                         F.count(F.lit(1)).alias("n_pages"))


# (type, kind, text): the earliest page with a number, a fixed name, the first that is listed
PAGE_RULES = [("english", "earliest", "/en/"), ("seventeen", "listed", "/17"), ("feed", "listed", "utm_source=feed")]
_PAGE_RULES_SQL = " UNION ALL ".join(
    f"SELECT site, '{t}' AS type, arg_min(url, ({'number' if k == 'earliest' else '0'}, url)) AS url FROM p WHERE contains(url, '{x}') GROUP BY site" for t, k, x in PAGE_RULES)


@register("first_page_by_type", f"""
WITH p AS (SELECT regexp_extract(url, '[.]([a-z]+)/', 1) AS site, url, coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT), 0) AS number FROM pages)
{_PAGE_RULES_SQL}""")
def q_first_by_type(spark, sf):
    """K7: the first page of each site and type, each type by its own rule."""
    p = table(spark, sf, "pages", "url").select(F.regexp_extract("url", "[.]([a-z]+)/", 1).alias("site"), "url")
    at = F.coalesce(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long"), F.lit(0))
    return clean.first_per_type(p, ["site"], "url", at, PAGE_RULES)


@register("pending_recordings", """
WITH c AS (SELECT page_id, regexp_replace(string_split(url, '?')[1], '.*/', '') || '.mp4' AS name FROM pages),
done AS (SELECT DISTINCT name FROM c JOIN labels ON page_id = doc_id)
SELECT page_id, name FROM c WHERE name NOT IN (SELECT name FROM done)""")
def q_pending(spark, sf):
    """Recordings without an output file named after them (labelled pages
    stand for those that were analysed)."""
    page = table(spark, sf, "pages", "page_id", "url")
    c = page.select("page_id", F.concat(names.base_name(F.split_part("url", F.lit("?"), F.lit(1))), F.lit(".mp4")).alias("name"))
    done = c.join(table(spark, sf, "labels", "doc_id"), F.col("page_id") == F.col("doc_id"))
    outputs = done.select(F.concat(F.lit("out/"), names.strip_ext("name"), F.lit("_analysis_"), F.col("page_id").cast("string"), F.lit(".csv")).alias("path"))
    return joins.without_output(c, "name", outputs, "path")


@register("union_by_name", """
WITH a AS (SELECT l_orderkey, l_quantity, NULL::DOUBLE AS l_tax FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT l_orderkey, NULL::DOUBLE AS l_quantity, l_tax FROM lineitem WHERE l_returnflag <> 'R'),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT count(*) AS n_rows, count(l_quantity) AS n_quantity, count(l_tax) AS n_tax FROM u""")
def q_union_by_name(spark, sf):
    """U4: union by name of frames whose columns differ."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_quantity", "l_tax", "l_returnflag")
    a = li.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_quantity")
    b = li.where(F.col("l_returnflag") != "R").select("l_orderkey", "l_tax")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.agg(F.count(F.lit(1)).alias("n_rows"), F.count("l_quantity").alias("n_quantity"),
                 F.count("l_tax").alias("n_tax"))


@register("subset_check", """
WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS vals FROM lineitem GROUP BY 1)
SELECT CAST(len(list_filter(vals, lambda v: v NOT IN ('A', 'R'))) = 0 AS INTEGER) AS is_subset, count(*) AS n
FROM s GROUP BY 1""")
def q_subset_check(spark, sf):
    """Is each session's value set a subset of an allowed set."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag")
    s = li.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("vals"))  # bounded by the domain
    flag = (F.size(F.array_except("vals", F.array(F.lit("A"), F.lit("R")))) == 0).cast("int")
    return s.groupBy(flag.alias("is_subset")).agg(F.count(F.lit(1)).alias("n"))


@register("blink_mask", f"""
WITH {F_SQL},
p AS (SELECT *, avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3,
        count(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3 FROM f),
d AS (SELECT *, CASE WHEN c3 = 3 THEN abs(value - r3) END AS dev FROM p),
m AS (SELECT *, dev / nullif(max(dev) OVER (PARTITION BY user_id, event_type), 0) AS dev_norm FROM d)
SELECT event_id, round(dev_norm, 6) AS dev_norm, CAST(coalesce(dev_norm > 0.5, false) AS INTEGER) AS blink FROM m""")
def q_blink_mask(spark, sf):
    """Trailing rolling(3) mean, absolute deviation, normalised by the
    recording's largest deviation, masked above 0.5."""
    d = ordered.scan(chunked(frames(spark, sf)), REC, ORDER, chunk(), pos="pos")
    r = series.rolling(d, REC, "pos", -2, 0, {"r3": F.avg("value"), "c3": F.count("value")})
    r = r.withColumn("dev", F.when(F.col("c3") == 3, F.abs(F.col("value") - F.col("r3"))))
    mx = r.groupBy(*REC).agg(F.max("dev").alias("_mx"))
    r = joins.attach(r, mx, REC, "inner").withColumn("dev_norm", F.try_divide(F.col("dev"), F.nullif("_mx", F.lit(0.0))))
    return r.select("event_id", F.round("dev_norm", R6).alias("dev_norm"),
                    F.coalesce(F.col("dev_norm") > 0.5, F.lit(False)).cast("int").alias("blink"))


@register("bbox_share", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(list_max(v[1:32]) - list_min(v[1:32]), 6) AS bbox_width,
       round(list_max(v[33:64]) - list_min(v[33:64]), 6) AS bbox_height,
       round((list_max(v[1:32]) - list_min(v[1:32])) * (list_max(v[33:64]) - list_min(v[33:64])) / (2.0 * 2.0) * 100, 6)
         AS percentage FROM e""")
def q_bbox(spark, sf):
    """Box around a point list (x = first 32 values, y = last 32)."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    b = scalar.bbox(F.slice("v", 1, 32), F.slice("v", 33, 32), 2.0, 2.0)
    return e.select("vec_id", F.round(b["bbox_width"], R6).alias("bbox_width"),
                    F.round(b["bbox_height"], R6).alias("bbox_height"), F.round(b["percentage"], R6).alias("percentage"))


@register("share_renormalise", """
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN l_discount * 10 + l_tax * 10 > 1 THEN l_discount * 10 / (l_discount * 10 + l_tax * 10) ELSE l_discount * 10 END, 6) AS top,
  round(CASE WHEN l_discount * 10 + l_tax * 10 > 1 THEN l_tax * 10 / (l_discount * 10 + l_tax * 10) ELSE l_tax * 10 END, 6) AS bottom,
  round(least(greatest(l_quantity / 10 - 2, -1), 1), 6) AS clipped,
  round(coalesce(l_tax / nullif(l_discount, 0), 0), 6) AS ratio,
  concat(CAST(l_orderkey AS VARCHAR), '_', CAST(l_linenumber AS VARCHAR), '.parquet') AS file_name
FROM lineitem""")
def q_share_renormalise(spark, sf):
    """Renormalise two shares, clip, zero-guarded ratio,
    template-filled names."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    a, b = scalar.renormalise_pair(F.col("l_discount") * 10, F.col("l_tax") * 10)
    return li.select(
        "l_orderkey", "l_linenumber", F.round(a, R6).alias("top"), F.round(b, R6).alias("bottom"),
        F.round(scalar.clip(F.col("l_quantity") / 10 - 2, -1.0, 1.0), R6).alias("clipped"),
        F.round(scalar.safe_ratio("l_tax", "l_discount"), R6).alias("ratio"),
        names.fill_template("{session_id}_{trial}.parquet", session_id="l_orderkey", trial="l_linenumber")
        .alias("file_name"))


@register("latest_run_of_kind", """
SELECT source, arg_max(doc_id, doc_id) AS doc_id, count(*) AS n FROM documents
WHERE contains(source, 'src1') AND lang = 'en' GROUP BY source""")
def q_latest_run(spark, sf):
    """Newest item of a kind (name contains a token, kind filter)."""
    d = table(spark, sf, "documents", "doc_id", "source", "lang").where(
        F.col("source").contains("src1") & (F.col("lang") == "en"))
    return d.groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


_REC_NAME = """'v_' || CASE o_orderkey % 5 WHEN 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 13, '1')
    WHEN 1 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '2') WHEN 2 THEN lpad(CAST(o_orderkey AS VARCHAR), 14, '3')
    WHEN 3 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '4') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 13, '5')
    ELSE 'x' END || '_' || CAST(o_custkey % 90 AS VARCHAR) || CASE WHEN o_custkey % 2 = 0 THEN 'fps' ELSE 'hz' END || '.mp4'"""


@register("recording_epochs", f"""
WITH n AS (SELECT o_orderkey, {_REC_NAME} AS name FROM orders)
SELECT o_orderkey, name, coalesce(TRY_CAST(nullif(regexp_extract(name, '[0-9]{{13}}'), '') AS BIGINT),
    TRY_CAST(nullif(regexp_extract(name, '[0-9]{{10}}'), '') AS BIGINT), 0) AS epoch,
  TRY_CAST(nullif(regexp_extract(name, '([0-9]+)fps', 1), '') AS INTEGER) AS fps FROM n""")
def q_recording_epochs(spark, sf):
    """X6 X7 on names with runs of 10, 13 and 14 digits, both or none."""
    key = F.col("o_orderkey").cast("string")
    run = F.element_at(F.array(
        F.lpad(key, 13, "1"), F.lpad(key, 10, "2"), F.lpad(key, 14, "3"),
        F.concat(F.lpad(key, 10, "4"), F.lit("_"), F.lpad(key, 13, "5")), F.lit("x"),
    ), (F.col("o_orderkey") % 5 + 1).cast("int"))
    unit = F.when(F.col("o_custkey") % 2 == 0, "fps").otherwise("hz")
    name = F.concat(F.lit("v_"), run, F.lit("_"), (F.col("o_custkey") % 90).cast("string"), unit, F.lit(".mp4"))
    n = table(spark, sf, "orders", "o_orderkey", "o_custkey").select("o_orderkey", name.alias("name"))
    return n.withColumns({"epoch": names.epoch_from_name("name"), "fps": names.fps_from_name("name")})
