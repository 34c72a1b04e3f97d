"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.helpers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# fixed values: the rules of the contract
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import url_reputation

    # the label of the document with a page's id stands for the page's outcome
    outcomes = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


@register
def op6_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import rules_llr

    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rules_llr.judge(table(spark, sf_dir, "documents"), trusted)


@register
def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import mixing

    return mixing.replicate(table(spark, sf_dir, "documents"))


@register
def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import minmax_dedup

    return minmax_dedup.find(table(spark, sf_dir, "documents"))


ORACLE["op4_minmax_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept FROM s JOIN c USING (doc_id)
"""


@register
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import substring_dedup

    return substring_dedup.remove(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE["op9_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS g FROM w, unnest(range(1, len(ws) - 18)) AS r(s)
), late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, s + o AS p FROM late, unnest(range(0, 20)) AS r(o)),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS r(p)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@register
def op10_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import pu_quality
    from trialframe.llm.helpers import held_out

    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id")
    return pu_quality.score(docs, trusted).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@register
def op1_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import toxicity
    from trialframe.llm.helpers import held_out

    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("restored").cast("long").alias("n_restored"),
    )


@register
def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import decontaminate

    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.concat_ws(",", "items"))


ORACLE["op2_template_decontamination"] = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark
), canon AS (
  SELECT kind, id,
    regexp_extract_all(translate(regexp_replace(lower(regexp_replace(regexp_replace(text, '([\p{Ll},;] )\p{Lu}\p{L}*', '\1<name>', 'g'),
      '[0-9]+([.,][0-9]+)*', '<num>', 'g')), '<num>( ?)(kmh|km|kg|cm|mm|ml|min|mph|m|g|l|s|h|usd|eur)\b', '<num>\1<unit>', 'g'),
      '.,;:!?"()[]', ''), '[^\x20\x09-\x0D]+') AS t,
    regexp_extract_all(translate(text, '.,;:!?"()[]', ''), '[^\x20\x09-\x0D]+') AS v
  FROM texts
), win AS (
  SELECT kind, id, p, array_to_string(t[p:p + 7], ' ') AS w,
    len(list_filter(t[p:p + 7], lambda x: NOT (contains(x, '<num>') OR contains(x, '<name>')))) AS literal
  FROM canon, unnest(range(1, len(t) - 6)) AS r(p)
), b AS (SELECT id AS item, p AS bpos, w FROM win WHERE kind = 'b' AND literal >= 5),
need AS (SELECT item, count(*) AS of_item FROM b GROUP BY item),
run AS (
  SELECT d.id AS doc_id, b.item, d.p - b.bpos AS diagonal, min(d.p) AS first, max(d.p) AS last, count(DISTINCT d.p) AS windows
  FROM win d JOIN b ON d.w = b.w WHERE d.kind = 'd' GROUP BY ALL
), long AS (SELECT run.* FROM run JOIN need USING (item) WHERE windows >= least(6, of_item)),
pairs AS (
  SELECT l.doc_id, l.item, l.diagonal, x.v[p - l.diagonal] AS bv, y.v[p] AS dv
  FROM long l JOIN canon x ON x.kind = 'b' AND x.id = l.item JOIN canon y ON y.kind = 'd' AND y.id = l.doc_id,
    unnest(range(l.first, l.last + 8)) AS r(p)
  WHERE contains(x.t[p - l.diagonal], '<num>') OR contains(x.t[p - l.diagonal], '<name>')
), bad AS (
  SELECT doc_id, item, diagonal FROM pairs GROUP BY ALL HAVING count(DISTINCT bv) <> count(DISTINCT (bv, dv))
), hit AS (
  SELECT doc_id, max(windows) AS n_windows, array_to_string(list_sort(list(DISTINCT item)), ',') AS items
  FROM long ANTI JOIN bad USING (doc_id, item, diagonal) GROUP BY doc_id
)
SELECT d.doc_id, n_windows IS NOT NULL AS contaminated, coalesce(n_windows, 0) AS n_windows, coalesce(items, '') AS items
FROM documents d LEFT JOIN hit USING (doc_id)
"""


@register
def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import pii

    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shrunk_sql(level: str) -> str:
    """Posterior mean and prior strength of each row of a level (n, k, m)."""
    return f"""
  SELECT t.*, 1.0 / rho - 1 AS strength, round((k + (1.0 / rho - 1) * m) / (n + (1.0 / rho - 1)), 9) AS mean
  FROM {level} t, (
    SELECT round(greatest(1e-4, least(0.99, coalesce(
      (sum(n * pow(k / nullif(n, 0) - m, 2)) FILTER (n > 0) - sum(m * (1 - m)) FILTER (n > 0))
      / nullif(sum((n - 1) * (m * (1 - m))) FILTER (n > 0), 0.0), 0.0))), 6) AS rho FROM {level})"""


ORACLE["op3_url_reputation"] = rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), worst AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels GROUP BY doc_id),
h0 AS (
  SELECT host, count(*) AS n_pages, count(good) AS n, coalesce(sum(good), 0) AS k FROM p LEFT JOIN worst USING (page_id) GROUP BY host
), h AS (
  SELECT *, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
    string_split(host, '.')[-1] AS suffix FROM h0
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT round((sum(k) + 1) / (sum(n) + 2), 9) FROM h) AS m FROM h GROUP BY suffix
), s1 AS ({_shrunk_sql("s0")}),
d0 AS (SELECT domain, h.suffix, sum(h.n) AS n, sum(h.k) AS k, any_value(s1.mean) AS m FROM h JOIN s1 USING (suffix) GROUP BY domain, h.suffix),
d1 AS ({_shrunk_sql("d0")}),
g0 AS (SELECT h.*, d1.mean AS m FROM h JOIN d1 ON h.domain = d1.domain AND h.suffix = d1.suffix),
g1 AS ({_shrunk_sql("g0")}),
host AS (SELECT host, mean, round(mean - 1.645 * sqrt(mean * (1 - mean) / (n + strength + 1)), 6) AS bound FROM g1),
j AS (
  SELECT p.*, mean, bound, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN host USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound >= 0.6 THEN 'allow' ELSE 'block' END AS verdict, mean AS good_mean, bound AS good_bound FROM j
"""

# for rates up to mixing.PART, as they are with equal shares here
ORACLE["op7_poisson_mixing"] = r"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rate AS (
  SELECT source, round((1.0::DOUBLE * (1.0::DOUBLE / (SELECT count(*) FROM c)) * (SELECT sum(n) FROM c)::DOUBLE) / n, 9) AS m FROM c
), cdf(source, m, i, p, s) AS (
  SELECT source, m, 0, exp(-m), exp(-m) FROM rate
  UNION ALL SELECT source, m, i + 1, p * m / (i + 1), s + p * m / (i + 1) FROM cdf WHERE i < ceil(m + 12 * sqrt(m) + 24)
), u AS (
  SELECT d.*, CAST('0x' || substr(md5(doc_id || ':1:mix'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents d
), drawn AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, cdf.m, count(*) AS copies
  FROM u JOIN cdf ON u.source = cdf.source AND round(cdf.s, 12) <= u.u GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, m AS mix_rate, copy_no,
  CAST('0x' || substr(md5(doc_id || ':' || copy_no || ':mix:order'), 1, 15) AS BIGINT) AS shuffle_key
FROM drawn, unnest(range(1, copies + 1)) AS r(copy_no)
"""


@register
def op11_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import simhash_bktree

    return simhash_bktree.find(table(spark, sf_dir, "documents"))


@register
def op12_angular_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import hard_negatives

    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, vec_id % 100 == 0)


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE["op12_angular_hard_negatives"] = f"""
WITH r AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}
), k AS (SELECT * FROM r WHERE label IS NOT NULL),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), negatives AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


@register
def op13_laesa_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trialframe.llm import pivot_codes

    return pivot_codes.encode(table(spark, sf_dir, "embeddings")).drop("label")


def _rounds_sql(rounds: int) -> str:
    """Codebooks b0..b<rounds> (part, entry, c) and assignments a0..a<rounds> (vec_id, part, entry, d)."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT x.vec_id, x.part, b.entry, CAST(list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM x JOIN b{k} b USING (part)) GROUP BY vec_id, part
)""")
        if k < rounds:
            out.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(u.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT x.part, a.entry, i, sum(x.c[i]) AS s, count(*) AS n FROM x JOIN a{k} a USING (vec_id, part), unnest(range(1, 17)) AS r(i) GROUP BY ALL
    ) GROUP BY part, entry
  ) u USING (part, entry)
)""")
    return ",\n".join(out)


ORACLE["op13_laesa_vector_codes"] = f"""
WITH q AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {_FINITE}
), x AS MATERIALIZED (SELECT vec_id, part, q[16 * part + 1:16 * part + 16] AS c FROM q, unnest(range(0, 4)) AS r(part)),
b0 AS MATERIALIZED (
  SELECT part, e.entry, x.c FROM x JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM q ORDER BY vec_id LIMIT 256
  ) e USING (vec_id)
),
{_rounds_sql(4)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (
    SELECT part, entry, i, c[i] AS v FROM b4, unnest(range(1, 17)) AS r(i)
  )
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN q USING (vec_id), digest
"""
