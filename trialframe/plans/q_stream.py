"""Structured Streaming queries (R1, R2). Each call streams the events with
``availableNow`` into a fresh sink under ``spark.checkpoint.dir`` and returns
the batch read of that sink, so the result can be compared with the batch SQL
over the same table. R1 runs twice on one checkpoint, with new files between."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.plans.registry import register
from trialframe.sources.tables import table
from trialframe.streaming import ingest, stateful


def _events_schema(spark, sf):
    return spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").schema


@register("incremental_ingest", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS value_sum FROM events GROUP BY 1""")
def q_incremental_ingest(spark, sf):
    """New files of the source folder appended once to a sink. The events
    arrive in two drops; the second run on the same checkpoint takes up only
    what is new (a file read twice would double the counts)."""
    schema = _events_schema(spark, sf)
    source, sink, ck = (ingest.shared_path(spark, f"ingest-{x}") for x in ("source", "sink", "ckpt"))
    events = table(spark, sf, "events")
    for drop in (0, 1):
        events.where(F.coalesce(F.pmod("event_id", F.lit(2)), F.lit(0)) == drop).write.mode("append").parquet(source)
        ingest.ingest_new_files(spark, source, schema, sink, ck, max_files_per_trigger=64)
    out = ingest.read_sink(spark, sink, schema)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value_sum"))


@register("stateful_velocity", """
WITH f AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
           FROM events),
v AS (SELECT *, lag(value) OVER w AS pv, lag(epoch_us(ts)) OVER w AS pts FROM f WHERE value IS NOT NULL
      WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, user_id, event_type,
  round(CASE WHEN pts IS NOT NULL AND epoch_us(ts) - pts > 0 THEN (value - pv) / ((epoch_us(ts) - pts) / 1e6) ELSE 0.0 END, 6)
  AS velocity FROM v""")
def q_stateful_velocity(spark, sf):
    """R2: per-recording state carried across micro-batches."""
    schema = _events_schema(spark, sf)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(sf)
    stream = stream.withColumn(
        "value", F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")))
    sink, state, ck = (ingest.shared_path(spark, f"velocity-{x}") for x in ("sink", "state", "ckpt"))
    stateful.stateful_velocity(stream, sink, state, ck).awaitTermination()
    out = spark.read.schema(stateful.OUT_SCHEMA).parquet(f"{sink}/batch=*")
    return out.select("event_id", "user_id", "event_type", F.round("velocity", 6).alias("velocity"))
