"""R2: carry the previous valid frame of each recording across micro-batches,
giving the same velocities as the batch lag operator (W5) when frames arrive
in order.

Within a micro-batch the previous frame is a lag; the first frame of a recording
follows the last one of the batches before, which is the state: previous value
and previous timestamp (micros). Each micro-batch writes the last frames of its
recordings as one folder of the state, every COMPACT-th those of all recordings,
so a batch reads COMPACT folders at most. Rows and state of a micro-batch
overwrite the folder of its number, so one that runs again writes the same.

A frame older than the state gives dt <= 0 -> velocity 0, and the state still
moves to it (the reference's analyser behaves the same way).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trialframe.operators.joins import attach
from trialframe.operators.ordered import epoch_micros

OUT_SCHEMA = "event_id long, user_id long, event_type string, velocity double"
STATE_SCHEMA = "user_id long, event_type string, prev_value double, prev_ts long, batch long"
REC = ["user_id", "event_type"]
COMPACT = 10


def valid_frames(frames: DataFrame) -> DataFrame:
    """Valid frames only (value not null), with their time in micros."""
    return frames.where(F.col("value").isNotNull()).select("event_id", *REC, "value", epoch_micros("ts").alias("ts_us"))


def velocities(frames: DataFrame, state: DataFrame) -> DataFrame:
    """The valid frames of one micro-batch, each with its velocity from the
    frame before it, which may be in the state (one row per recording)."""
    order = Window.partitionBy(*REC).orderBy(F.col("ts_us").asc_nulls_last(), "event_id")
    f = frames.withColumns({"_v": F.lag("value").over(order), "_t": F.lag("ts_us").over(order), "_n": F.row_number().over(order)})
    f = attach(f, state.select(*REC, "prev_value", "prev_ts"), REC, "left")
    first = F.col("_n") == 1
    before = F.when(first, F.col("prev_value")).otherwise(F.col("_v"))
    dt = (F.col("ts_us") - F.when(first, F.col("prev_ts")).otherwise(F.col("_t"))) / 1e6
    return f.select("event_id", *REC, F.when(dt > 0, (F.col("value") - before) / dt).otherwise(0.0).alias("velocity"))


def last_frames(frames: DataFrame) -> DataFrame:
    """State after a micro-batch, for the recordings in it."""
    last = F.max_by(F.struct("value", "ts_us"), F.struct(F.col("ts_us").isNull(), "ts_us", "event_id"))
    return frames.groupBy(*REC).agg(last.alias("_last")).select(*REC, F.col("_last.value").alias("prev_value"), F.col("_last.ts_us").alias("prev_ts"))


def state_before(spark, path: str, batch: int) -> DataFrame:
    """The last frame of each recording in the batches before this one."""
    since = max(0, (batch - 1) // COMPACT * COMPACT)
    if not batch:
        return spark.createDataFrame([], STATE_SCHEMA)
    kept = spark.read.schema(STATE_SCHEMA).parquet(*[f"{path}/{k}" for k in range(since, batch)])
    newest = F.max_by(F.struct("prev_value", "prev_ts"), "batch").alias("_s")
    return kept.groupBy(*REC).agg(newest, F.max("batch").alias("batch")).select(*REC, "_s.*", "batch")


def stateful_velocity(stream: DataFrame, sink: str, state: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream of all that is available: the velocities of each
    micro-batch go to a folder of ``sink``, keyed by (user_id, event_type)."""

    def each(frames: DataFrame, batch: int) -> None:
        spark = frames.sparkSession
        old = state_before(spark, state, batch)
        velocities(frames, old).write.mode("overwrite").parquet(f"{sink}/batch={batch}")
        new = last_frames(frames).withColumn("batch", F.lit(batch).cast("long"))
        if batch % COMPACT == 0 and batch:
            new = new.unionByName(old.select(*new.columns).join(new.select(*[F.col(c).alias(f"_{c}") for c in REC]), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REC], "left_anti"))
        new.write.mode("overwrite").parquet(f"{state}/{batch}")

    return valid_frames(stream).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
