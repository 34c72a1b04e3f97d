"""Process only files not processed yet.

A parquet file-source stream remembers which files it has consumed in its
checkpoint; ``trigger(availableNow=True)`` processes everything new and
stops, so the same call run again picks up only files that arrived since.
Sink and checkpoint live under the cluster's shared ``spark.checkpoint.dir``
(survives executor and driver loss); exactly-once via the file sink log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from trialframe.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}" if unique else f"{root}/{name}"


def ingest_new_files(spark: SparkSession, source_dir: str, schema: StructType, sink: str, checkpoint: str,
                     glob: str | None = None, transform=None, max_files_per_trigger: int | None = None) -> int:
    """Append rows of every not-yet-seen file under ``source_dir`` to the
    parquet ``sink``; returns the number of micro-batches run."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.parquet(source_dir)
    if transform is not None:
        s = transform(s)
    q = (s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return len(q.recentProgress)


def read_sink(spark: SparkSession, sink: str, schema: StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(sink)
