"""A second availableNow run over the same checkpoint ingests nothing;
a new file is picked up alone."""

import os
import shutil

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from trialframe.streaming import ingest


def test_incremental_ingest_only_new_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    shutil.copy(f"{SF_SMALL}/events.parquet", src / "events_a.parquet")
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    ingest.ingest_new_files(spark, str(src), schema, sink, ck)
    n1 = spark.read.parquet(sink).count()
    ingest.ingest_new_files(spark, str(src), schema, sink, ck)
    assert spark.read.parquet(sink).count() == n1
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet").where(F.col("event_type") == "view")
    df.coalesce(1).write.parquet(str(tmp_path / "new"))
    part = [f for f in os.listdir(tmp_path / "new") if f.endswith(".parquet")][0]
    shutil.copy(tmp_path / "new" / part, src / "events_b.parquet")
    ingest.ingest_new_files(spark, str(src), schema, sink, ck)
    assert spark.read.parquet(sink).count() == n1 + df.count()


def test_state_is_carried_over_many_batches(spark, tmp_path):
    """One file a batch, over a compaction of the state; recordings pause, one goes back in time, keys are null."""
    from datetime import datetime, timedelta

    from trialframe.streaming import stateful

    rows = []
    for b in range(13):
        rows.append([(100 * b + k, datetime(2024, 1, 1) + timedelta(seconds=60 * b + k * 7 % 5), u, "view", float((b * 5 + k * 3) % 11))
                     for k, u in enumerate([1, 1, None, None, 1, 2 if b in (0, 12) else 3])])
    rows.append([(2000, datetime(2023, 1, 1), 1, "view", 5.0), (2001, datetime(2023, 1, 1, 0, 0, 2), 1, "view", 9.0), (2002, None, 1, "view", 1.0)])
    src = tmp_path / "src"
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for k, r in enumerate(rows):
        spark.createDataFrame(r, kind).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        src.mkdir(exist_ok=True)
        part = next(f for f in os.listdir(tmp_path / f"p{k}") if f.endswith(".parquet"))
        shutil.copy(tmp_path / f"p{k}" / part, src / f"{k:02d}.parquet")
        os.utime(src / f"{k:02d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(src))
    sink = str(tmp_path / "sink")
    stateful.stateful_velocity(stream, sink, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    got = {r["event_id"]: r["velocity"] for r in spark.read.schema(stateful.OUT_SCHEMA).parquet(f"{sink}/batch=*").collect()}
    want, state = {}, {}
    for batch in rows:
        for e, t, u, _, v in sorted(batch, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
            pv, pt = state.get(u, (v, t))
            dt = (t - pt).total_seconds() if t is not None and pt is not None else 0
            want[e], state[u] = (v - pv) / dt if dt > 0 else 0.0, (v, t)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    assert os.path.isdir(tmp_path / "state" / "13")
