"""Idle-session eviction as Structured Streaming (H4).

Events stream in from files; ``session_window`` with a one-hour gap groups each user's
events; the watermark closes a session once no event can extend it, and append mode
emits it exactly once. Rows later than the watermark are dropped (Spark's rule). The
job runs ``availableNow`` so it processes what is there and stops; its checkpoint and
sink live in the shared checkpoint folder, so a restarted job resumes where it stopped."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chat import SESSION_TTL_SECONDS
from ..session import scratch_path

GAP = f"{SESSION_TTL_SECONDS} seconds"


def session_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = GAP,
                   delay: str = GAP) -> DataFrame:
    """Streaming DataFrame of closed sessions (user, session_start, session_end, events).
    ``ts`` may be TIMESTAMP_NTZ: it is cast to TIMESTAMP for the watermark."""
    s = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    g = s.groupBy(F.session_window("__ts", gap).alias("w"), F.col(user)).agg(F.count(F.lit(1)).alias("events"))
    return g.select(user, F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("session_end"), "events")


def closed_sessions(spark: SparkSession, source_dir: str, schema, user: str = "user_id", ts: str = "ts",
                    gap: str = GAP, sink: str | None = None, checkpoint: str | None = None,
                    glob: str | None = None) -> DataFrame:
    """Run the stream over the files in ``source_dir`` (optionally only those matching
    ``glob``) until caught up; return the emitted sessions."""
    sink = sink or scratch_path(spark, "sessions-out")
    checkpoint = checkpoint or scratch_path(spark, "sessions-ckpt")
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    src = reader.parquet(source_dir)
    # events of one user are merged into sessions in every task before the shuffle
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    q = (session_stream(src, user, ts, gap).writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return spark.read.parquet(sink)
