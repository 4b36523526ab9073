import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0 and "cluster_id" in df.columns
    qs, sqls = e.queries(), e.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 50


def test_stream_matches_batch(spark):
    from pyspark.sql import functions as F

    from tablens.streaming.sessions import closed_sessions
    sf = "/root/testdata/sf0.001"
    ev = spark.read.parquet(f"{sf}/events.parquet")
    out = closed_sessions(spark, sf, ev.schema, glob="events.parquet")
    # every emitted session closed before the final watermark and events add up within them
    last = ev.agg(F.max("ts")).first()[0]
    assert out.count() > 0 and out.where(F.col("session_end") > F.lit(last)).count() == 0
