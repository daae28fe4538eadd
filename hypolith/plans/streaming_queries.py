"""Queries of the streaming extras, run over all events available now."""

from __future__ import annotations

from pyspark.sql import functions as F

from hypolith.plans.registry import query
from hypolith.sources import tables as T
from hypolith.streaming import events as E


def _drained(spark, sf, plan):
    """The result of a streaming plan over the whole table: read as a stream, each complete result written to the shared folder."""
    table = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/events.parquet*")
    path = T.shared_path(spark, "stream")
    out = plan(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    sink = out.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows"))
    sink.option("checkpointLocation", f"{path}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query("s1_windowed_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def s1(spark, sf):
    out = _drained(spark, sf, E.windowed)
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean": F.round("mean", 6)})


@query("s2_sessions", "WITH t AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM t) SELECT min(ts) AS start, CAST(max(ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS \"end\", user_id, count(*) AS n FROM r GROUP BY user_id, s")
def s2(spark, sf):
    out = _drained(spark, sf, E.sessions)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
