"""Windowed counts over a stream of events, with a bound on how late one may come."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.plans import table
from lamella.plans.prefix import shared_folder


def tumbling(events: DataFrame, at: str, kind: str, value: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, total) of each window; the same for a stream and a table. start counts seconds since 1970."""
    # the watermark takes instants only; both ways go by the session's zone, so seconds come out as they were
    out = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(window.start AS TIMESTAMP_NTZ))").alias("start"), kind, "n", "total")


def run_windows(counted: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The table that a stream of windows comes to. Each batch writes the windows that it changed to a folder of its own
    (written again if it runs again); the last batch of a window holds. State of windows that the watermark has passed
    is dropped, and so are events that come after it."""
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    changed = counted.sparkSession.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in counted.schema)}, batch long").parquet(f"{folder}/out")
    others = [c for c in counted.columns if c not in keys]
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in others))


def q_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a stream."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # as a glob, so that it may be a file
    return run_windows(tumbling(stream, "ts", "event_type", "value"), ["start", "event_type"], folder)


QUERIES = {"stream_tumbling": q_stream_tumbling}
SQL = {"stream_tumbling": "SELECT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
