"""The live activity view as Structured Streaming over a folder of Parquet files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marquetry.operators.activity import rolling_counts


def event_stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Unbounded view of a folder; new files are new events."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.parquet(path)


def daily_counts(events: DataFrame, ts: str, kind: str, late: str | None = None) -> DataFrame:
    """Events per UTC day and kind; works on streams and on tables alike. `late` sets a watermark and bounds the state.

    Null times count under a null day where there is no watermark; under a watermark they are dropped by the engine.
    """
    t = F.col(ts).cast("timestamp")
    df = events.withColumn("_t", t)
    df = df.withWatermark("_t", late) if late else df
    out = df.groupBy(F.window("_t", "1 day").alias("w"), F.col(kind).alias("kind")) if late else df.groupBy(F.to_date("_t").alias("day"), F.col(kind).alias("kind"))
    out = out.agg(F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("day"), "kind", "n") if late else out


def publish_counters(events: DataFrame, ts: str, checkpoint: str, publish: Callable[[DataFrame, int], None], store: Callable[[], DataFrame], now: Callable[[], object] | None = None, **trigger) -> StreamingQuery:
    """Recomputes total / this week / today after every micro-batch from the stored table: they depend on the clock, not on the batch."""
    at = lambda: F.lit(now()).cast("timestamp") if now else F.current_timestamp()
    return (
        events.writeStream.foreachBatch(lambda batch, no: publish(rolling_counts(store(), ts, at()), no))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def run_available(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Processes all that is there and returns the in-memory result table (tests and small results only)."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
