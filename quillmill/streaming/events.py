"""Structured Streaming over the event log: windows, late data, repeats and a running cap. An extension.

Every function works on a streaming and on a batch DataFrame alike, so the batch twin checks the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 4, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp with a watermark, repeats within it dropped."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        return t.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return t.dropDuplicates(["event_id"])


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return timed(events).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(
        F.unix_seconds("w.start").alias("start"), "event_type", "events", "value")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return timed(events).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.unix_seconds("w.start").alias("start"), "event_type", "events")


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    return timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select(
        "user_id", F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "events")


def running_spend(events: DataFrame, cap: float):
    """Per user, the events after which the total first passes the cap: state is one number and a flag per user."""
    import pandas as pd

    out = "user_id long, event_id long, total double"

    def step(key, batches, state):
        total, tripped = state.get if state.exists else (0.0, False)
        rows = []
        for pdf in batches:
            for e, v in sorted(zip(pdf["event_id"], pdf["value"])):
                if not tripped and pd.notna(v):
                    total += float(v)
                    if total > cap:
                        tripped = True
                        rows.append((key[0], e, total))
        state.update((total, tripped))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "total"])

    return events.select("user_id", "event_id", "value").groupBy("user_id").applyInPandasWithState(step, out, "total double, tripped boolean", "append", "NoTimeout")


def run_once(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there, exactly once into Parquet files, with the progress kept at `checkpoint`."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
