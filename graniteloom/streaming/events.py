"""Structured Streaming over event files: first-seen rows and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files below a folder, as they come; event times without a zone are taken in the session's zone,
    since watermarks need instants."""
    schema = spark.read.parquet(path).schema
    return with_instants(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def with_instants(events: DataFrame) -> DataFrame:
    """events with every TIMESTAMP_NTZ column as TIMESTAMP."""
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in events.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return events.withColumns(zoned) if zoned else events


def first_seen(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark: bounded state, exact inside it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, by: str, ts: str = "ts", length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling counts and sums; a window ends when the watermark passes it."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, length), by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, user: str, ts: str = "ts", gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), user, "n")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, written as Parquet with a checkpoint, so that a rerun goes on where this one ended."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def upserted(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> DataFrame:
    """All that is there now, merged batch by batch into a table of one row a key: the row of the highest `order`.

    A batch writes the table anew under its own number and the reader takes the highest one, so a batch that is run again
    after a failure changes nothing.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = spark.read.parquet(f"{path}/{number - 1}").unionByName(batch)
        rest = [c for c in rows.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("_r"))
        best.select(*keys, "_r.*").write.mode("overwrite").parquet(f"{path}/{number}")
        spark.range(1).select(F.lit(number).alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{path}/last")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/last").first()["number"]
    return spark.read.parquet(f"{path}/{last}")
