"""File streams: append feature records, and score feature rows with a fixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factorloom import schema
from factorloom.model import Model
from factorloom.operators.predict import predict_with


def cell_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, event_time: str | None = None) -> DataFrame:
    """A folder of cell files as a stream, with the timestamp column `event_time` if they have one."""
    kinds = T.StructType([*schema.CELLS.fields, *([T.StructField(event_time, T.TimestampType())] if event_time else [])])
    reader = spark.readStream.schema(kinds)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_stream(cells: DataFrame, path: str, checkpoint: str, event_time: str | None = None,
                  delay: str = "1 day") -> StreamingQuery:
    """Append all new records of a cell stream to a stored cell table, then stop. Exactly once for what the stream holds.

    With the name of a timestamp column as `event_time`, a record (row_id, col) that is sent again within `delay` of
    its time is stored once, in the same batch or a later one; the state forgets a record when the watermark has passed it by
    `delay`. The column is not stored. Records without a time are all taken at the epoch."""
    if event_time is not None:
        timed = cells.withColumn("_time", F.coalesce(F.col(event_time), F.timestamp_seconds(F.lit(0))))
        cells = timed.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["row_id", "col"])
        cells = cells.select("row_id", "col", "cat", "val")
    return (cells.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path))


def score_stream(rows: DataFrame, model: Model, path: str, checkpoint: str) -> StreamingQuery:
    """Score a stream of dense rows or points, one row per point, and write the predictions below
    `path`, one folder per batch. A batch that is run again replaces its own folder. Rows are scored
    on their own, so the stream keeps no state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        predict_with(batch, model).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
