"""Streams into node tables (an extension of ours): upserts by micro-batch, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.writes import upsert_rows


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, <by>, n, total`` for each window; rows later than ``late`` are left out."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = stamped.groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def latest(rows: DataFrame, order: str) -> DataFrame:
    """The newest row of each id."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert_stream(stream: DataFrame, table: str, order: str, checkpoint: str) -> DataStreamWriter:
    """Upsert each micro-batch into ``table``: version n + 1 is version n with the batch's newest rows.

    A batch that is repeated after a failure writes its own version again, so the result is the same.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = latest(batch, order)
        if epoch == 0:
            fresh.write.mode("overwrite").parquet(f"{table}/v{epoch}")
            return
        held = spark.read.parquet(f"{table}/v{epoch - 1}")
        upsert_rows(held, fresh).write.mode("overwrite").parquet(f"{table}/v{epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
