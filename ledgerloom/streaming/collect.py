"""Landing files as they arrive: a file stream around the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.landing import land_raw


def stream_source(spark: SparkSession, path: str, schema: StructType | str, format: str = "csv", max_files: int = 100, **options) -> DataFrame:
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", max_files).options(**options).load(path)


def collect_stream(stream: DataFrame, source_id: int, out: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch as one batch of raw rows, partitioned by its id; a micro-batch that is run again replaces its own partition.

    ``clean`` is applied to the rows of a micro-batch before they land.
    """

    def write(rows: DataFrame, n: int) -> None:
        landed = land_raw(clean(rows) if clean else rows, source_id, f"batch_{n}_{source_id}")
        landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def anomaly_counts(events: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and anomalies for each window and type; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "data_type").agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("anomalies"))
