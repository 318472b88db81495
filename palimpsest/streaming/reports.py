"""Incremental reports over files that keep arriving. An extra: batch queries give the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_means(events: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means by window and group; rows later than the watermark allows are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def run_to_files(report: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The report over all files that are there now, in the shared folder.

    Each batch writes the rows that it changed to a place of its own, so a batch that runs again replaces what it wrote; of each key the row
    of the last batch counts. Nothing is gathered on the driver.
    """
    spark = report.sparkSession
    places = f"{folder}/rows"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{places}/batch={number}")

    query = report.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], report.schema).write.mode("overwrite").parquet(f"{places}/batch=-1")
    rows = spark.read.schema(T.StructType([*report.schema.fields, T.StructField("batch", T.LongType())])).parquet(places)
    others = [c for c in report.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")
