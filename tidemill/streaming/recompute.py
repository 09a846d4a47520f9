"""Recompute what a stream touches: the users that something came in for, over all of their recent rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How long rows count, in days.
WINDOW_DAYS = 45


class Recomputed:
    """A table of results by user that follows a stream, whatever the order of its batches.

    Rows that come in are kept by bucket of users and batch.  A batch
    then finds the buckets of the users that it touches, reads their rows of
    the last days, whichever batch they came with, and overwrites the buckets'
    partitions, no others.  A batch that is repeated overwrites what it wrote.
    """

    def __init__(self, spark: SparkSession, folder: str, compute: Callable[[DataFrame], DataFrame], key: str = "source_id", user: str = "user_id", time: str = "received_at", buckets: int = 16, days: int = WINDOW_DAYS):
        """``compute`` makes one row for each user from the rows that count for it; it gets whole users only."""
        self.spark, self.folder, self.compute, self.key, self.user, self.time, self.buckets, self.days = spark, folder, compute, key, user, time, buckets, days

    def _write(self, df: DataFrame, part: str, by: list[str]) -> None:
        # partitions that the frame has are replaced, others stay
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{part}")

    def batch(self, arrived: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(self.user), F.lit(self.buckets)).cast("int")
        rows = arrived.withColumn("bucket", bucket).withColumn("batch", F.lit(number))
        self._write(rows.repartition("bucket"), "rows", ["bucket", "batch"])
        # at most as many as there are buckets
        touched = [r.bucket for r in arrived.select(bucket.alias("bucket")).distinct().collect()]
        if not touched:
            return
        known = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows").where(F.col("bucket").isin(touched))
        # the same row may have come with several batches
        known = known.dropDuplicates([self.key]).drop("batch")
        newest = known.groupBy(self.user).agg(F.max(self.time).alias("__newest"))
        recent = known.join(newest, self.user).where(F.col(self.time) > F.col("__newest") - F.expr(f"INTERVAL {self.days} DAYS")).drop("__newest")
        results = self.compute(recent.drop("bucket")).withColumn("bucket", bucket)
        self._write(results.repartition("bucket"), "results", ["bucket"])

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results").drop("bucket")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Work off all that the stream has."""
        stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
