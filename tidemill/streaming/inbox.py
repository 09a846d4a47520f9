"""An inbox of notifications: at least once in, each once out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "45 days") -> DataFrame:
    """The first row of each key; state is kept for as long as rows may come late."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off all that is there, batch by batch; ``merge`` must be idempotent, as a batch may be repeated."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replayed(spark: SparkSession, source: str, schema, folder: str) -> DataFrame:
    """The rows of a folder of Parquet, read as a stream to its end, without duplicates; they come out as files."""
    rows = deduplicated(spark.readStream.schema(schema).parquet(source), ["event_id"], "ts")
    query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


class Inbox:
    """Rows that wait for work, worked off a bounded number a batch, in the order in which they fall due.

    The table is files: ``active/version=n`` holds what waits after batch n,
    ``finished/batch=n`` what batch n has finished.  A batch reads the version
    before its own and writes its own, so that a batch that is repeated gives
    the same again, and one that was cut short is made whole.  Only what waits
    is rewritten.
    """

    SCHEMA = "id long, status string, attempts int, next_attempt_at timestamp, locked_at timestamp"

    def __init__(self, spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], limit: int = 20, most_attempts: int | None = None):
        """``work`` gets the claimed rows and returns them with ``ok``; without it a row is tried again, or is dead after ``most_attempts``."""
        self.spark, self.folder, self.work, self.limit, self.most = spark, folder, work, limit, most_attempts

    def _read(self, part: str, schema: str = SCHEMA) -> DataFrame:
        """A part's rows; an empty frame where nothing was written."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")
        return self.spark.createDataFrame([], schema)

    def active(self, number: int) -> DataFrame:
        return self._read(f"active/version={number}")

    def finished(self) -> DataFrame:
        """What is finished, with the batch that did it."""
        return self._read("finished", f"{self.SCHEMA}, batch int")

    def batch(self, arrived: DataFrame, number: int, now) -> None:
        """Take in ``arrived`` (id, next_attempt_at), each id once, and work off what is due at ``now``, a column of no row.

        Due are rows that wait and whose time has come, and rows that someone
        took more than ten minutes ago and did not finish; the earliest first,
        ties by id, ``limit`` at most.
        """
        before = self.active(number - 1)
        # what this very batch has finished before it was cut short counts as not finished
        done = self.finished().where(F.col("batch") < number).select("id")
        fresh = arrived.select("id", "next_attempt_at").groupBy("id").agg(F.min("next_attempt_at").alias("next_attempt_at")).join(before.select("id"), "id", "left_anti").join(done, "id", "left_anti")
        waiting = before.unionByName(fresh.select("id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "next_attempt_at", F.lit(None).cast("timestamp").alias("locked_at")))
        due = (F.col("status").isin("pending", "retry") & (F.col("next_attempt_at") <= now)) | ((F.col("status") == "processing") & (F.col("locked_at") < now - F.expr("INTERVAL 10 MINUTES")))
        # ``limit`` rows
        claimed = waiting.where(due).orderBy("next_attempt_at", "id").limit(self.limit).withColumn("attempts", F.col("attempts") + 1)
        told = self.work(claimed)
        ok, again = F.coalesce("ok", F.lit(False)), now + F.make_dt_interval(mins=F.least(F.greatest("attempts", F.lit(1)), F.lit(10)))
        dead = F.lit(False) if self.most is None else F.col("attempts") >= self.most
        told = told.select("id", F.when(ok, "processed").when(dead, "dead").otherwise("retry").alias("status"), "attempts", F.when(ok | dead, F.col("next_attempt_at")).otherwise(again).alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("locked_at"))
        told.write.mode("overwrite").parquet(f"{self.folder}/told/batch={number}")
        told = self._read(f"told/batch={number}")
        ended = F.col("status").isin("processed", "dead")
        told.where(ended).write.mode("overwrite").parquet(f"{self.folder}/finished/batch={number}")
        waiting.join(told.select("id"), "id", "left_anti").unionByName(told.where(~ended)).write.mode("overwrite").parquet(f"{self.folder}/active/version={number}")
