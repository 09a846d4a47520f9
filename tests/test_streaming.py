"""The inbox: deduplicated streams and idempotent drains over several batches."""

from pyspark.sql import functions as F

from tidemill.streaming.inbox import drain, replayed


def test_drain_and_dedupe_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):  # three files; ids repeat within and across them
        rows = spark.range(10 * k, 10 * k + 15).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), (F.col("id") % 4).alias("user_id"))
        rows.unionByName(rows.limit(5)).coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    out = replayed(spark, str(source), schema, str(tmp_path / "a"))
    assert sorted(r.event_id for r in out.collect()) == list(range(35))

    seen = []

    def merge(batch, number):
        seen.append(number)
        batch.select("event_id").distinct().write.mode("overwrite").parquet(str(tmp_path / f"sums/batch={number}"))
        merge_again = batch.select("event_id").distinct()  # the same batch once more replaces its part
        merge_again.write.mode("overwrite").parquet(str(tmp_path / f"sums/batch={number}"))

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    drain(stream(), merge, str(tmp_path / "c"))
    assert seen == [0, 1, 2]
    assert spark.read.parquet(str(tmp_path / "sums")).select("event_id").distinct().count() == 35
    drain(stream(), merge, str(tmp_path / "c"))  # nothing is left
    assert seen == [0, 1, 2]
