"""A table that batches of updates are merged into, bucket by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .merge import RULES


class MergeTable:
    """Rows by key, in buckets of keys.  A batch rewrites the buckets that it touches, no others.

    Updates with a problem are kept apart, and each source is told what became
    of its rows.  Rows of a batch are folded by their order first, so that one
    batch merges like its rows one after the other.  A batch that is repeated
    changes nothing more, as every rule gives the same again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], rules: dict[str, str], order: list[str], buckets: int = 16):
        """``rules`` has a rule of ``merge`` for each column but the keys; ``order`` are columns of the updates."""
        self.spark, self.folder, self.keys, self.rules, self.order, self.buckets = spark, folder, keys, rules, order, buckets
        kind = StructType.fromDDL(schema)
        self.schema = StructType([kind[c] for c in (*keys, *rules)]).add("bucket", IntegerType())

    def _read(self, part: str, schema) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}") if there else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema).drop("bucket")

    def outcomes(self) -> DataFrame:
        """source_id, outcome, n and batch: how many rows of each source were inserted, updated or rejected, and why."""
        return self._read("outcomes", "source_id long, outcome string, n long, batch int")

    def apply(self, updates: DataFrame, batch: int) -> None:
        """``updates``: keys, columns, the order's columns, source_id, and ``problem``, null of good rows."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        good = updates.where("problem is null").withColumn("bucket", bucket)
        touched = [r.bucket for r in good.select("bucket").distinct().collect()]  # at most as many as there are buckets
        old = self._read("rows", self.schema).where(F.col("bucket").isin(touched) if touched else F.lit(False))
        known = old.select(*self.keys, F.lit(True).alias("__known"))
        told = good.join(known, self.keys, "left").select("source_id", F.when(F.col("__known"), "updated").otherwise("inserted").alias("outcome"))
        told = told.unionByName(updates.where("problem is not null").select("source_id", F.concat(F.lit("rejected: "), "problem").alias("outcome")))
        # a batch that is repeated finds its own rows; what it told the first time stays
        if self._read(f"outcomes/batch={batch}", "source_id long").isEmpty():
            told.groupBy("source_id", "outcome").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.folder}/outcomes/batch={batch}")
        if not touched:
            return
        at = F.struct(*self.order)
        pick = {"new": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)), "old": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)), "greatest": F.max, "least": F.min}
        # keys meet before they are folded: a row has its order once, a fold's buffer once for each column
        news = good.repartition(*self.keys, "bucket").groupBy(*self.keys, "bucket").agg(*[pick[r](c).alias(f"__{c}") for c, r in self.rules.items()])
        both = old.join(news, [*self.keys, "bucket"], "full")
        out = both.select(*self.keys, *[RULES[r](F.col(c), F.col(f"__{c}")).alias(c) for c, r in self.rules.items()], "bucket")
        # written by the tasks of the join, so that a bucket of any size is spread over all of them; partitions
        # that the frame has are replaced when all are written, others stay
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/rows")
