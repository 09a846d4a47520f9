"""Exact dedup of an incoming batch against an immutable snapshot.

The snapshot is a table of exact buckets (one row for each distinct digest)
with one static binary-fuse filter for each bucket.  The batch is grouped by
digest first, so that its own duplicates meet separately; each of its
distinct digests is then screened by the filter of its bucket.  Only positives
join the exact buckets.  All groups of two or more are checked byte by byte on
the texts before a row is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import discard, materialize, text_of

#: Digests that a bucket, and with it a filter, is sized for.
BUCKET_DIGESTS = 100_000


@dataclass(frozen=True)
class Snapshot:
    """``groups``: bucket, key, sha, max_id, n for each distinct digest; ``filters``: bucket, filter."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sha = F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))
    return docs.select(F.col(id_col).cast("long").alias("id"), sha.alias("sha")).withColumn("key", F.xxhash64("sha"))


def grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """One row for each distinct digest; copies collapse before the shuffle."""
    return rows.groupBy("sha", "key").agg(F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n")).withColumn("bucket", F.pmod(F.shiftright("key", 17), F.lit(buckets)).cast("int"))


def build_snapshot(rows: DataFrame, buckets: int) -> Snapshot:
    groups = materialize(grouped(rows, buckets), "dedup-snapshot")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [fuse.build(pdf["key"].to_numpy().view(np.uint64))]})

    filters = groups.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")
    return Snapshot(groups, materialize(filters, "dedup-filters"), buckets)


def screen(batch_groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests of the batch that the snapshot may hold; misses are certain."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows and left.num_rows:
            keys = np.asarray(left.column("key")).view(np.uint64)
            left = left.filter(pa.array(fuse.contains(right.column("filter")[0].as_py(), keys)))
            return left.select(["sha", "max_id", "n"])
        return left.slice(0, 0).select(["sha", "max_id", "n"]) if left.num_columns else pa.table({"sha": pa.array([], pa.binary()), "max_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    return batch_groups.select("bucket", "key", "sha", "max_id", "n").groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(probe, "sha binary, max_id long, n long")


def exact_dedup(docs: DataFrame, in_snapshot: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``in_snapshot`` says which rows the immutable snapshot holds; the others
    are the incoming batch.  By default a hash of the id decides, half each.
    Texts are equal when identical; a null text counts as empty.  Of equal
    texts the largest id stays; null ids stay only where all ids of the group
    are null (keep_id is null then).  Rows repeated under the id that stays
    are all marked kept.  Other columns are not read; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    split = F.coalesce(in_snapshot if in_snapshot is not None else F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0, F.lit(False))
    rows = docs.select(F.col(id_col), F.col(text_col), split.alias("__old"))
    flat = rows.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("sha"), "__old").withColumn("key", F.xxhash64("sha"))
    flat = materialize(flat, "dedup-digests")
    buckets = max(int(spark.sparkContext.defaultParallelism), flat.count() // BUCKET_DIGESTS + 1)
    snapshot = build_snapshot(flat.where("__old"), buckets)
    batch = grouped(flat.where("not __old"), buckets)
    batch = materialize(batch, "dedup-batch")
    positives = screen(batch, snapshot)
    both = positives.select("sha").join(snapshot.groups.select("sha"), "sha")
    again = batch.where("n > 1").select("sha").union(snapshot.groups.where("n > 1").select("sha"))
    suspects = materialize(both.union(again).distinct(), "dedup-suspects")
    discard(batch, snapshot.groups, snapshot.filters)

    # byte checks: copies are combined by their whole texts, in each task first; the join before is a query of its own, so Spark may split a hot digest
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    checked = materialize(texts.join(suspects.hint("merge"), "sha", "left_semi"), "dedup-checked")
    kept = materialize(checked.groupBy("sha", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-kept")
    # rows find their group by the digest; only digests that stand for several texts, if any, need the texts again
    clash = materialize(kept.groupBy("sha").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1").select("sha"), "dedup-clashes")
    columns = ["id", "keep_id", "group_size", "sha"]
    plain = kept.join(clash, "sha", "left_anti") if (clashes := not clash.isEmpty()) else kept
    multiple = flat.select("id", "sha").join(plain.select("sha", "keep_id", "group_size").hint("merge"), "sha").select(*columns)
    if clashes:
        multiple = multiple.unionByName(checked.join(clash, "sha", "left_semi").join(kept, ["sha", "text"]).select(*columns))
    multiple = materialize(multiple, "dedup-groups")
    discard(checked, kept, clash)
    single = flat.select("id", "sha").join(suspects, "sha", "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return single.unionByName(multiple).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
