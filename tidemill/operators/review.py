"""Confirmations under review, and what other sources say for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import text_key

# fixed values: words of a subject that speak of packing, folded
PACKING = ("osszekeszitettuk", "osszekeszites", "csomagoljuk", "csomagoljak", "csomagolasa folyamatban", "becsomagoltuk", "keszen all a szallitasra", "ready for shipment", "ready to ship", "packing", "packed")
TRUSTED, LIFECYCLE = ("validated", "guardrailed"), ("order_updated", "shipment", "delivery", "invoice_or_receipt")
KEY = ["user_id", "sender", "order"]


def packing(subject: Column) -> Column:
    text = text_key(F.coalesce(subject, F.lit("")))
    return reduce(Column.__or__, [text.contains(w) for w in PACKING])


def text_looks_same(a: Column, b: Column) -> Column:
    """Normalised names that are equal, or of five letters or more and one in the other; null is like nothing."""
    inside = (F.length(a) >= 5) & (F.length(b) >= 5) & (a.contains(b) | b.contains(a))
    return F.coalesce((a != "") & (b != "") & ((a == b) | inside), F.lit(False))


def reviewed(rows: DataFrame) -> DataFrame:
    """user_id, sender, order, anchor, confidence, decision, n_trusted, n_identity, n_packing: one row for each order whose confirmation is under review.

    ``rows`` have row_id, source_id, user_id, sender, order, event, subject,
    processing, validation, merchant, legal, tracking (normalised), payment
    and confidence; a source may have several rows.  The anchor is the surest
    confirmation under review (ties: the smallest row).  Only other sources
    support it: so of each kind the two best of different sources are kept,
    the count of all and that of the anchor's source, and no row meets the
    rows of its group.  An order without an anchor has no row; nulls in the
    key are in no group.
    """
    some = rows.where(reduce(Column.__and__, [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in KEY]))
    trusted, confidence, event = F.col("validation").isin(*TRUSTED), F.col("confidence"), F.col("event")
    lifecycle = trusted & ((event.isin(*LIFECYCLE) & (confidence >= 0.7)) | ((event == "payment_completed") & (F.col("payment") == "paid") & (confidence >= 0.75)))
    kinds = F.array_compact(F.array(
        F.when(F.coalesce(lifecycle, F.lit(False)), F.lit("trusted")), F.when((F.col("validation") == "review") & (event == "payment_completed") & (F.col("payment") == "failed") & (confidence >= 0.75), F.lit("identity")),
        F.when(trusted & (event == "order_created") & (confidence >= 0.75) & packing(F.col("subject")), F.lit("packing")),
    ))
    is_anchor = (F.col("processing") == "review") & (event == "order_created") & ~packing(F.col("subject")) & F.col("merchant").isNotNull() & (confidence >= 0.7)
    anchors = some.where(is_anchor).groupBy(*KEY).agg(F.min(F.struct((-confidence).alias("less"), "row_id", "source_id", "legal")).alias("a"))
    anchors = anchors.select(*KEY, F.col("a.row_id").alias("anchor"), F.col("a.source_id").alias("anchor_source"), text_key(F.coalesce("a.legal", F.lit(""))).alias("anchor_legal"), (-F.col("a.less")).alias("anchor_confidence"))
    supports = some.withColumn("kind", F.explode(kinds))
    # of each source its surest row and how many it has
    by_source = supports.groupBy(*KEY, "kind", "source_id").agg(F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n"))
    counts = by_source.groupBy(*KEY).pivot("kind", ["trusted", "identity", "packing"]).agg(F.sum("n"))
    own = by_source.withColumnRenamed("source_id", "anchor_source").join(anchors.select(*KEY, "anchor_source"), [*KEY, "anchor_source"]).groupBy(*KEY).pivot("kind", ["trusted", "identity", "packing"]).agg(F.sum("n"))
    own = own.toDF(*KEY, "own_trusted", "own_identity", "own_packing")
    # two of them are enough, whichever the anchor's source is; Spark drops the rest before the shuffle
    place = F.row_number().over(W.partitionBy(*KEY, "kind").orderBy(F.col("best").desc(), "source_id"))
    two = by_source.withColumn("place", place).where("place <= 2").groupBy(*KEY).agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("source_id", "best"))).alias(f"best_{k}") for k in ("trusted", "packing")])
    # shipments that identify: by their number, or by a legal name; two sources of each are enough too
    shipment = supports.where("kind = 'trusted' and event = 'shipment' and confidence >= 0.75")
    numbered = F.when(F.length("tracking") >= 10, F.col("source_id"))
    ends = shipment.groupBy(*KEY, text_key(F.coalesce("legal", F.lit(""))).alias("legal")).agg(F.min("source_id").alias("low"), F.max("source_id").alias("high"), F.min(numbered).alias("low_number"), F.max(numbered).alias("high_number"))
    ends = ends.groupBy(*KEY).agg(F.min("low_number").alias("low_number"), F.max("high_number").alias("high_number"), F.collect_list(F.struct("legal", "low", "high")).alias("legals"))
    t = anchors.join(counts, KEY, "left").join(own, KEY, "left").join(two, KEY, "left").join(ends, KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    anchor = F.col("anchor_source")
    n = {k: zero(k) - zero(f"own_{k}") for k in ("trusted", "identity", "packing")}
    best = lambda k: F.coalesce(F.array_max(F.transform(F.filter(f"best_{k}", lambda x: x["source_id"] != anchor), lambda x: x["best"])), F.lit(0.0))
    other = lambda low, high: F.coalesce((low != anchor) | (high != anchor), F.lit(False))
    strong = other(F.col("low_number"), F.col("high_number")) | F.coalesce(F.exists("legals", lambda x: text_looks_same(F.col("anchor_legal"), x["legal"]) & other(x["low"], x["high"])), F.lit(False))
    t = t.withColumns({"n_trusted": n["trusted"], "n_identity": n["identity"], "n_packing": n["packing"], "trusted_best": best("trusted"), "packing_best": best("packing"), "strong": strong})
    sure = F.col("anchor_confidence")
    raised = (
        F.when((sure >= 0.85) & ((F.col("trusted_best") >= 0.74) | (F.col("packing_best") >= 0.8)), F.least(F.lit(0.97), sure + 0.08))
        .when((sure >= 0.8) & (F.col("trusted_best") >= 0.72) & (F.col("n_trusted") + F.col("n_identity") + F.col("n_packing") >= 2), F.least(F.lit(0.95), sure + 0.08))
        .when(F.col("strong"), F.least(F.lit(0.92), sure + 0.12))
    )
    out = t.withColumn("raised", raised)
    return out.select(*KEY, "anchor", F.round(F.coalesce("raised", "anchor_confidence"), 4).alias("confidence"), F.when(F.col("raised").isNotNull(), "create").otherwise("review").alias("decision"), "n_trusted", "n_identity", "n_packing")
