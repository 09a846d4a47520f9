"""Entity resolution: groups of evidence and their decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import sender_role

# fixed values: events that corroborate an order
CORROBORATING = ("order_updated", "payment_completed", "shipment", "delivery", "invoice_or_receipt")


def purchases(evidence: DataFrame) -> DataFrame:
    """user_id, sender, order_key, n, n_created, n_support, merchant, confidence and decision of each candidate purchase.

    A candidate is what one sender's domain says of one order of a user; rows
    without any of the three are in none.  A carrier's is lifecycle only, a
    public mailbox's is reviewed; then, without an order confirmation it is
    lifecycle only.  The strongest confirmation (ties: the earliest, then the
    smaller source) must name a merchant; it creates a purchase from 0.9 on,
    and from 0.8 on with other evidence.  All is combined before the shuffle.
    """
    created = F.col("event") == "order_created"
    grouped = evidence.where("user_id is not null and order_key is not null and sender <> ''").groupBy("user_id", "sender", "order_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(created).alias("created"), F.count_if(F.col("event").isin(*CORROBORATING)).alias("n_support"),
        F.min(F.when(created, F.struct((-F.col("confidence")).alias("c"), "received_at", "source_id", "merchant"))).alias("best"), F.min(F.when(F.col("merchant").isNotNull(), F.struct("received_at", "source_id", "merchant"))).alias("first"),
    )
    role = sender_role(F.col("sender"))
    n_created = F.when(role == "carrier", 0).otherwise(F.col("created"))
    best, named = -F.col("best.c"), F.coalesce("best.merchant", F.lit("")) != ""
    decided = (
        F.when(role == "carrier", "lifecycle_only").when(role == "public", "review").when(n_created == 0, "lifecycle_only").when(~named, "review").when(best >= 0.9, "create_direct")
        .when((best >= 0.8) & (F.col("n_support") > 0), "create_corroborated").otherwise("review")
    )
    confidence = F.when(n_created == 0, 0.0).when(decided == "create_corroborated", F.round(F.least(F.lit(0.99), best + 0.08), 4)).otherwise(best)
    merchant = F.coalesce(F.when(role != "carrier", F.col("best.merchant")), "first.merchant")
    return grouped.select("user_id", "sender", "order_key", "n", n_created.alias("n_created"), "n_support", merchant.alias("merchant"), confidence.alias("confidence"), decided.alias("decision"))


# fixed values: phases in which a parcel is with its carrier
PHYSICAL = ("shipped", "in_transit", "out_for_delivery", "ready_for_pickup")


def shipments(evidence: DataFrame, purchases: DataFrame) -> DataFrame:
    """Of each tracking number of a user: counts, the slug, the status, and the purchase that merchants' rows point to.

    ``evidence`` has user_id, tracking, sender, order_key, event, phase, slug
    and confidence; ``purchases`` has user_id, sender, order_key and
    purchase_id.  One purchase is linkable, several are reviewed.  A merchant's
    row anchors only if its order is one purchase; a missing phase is no
    progress; the slug counts if there is but one.
    """
    known = purchases.groupBy("user_id", "sender", "order_key").agg(F.count(F.lit(1)).alias("matches"), F.min("purchase_id").alias("low"), F.max("purchase_id").alias("high"))
    rows = evidence.where("tracking is not null").join(known, ["user_id", "sender", "order_key"], "left")
    anchor = (sender_role(F.col("sender")) != "carrier") & F.col("matches").isNotNull()
    g = rows.groupBy("user_id", "tracking").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sender_role(F.col("sender")) == "carrier").alias("n_carrier"), F.count_if(anchor & (F.col("matches") == 1)).alias("n_anchors"), F.min(F.when(anchor, F.col("low"))).alias("low"), F.max(F.when(anchor, F.col("high"))).alias("high"),
        F.min("slug").alias("slug"), F.max("slug").alias("last_slug"), F.max("confidence").alias("confidence"), F.count_if((F.col("event") == "shipment") & F.col("phase").isin(*PHYSICAL)).alias("n_physical"), F.bool_or((F.col("event") == "delivery") | F.coalesce(F.col("phase") == "delivered", F.lit(False))).alias("delivered"),
    )
    decision = F.when(F.col("low").isNull(), "unmatched").when(F.col("low") == F.col("high"), "linkable").otherwise("review")
    status = F.when(F.col("delivered"), "delivered").when(F.col("n_physical") > 0, "in_transit").otherwise("shipment_created")
    return g.select("user_id", "tracking", "n", "n_carrier", "n_anchors", "n_physical", "confidence", F.when(F.col("slug") == F.col("last_slug"), F.col("slug")).alias("slug"), status.alias("status"), decision.alias("decision"), F.when(decision == "linkable", F.col("low")).alias("purchase_id"))


def best_and_margin(scored: DataFrame, probe: list[str], candidate: str, score: str = "score") -> DataFrame:
    """Of each probe the candidate with the highest score (ties: the smaller), the runner-up's score, and whether the two are too close."""
    order = W.partitionBy(*probe).orderBy(F.col(score).desc(), F.col(candidate))
    ranked = scored.withColumn("__rank", F.row_number().over(order)).withColumn("runner_up", F.lead(score, 1, 0).over(order)).where("__rank = 1")
    return ranked.withColumn("ambiguous", (F.col("runner_up") > 0) & (F.col(score) >= 80) & (F.col(score) - F.col("runner_up") < 30)).drop("__rank")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
