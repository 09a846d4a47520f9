"""A carrier's parcels and the purchases that they are of, by what the merchant said before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import micros
from ..functions.text import same_party, text_key
from .candidates import alike_names
from .joins import interval_join

#: Hours between a merchant's word and a carrier's, and if both name one number.
NEAR, NAMED = 36, 168
#: Characters of a number that tells parcels apart, and the least confidences.
LEAST_NUMBER, CLUSTER, ANCHOR, NAMED_ANCHOR = 10, 0.85, 0.8, 0.75
KEY = ["user_id", "slug", "tracking"]


def bridged(purchases: DataFrame, stored: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """user_id, slug, tracking, n, confidence, decision, purchase_id, corroborated: one row for each parcel that a carrier tells of.

    ``purchases``: purchase_id, user_id, expected (a carrier's slug), name and
    legal (normalised names); ``stored``: purchase_id, slug and tracking of
    parcels that purchases have; ``anchors``: a merchant's messages of a
    purchase: purchase_id, user_id, anchor_at, anchor_confidence, anchor_slug,
    anchor_tracking and delivers; ``rows``: a carrier's messages: user_id,
    slug, tracking, carrier_at, confidence, delivered, consignor.

    A purchase is a candidate if the merchant announced a parcel and the
    carrier spoke of it within 36 hours, within seven days if both name one
    number; and if the announcement names the carrier, or the purchase expects
    it and the merchant tells of a delivery within 36 hours after the carrier
    spoke.  The parcel's consignor, if any, must be the merchant, and the
    purchase may have no other number of this carrier.  One candidate links,
    several are reviewed, and so is a parcel of low confidence.  Times meet by
    spans, so that a user with many rows is spread; a null time meets nothing.
    """
    clusters = rows.groupBy(*KEY).agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"), F.collect_set("consignor").alias("consignors"))
    numbered = F.length("anchor_tracking") >= LEAST_NUMBER
    # an announcement counts for the carrier that it names and for the one that its purchase expects
    announced = anchors.where("not delivers").join(purchases.select("purchase_id", "expected"), "purchase_id")
    announced = announced.withColumn("slug", F.explode(F.array_distinct(F.array_compact(F.array("anchor_slug", "expected")))))
    carried = rows.where("not delivered").select(*KEY, "carrier_at")
    near = interval_join(announced.where(F.col("anchor_confidence") >= ANCHOR), carried, ["user_id", "slug"], "anchor_at", "carrier_at", NEAR)
    near = near.where(~F.coalesce(numbered, F.lit(False)) | (F.col("anchor_tracking") == F.col("tracking")))
    named = announced.where(numbered & (F.col("anchor_confidence") >= NAMED_ANCHOR)).withColumn("tracking", F.col("anchor_tracking"))
    named = interval_join(named, carried, KEY, "anchor_at", "carrier_at", NAMED)
    told = [*KEY, "purchase_id", "anchor_slug"]
    pairs = near.select(*told).unionByName(named.select(*told)).groupBy(*KEY, "purchase_id").agg(F.bool_or(F.coalesce(F.col("anchor_slug") == F.col("slug"), F.lit(False))).alias("names_carrier"))
    # what the merchant said of a delivery, after a row of the same parcel
    after = pairs.select(*KEY, "purchase_id").join(anchors.where("delivers").drop("delivers"), ["user_id", "purchase_id"])
    trusted = ~F.coalesce(numbered, F.lit(False)) & (F.col("anchor_confidence") >= ANCHOR) | (F.col("anchor_tracking") == F.col("tracking")) & (F.col("anchor_confidence") >= NAMED_ANCHOR)
    after = interval_join(rows.select(*KEY, "carrier_at"), after.where(trusted), KEY, "carrier_at", "anchor_at", NEAR).select(*KEY, "purchase_id").distinct().withColumn("corroborated", F.lit(True))
    pairs = pairs.join(after, [*KEY, "purchase_id"], "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))
    pairs = pairs.join(purchases.drop("user_id"), "purchase_id").where(F.col("names_carrier") | (F.col("corroborated") & (F.col("expected") == F.col("slug"))))
    other = stored.toDF("s_purchase", "s_slug", "s_tracking")
    pairs = pairs.join(other, (F.col("purchase_id") == F.col("s_purchase")) & (F.col("slug") == F.col("s_slug")) & (F.col("tracking") != F.col("s_tracking")), "left_anti")
    same = lambda c: same_party(c, F.col("name")) | F.coalesce(same_party(c, F.col("legal")), F.lit(False))
    pairs = pairs.join(clusters.select(*KEY, "consignors"), KEY).where((F.size("consignors") == 0) | F.exists("consignors", same))
    one = pairs.groupBy(*KEY).agg(F.min("purchase_id").alias("low"), F.max("purchase_id").alias("high"), F.bool_or("corroborated").alias("corroborated"))
    decided = F.when(F.col("confidence") < CLUSTER, "review").when(F.col("low") == F.col("high"), "linkable").when(F.col("low").isNotNull(), "review").otherwise("unmatched")
    out = clusters.join(one, KEY, "left").withColumn("decision", decided)
    return out.select(*KEY, "n", "confidence", "decision", F.when(F.col("decision") == "linkable", F.col("low")).alias("purchase_id"), F.coalesce("corroborated", F.lit(False)).alias("corroborated"))


# fixed values: words of a merchant's name that say nothing of it
GENERIC = ("kft", "zrt", "bt", "nyrt", "ltd", "limited", "gmbh", "inc", "llc", "plc", "ag", "hu", "hungary", "magyarorszag")
# fixed values: a merchant's domain, the name that its parcels are sent under, and the carrier
VERIFIED = (("scitec.hu", "biotechusa", "foxpost"),)
WINDOW, SURE = 7 * 24, 0.95


def merchant_label(name: Column) -> Column:
    """The words of a name that tell merchants apart."""
    words = F.split(text_key(F.coalesce(name, F.lit(""))), " ")
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*GENERIC)), " ")


def aliases(name: Column, domain: Column) -> Column:
    """What a merchant may be called: its name, its domain, and its domain without the last part."""
    root = F.when(domain.contains("."), F.regexp_replace(domain, r"\.[^.]*$", "")).otherwise("")
    return F.array_distinct(F.filter(F.array(merchant_label(name), merchant_label(domain), merchant_label(root)), lambda x: x != ""))


def by_sender(purchases: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """user_id, slug, tracking, decision, purchase_id, confidence, status and lane: one row for each parcel that a carrier tells of.

    ``purchases``: purchase_id, user_id, merchant, domain, ordered_at, total,
    currency, purchase_confidence; ``anchors``: purchase_id, anchor_at, anchor,
    anchor_slug, a merchant's messages of a parcel; ``rows``: source_id,
    user_id, slug, tracking, carrier_at, confidence, event, phase, sender,
    cod and cod_currency of a carrier's messages.

    First lane: purchases whose merchant is the parcel's sender and sent word
    within seven days of one of the carrier's messages, of this carrier or of
    none.  Second, where there is none: parcels with two sources and physical
    progress, and purchases of a verified sender whose total is exactly what
    the carrier collects, ordered within seven days.  In either lane one
    purchase links and several are reviewed.  Senders and merchants meet by
    their names, which are few, amounts by cells; no parcel meets all
    purchases of its user.
    """
    label = rows.select(*KEY, merchant_label(F.col("sender")).alias("label")).distinct().where(F.length("label") >= 4)
    called = purchases.select("purchase_id", "user_id", F.explode(aliases(F.col("merchant"), F.col("domain"))).alias("alias"))
    alike = alike_names(label.select("label"), called.select("alias")).toDF("label", "alias")
    pairs = label.join(alike, "label").join(called, ["user_id", "alias"]).select(*KEY, "purchase_id").distinct()
    word = pairs.join(anchors, "purchase_id").where(F.col("anchor_slug").isNull() | (F.col("anchor_slug") == F.col("slug")))
    near = interval_join(word, rows.select(*KEY, "carrier_at"), KEY, "anchor_at", "carrier_at", WINDOW, symmetric=True)
    first = near.groupBy(*KEY, "purchase_id").agg(F.max("anchor").alias("anchor")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("purchase_id").alias("p"), F.max("anchor").alias("anchor"))
    physical = (F.col("event") == "delivery") | F.coalesce(F.col("phase").isNotNull() & (F.col("phase") != "shipment_created"), F.lit(False))
    clusters = rows.groupBy(*KEY).agg(F.max("confidence").alias("confidence"), F.bool_or(F.coalesce(F.col("phase") == "ready_for_pickup", F.lit(False))).alias("ready"), F.count_distinct("source_id").alias("n_sources"), F.bool_or(physical).alias("physical"))
    left = clusters.join(first, KEY, "left")
    # sums within a thousandth
    cell = lambda x: F.floor(x * 1000)
    open_ = left.where("n is null and n_sources >= 2 and physical").select(*KEY)
    known = rows.join(open_, KEY)
    brand = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(s).alias("label"), F.lit(c).alias("slug")) for d, s, c in VERIFIED])
    named = known.select(*KEY, merchant_label(F.col("sender")).alias("label"), F.explode(brand).alias("b")).where((F.col("label") == F.col("b.label")) & (F.col("slug") == F.col("b.slug"))).select(*KEY, F.col("b.domain").alias("domain")).distinct()
    due = known.where("cod is not null").select(*KEY, "cod", F.upper(F.trim("cod_currency")).alias("currency"), F.explode(F.array(*[cell(F.col("cod")) + k for k in (-1, 0, 1)])).alias("cell"))
    sure = purchases.where((F.col("purchase_confidence") >= SURE) & F.col("total").isNotNull()).select("purchase_id", "user_id", "domain", "ordered_at", "total", "purchase_confidence", F.upper(F.trim("currency")).alias("currency"), cell(F.col("total")).alias("cell"))
    exact = named.join(due, KEY).join(sure, ["user_id", "domain", "currency", "cell"]).where(F.abs(F.col("cod") - F.col("total")) < 0.001).select(*KEY, "purchase_id", "ordered_at", "purchase_confidence").distinct()
    exact = interval_join(exact, known.select(*KEY, "carrier_at"), KEY, "ordered_at", "carrier_at", WINDOW, symmetric=True)
    second = exact.groupBy(*KEY).agg(F.count_distinct("purchase_id").alias("n_2"), F.min("purchase_id").alias("p_2"), F.max("purchase_confidence").alias("anchor_2"))
    out = left.join(second, KEY, "left").withColumn("lane", F.when(F.col("n").isNotNull(), 1).when(F.col("n_2").isNotNull(), 2))
    n, p, anchor = F.coalesce("n", "n_2"), F.coalesce("p", "p_2"), F.coalesce("anchor", "anchor_2")
    decided = F.when(n == 1, "linkable").when(n > 1, "review").otherwise("unmatched")
    return out.select(*KEY, decided.alias("decision"), F.when(n == 1, p).alias("purchase_id"), F.when(n == 1, F.least("confidence", anchor)).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("ready"), "ready_for_pickup").otherwise("in_transit").alias("status"), "lane")


def by_cluster(invoices: DataFrame, shipments: DataFrame, rows: DataFrame, sources: int = 2, letters: int = 6) -> DataFrame:
    """invoice_id, slug, tracking and n_rows: of invoices whose shipment has no number the one parcel of a carrier that must be theirs.

    ``invoices``: invoice_id, user_id, at, merchant and legal (compact names);
    ``shipments``: invoice_id, shipment_id, s_at; ``rows``: a carrier's
    messages: source_id, user_id, slug, tracking, c_at, physical, sender
    (compact), cod, cod_currency.  A parcel counts for a shipment by its
    messages within seven days of shipment and invoice: two sources, physical
    progress, one sum to collect throughout, and a sender that is the merchant.
    Only where one shipment of the invoice has such a parcel, and that one
    only, it is linked; more of either block it.  Parcels and invoices of a
    user meet by names, then by spans of time.
    """
    label = rows.select(*KEY, F.col("sender").alias("label")).where(F.length("sender") >= letters).distinct()
    called = invoices.select("invoice_id", "user_id", F.explode(F.array_distinct(F.array_compact(F.array("merchant", "legal")))).alias("alias")).where(F.length("alias") >= letters)
    alike = alike_names(label.select("label"), called.select("alias"), least=letters).toDF("label", "alias")
    pairs = label.join(alike, "label").join(called, ["user_id", "alias"]).select(*KEY, "invoice_id").distinct()
    both = pairs.join(shipments, "invoice_id").join(invoices.drop("user_id"), "invoice_id")
    met = interval_join(both, rows, KEY, "s_at", "c_at", WINDOW, symmetric=True).where(F.abs(micros(F.col("c_at")) - micros(F.col("at"))) <= WINDOW * 3_600_000_000)
    named = lambda x: F.coalesce((F.length("sender") >= letters) & (F.length(x) >= letters) & (F.col("sender").contains(x) | x.contains(F.col("sender"))), F.lit(False))
    currency = F.nullif(F.upper(F.trim("cod_currency")), F.lit(""))
    sums = F.when(currency.isNotNull(), F.col("cod"))
    found = met.groupBy("invoice_id", "shipment_id", *KEY).agg(
        F.count_distinct("source_id").alias("n_sources"), F.count(F.lit(1)).alias("n_rows"), F.bool_or("physical").alias("moved"), F.min(sums).alias("low"), F.max(sums).alias("high"), F.min(F.when(F.col("cod").isNotNull(), currency)).alias("coin"), F.max(F.when(F.col("cod").isNotNull(), currency)).alias("last_coin"),
        F.bool_or(named(F.col("merchant")) | named(F.col("legal"))).alias("named"),
    ).where((F.col("n_sources") >= sources) & F.col("moved") & (F.col("high") - F.col("low") < 0.001) & (F.col("coin") == F.col("last_coin")) & F.col("named"))
    each = found.groupBy("invoice_id", "shipment_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("slug", "tracking", "n_rows")).alias("one"))
    return each.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("shipments"), F.max("n").alias("parcels"), F.min("one").alias("one")).where("shipments = 1 and parcels = 1").select("invoice_id", "one.*")
