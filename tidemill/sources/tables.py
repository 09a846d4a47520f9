"""Parquet tables of a folder, and evidence rows made from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Event types of the event table, and what they stand for.
EVENTS = {"purchase": "order_created", "click": "shipment", "view": "order_updated", "signup": "payment_completed", "error": "invoice_or_receipt"}


PHASES, SLUGS = ("created", "shipped", "in_transit", None, "out_for_delivery", "ready_for_pickup", "delivered"), ("gls", "dpd", "foxpost", None)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, user_id, received_at, event, confidence, k, order_key, role, value, sender, merchant, phase and slug: one row for each event."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.select(
        F.col("event_id").alias("source_id"), "user_id", F.col("ts").alias("received_at"), kind[F.col("event_type")].alias("event"),
        F.round(F.least(F.lit(1.0), 0.6 + F.col("value") / 250), 4).alias("confidence"), k.alias("k"), (k % 10).alias("order_key"),
        F.when(k % 7 == 0, "carrier").when(k % 7 == 1, "public").otherwise("merchant").alias("role"), F.col("value"),
        F.when(k % 7 == 0, "gls-hungary.com").when(k % 7 == 1, "gmail.com").otherwise(F.concat(F.lit("shop"), k % 3, F.lit(".example.com"))).alias("sender"), F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("Shop "), k % 3)).alias("merchant"),
        F.element_at(F.array(*[F.lit(x) for x in PHASES]), (F.col("event_id") % len(PHASES) + 1).cast("int")).alias("phase"), F.element_at(F.array(*[F.lit(x) for x in SLUGS]), (k % len(SLUGS) + 1).cast("int")).alias("slug"),
    )


#: The same rows in DuckDB.
EVIDENCE_SQL = """
    ev AS (SELECT event_id AS source_id, user_id, ts AS received_at, value,
        CASE event_type WHEN 'purchase' THEN 'order_created' WHEN 'click' THEN 'shipment' WHEN 'view' THEN 'order_updated' WHEN 'signup' THEN 'payment_completed' WHEN 'error' THEN 'invoice_or_receipt' END AS event,
        round(least(1.0, 0.6 + value / 250), 4) AS confidence, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS order_key,
        CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 WHEN 0 THEN 'carrier' WHEN 1 THEN 'public' ELSE 'merchant' END AS role,
        CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 WHEN 0 THEN 'gls-hungary.com' WHEN 1 THEN 'gmail.com' ELSE 'shop' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 || '.example.com' END AS sender,
        CASE WHEN event_id % 11 > 0 THEN 'Shop ' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 END AS merchant, (['created', 'shipped', 'in_transit', NULL, 'out_for_delivery', 'ready_for_pickup', 'delivered'])[event_id % 7 + 1] AS phase,
        (['gls', 'dpd', 'foxpost', NULL])[CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1] AS slug FROM events)"""
