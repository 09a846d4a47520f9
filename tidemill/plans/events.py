"""Queries over evidence rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import backoff_minutes, boosted, clamp4, days_apart, micros
from ..functions.text import dedupe_key
from ..operators import merge
from ..operators.joins import guarded, interval_join
from ..operators.resolve import latest
from ..sources.messages import disposition
from ..sources.tables import EVIDENCE_SQL, evidence, table
from .registry import query

E = f"WITH {EVIDENCE_SQL}"
AS_OF = "TIMESTAMP_NTZ '2024-01-25 00:00:00'"


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_per_user(spark, d):
    return latest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, min(ts) FILTER (WHERE event_type = 'purchase') AS first_purchase_at FROM events GROUP BY 1")
def first_last_event_times(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("first_purchase_at"))


@query(E + """, a AS (SELECT source_id AS anchor_id, user_id, k, received_at AS anchor_at FROM ev WHERE event = 'order_created'), b AS (SELECT source_id AS carrier_id, user_id, k AS carrier_k, received_at AS carrier_at FROM ev WHERE event = 'shipment')
    SELECT anchor_id, count(*) AS n, min(carrier_id) AS first_carrier, count(*) FILTER (WHERE k = carrier_k) AS n_same, min(epoch_us(carrier_at) - epoch_us(anchor_at)) / 3600e6 AS lag_hours FROM a JOIN b USING (user_id) WHERE carrier_at BETWEEN anchor_at AND anchor_at + INTERVAL 36 HOUR GROUP BY 1""")
def bridge_interval_directional(spark, d):
    e = evidence(spark, d)
    a = e.where("event = 'order_created'").select(F.col("source_id").alias("anchor_id"), "user_id", "k", F.col("received_at").alias("anchor_at"))
    b = e.where("event = 'shipment'").select(F.col("source_id").alias("carrier_id"), "user_id", F.col("k").alias("carrier_k"), F.col("received_at").alias("carrier_at"))
    return interval_join(a, b, ["user_id"], "anchor_at", "carrier_at", 36).groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("carrier_id").alias("first_carrier"), F.count_if(F.col("k") == F.col("carrier_k")).alias("n_same"), (F.min(micros(F.col("carrier_at")) - micros(F.col("anchor_at"))) / 3_600e6).alias("lag_hours"))


@query(E + """, a AS (SELECT * FROM ev WHERE event = 'invoice_or_receipt'), b AS (SELECT * FROM ev WHERE event = 'shipment')
    SELECT a.source_id AS anchor_id, count(b.source_id) AS n FROM a JOIN b ON a.user_id = b.user_id AND a.order_key = b.order_key AND b.received_at BETWEEN a.received_at - INTERVAL 7 DAY AND a.received_at + INTERVAL 7 DAY GROUP BY 1""")
def bridge_interval_symmetric(spark, d):
    e = evidence(spark, d)
    a = e.where("event = 'invoice_or_receipt'").select(F.col("source_id").alias("anchor_id"), "user_id", "order_key", F.col("received_at").alias("a_at"))
    b = e.where("event = 'shipment'").select(F.col("source_id").alias("b_id"), "user_id", "order_key", F.col("received_at").alias("b_at"))
    return interval_join(a, b, ["user_id", "order_key"], "a_at", "b_at", 168, symmetric=True).groupBy("anchor_id").agg(F.count("b_id").alias("n"))


@query(E + """, a AS (SELECT * FROM ev WHERE event = 'invoice_or_receipt' AND confidence >= 0.65), b AS (SELECT * FROM ev WHERE event <> 'invoice_or_receipt' AND confidence >= 0.75)
    SELECT a.source_id, count(*) AS n_support, count(DISTINCT b.event) AS n_kinds, count(*) FILTER (WHERE b.event = 'shipment' AND b.confidence >= 0.85 AND abs(epoch_us(b.received_at) - epoch_us(a.received_at)) <= 7 * 86400000000) AS n_carrier FROM a JOIN b ON a.user_id = b.user_id AND a.k = b.k AND b.received_at BETWEEN a.received_at - INTERVAL 14 DAY AND a.received_at + INTERVAL 14 DAY GROUP BY 1""")
def chain_14d_support(spark, d):
    e = evidence(spark, d)
    a = e.where("event = 'invoice_or_receipt' and confidence >= 0.65").select("source_id", "user_id", "k", F.col("received_at").alias("a_at"))
    b = e.where("event <> 'invoice_or_receipt' and confidence >= 0.75").select("user_id", "k", "event", F.col("confidence").alias("b_confidence"), F.col("received_at").alias("b_at"))
    proof = F.expr("event = 'shipment' and b_confidence >= 0.85") & (days_apart(F.col("a_at"), F.col("b_at")) <= 7)
    return interval_join(a, b, ["user_id", "k"], "a_at", "b_at", 336, symmetric=True).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_support"), F.size(F.collect_set("event")).cast("long").alias("n_kinds"), F.count_if(proof).alias("n_carrier"))


@query(E + """, p AS (SELECT DISTINCT a.source_id, b.source_id AS candidate FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.event = 'payment_completed' AND abs(a.value - b.value) <= 1 AND b.received_at BETWEEN a.received_at AND a.received_at + INTERVAL 14 DAY WHERE a.event = 'order_created')
    SELECT source_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(candidate) END AS only, CASE WHEN count(*) = 1 THEN 'linkable' ELSE 'review' END AS decision FROM p GROUP BY 1""")
def unique_candidate_guard(spark, d):
    e = evidence(spark, d)
    a = e.where("event = 'order_created'").select("source_id", "user_id", F.col("value").alias("amount"), F.col("received_at").alias("a_at"))
    b = e.where("event = 'payment_completed'").select(F.col("source_id").alias("candidate"), "user_id", F.col("value").alias("paid"), F.col("received_at").alias("b_at"))
    return guarded(interval_join(a, b, ["user_id"], "a_at", "b_at", 336).where("abs(amount - paid) <= 1"), ["source_id"], "candidate")


@query(E + """ SELECT source_id, confidence FROM ev a WHERE event = 'invoice_or_receipt' AND confidence >= 0.65 AND confidence < 0.85 AND EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.order_key = a.order_key AND b.event = 'shipment' AND b.confidence >= 0.7)""")
def independent_support_semi(spark, d):
    e = evidence(spark, d)
    support = e.where("event = 'shipment' and confidence >= 0.7").select("user_id", "order_key").distinct()
    return e.where("event = 'invoice_or_receipt' and confidence >= 0.65 and confidence < 0.85").join(support, ["user_id", "order_key"], "left_semi").select("source_id", "confidence")


@query(E + " SELECT user_id, k, source_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY confidence DESC, source_id) AS r FROM ev) WHERE r = 1")
def max_conf_link_dedupe(spark, d):
    return evidence(spark, d).groupBy("user_id", "k").agg(F.max_by(F.struct("source_id", "confidence"), F.struct("confidence", -F.col("source_id"))).alias("x")).select("user_id", "k", "x.*")


@query(E + """, s AS (SELECT user_id, k, max(CASE event WHEN 'shipment' THEN 2 WHEN 'invoice_or_receipt' THEN 4 ELSE 1 END) AS r, min(received_at) FILTER (WHERE event = 'shipment') AS shipped_at, max(received_at) AS last_event_at FROM ev GROUP BY 1, 2)
    SELECT user_id, k, CASE r WHEN 4 THEN 'delivered' WHEN 2 THEN 'in_transit' ELSE 'incoming' END AS status, shipped_at, last_event_at FROM s""")
def event_state_fold(spark, d):
    status = F.when(F.col("event") == "shipment", "in_transit").when(F.col("event") == "invoice_or_receipt", "delivered").otherwise("incoming")
    return evidence(spark, d).groupBy("user_id", "k").agg(F.max_by(status, merge.rank(status)).alias("status"), F.min(F.when(F.col("event") == "shipment", F.col("received_at"))).alias("shipped_at"), F.max("received_at").alias("last_event_at"))


_FOLD = E + " SELECT user_id, order_key, {f}(CASE WHEN event = 'shipment' THEN k END, (received_at, source_id)) FILTER (WHERE event = 'shipment') AS carrier_k, {f}(CASE WHEN confidence >= 0.8 THEN value END, (received_at, source_id)) FILTER (WHERE confidence >= 0.8) AS amount FROM ev GROUP BY 1, 2"


def _fold(spark, d, first):
    e = evidence(spark, d).select("user_id", "order_key", "received_at", "source_id", F.when(F.col("event") == "shipment", F.col("k")).alias("carrier_k"), F.when(F.col("confidence") >= 0.8, F.col("value")).alias("amount"))
    return merge.folded(e, ["user_id", "order_key"], ["carrier_k", "amount"], ["received_at", "source_id"], first)


@query(_FOLD.format(f="arg_min"))
def first_nonnull_merge(spark, d):
    return _fold(spark, d, True)


@query(_FOLD.format(f="arg_max"))
def last_nonnull_merge(spark, d):
    return _fold(spark, d, False)


@query(E + """ SELECT user_id, k, bool_or(event = 'invoice_or_receipt') AS hidden, arg_max(value, (received_at, source_id)) FILTER (WHERE event = 'order_updated') AS price FROM ev GROUP BY 1, 2""")
def override_replay(spark, d):
    at = F.when(F.col("event") == "order_updated", F.struct("received_at", "source_id"))
    return evidence(spark, d).groupBy("user_id", "k").agg(F.bool_or(F.col("event") == "invoice_or_receipt").alias("hidden"), F.max_by("value", at).alias("price"))


_STATE = "CASE WHEN event = 'order_created' AND confidence >= 0.9 THEN 'in_record' WHEN event = 'invoice_or_receipt' AND confidence < 0.65 THEN 'error' WHEN event = 'order_created' AND confidence >= 0.8 THEN 'can_add' WHEN event = 'order_created' THEN 'uncertain' WHEN role = 'public' THEN 'not_purchase' ELSE 'related' END"


@query(E + f", s AS (SELECT user_id, {_STATE} AS state FROM ev) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE state = 'in_record') AS n_in_record, count(*) FILTER (WHERE state = 'can_add') AS n_can_add, count(*) FILTER (WHERE state = 'uncertain') AS n_uncertain, count(*) FILTER (WHERE state = 'not_purchase') AS n_not_purchase, count(*) FILTER (WHERE state = 'related') AS n_related, count(*) FILTER (WHERE state = 'error') AS n_error FROM s GROUP BY 1")
def audit_state_summary(spark, d):
    s = evidence(spark, d).select("user_id", F.expr(_STATE).alias("state"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("state") == x).alias(f"n_{x}") for x in ("in_record", "can_add", "uncertain", "not_purchase", "related", "error")])


@query("SELECT event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def outcome_histogram(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_distinct("user_id").alias("users"))


@query(E + " SELECT source_id, least(greatest(k % 13, 1), 10) AS wait_minutes FROM ev WHERE (event = 'shipment' AND received_at <= TIMESTAMP '2024-01-10') OR (event = 'order_created' AND received_at < TIMESTAMP '2024-01-05' AND k > 50)")
def due_or_stale_jobs(spark, d):
    due = (F.col("event") == "shipment") & (F.col("received_at") <= F.expr("TIMESTAMP_NTZ '2024-01-10'"))
    stale = (F.col("event") == "order_created") & (F.col("received_at") < F.expr("TIMESTAMP_NTZ '2024-01-05'")) & (F.col("k") > 50)
    return evidence(spark, d).where(due | stale).select("source_id", backoff_minutes(F.col("k") % 13).alias("wait_minutes"))


@query(E + " SELECT user_id, count(*) AS n FROM ev WHERE received_at >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY AND received_at < TIMESTAMP '2024-01-25' GROUP BY 1")
def lookback_window(spark, d):
    return evidence(spark, d).where(f"received_at >= {AS_OF} - INTERVAL 7 DAYS and received_at < {AS_OF}").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(E + " SELECT DISTINCT user_id, strftime(received_at, '%Y-%m') AS month, sha256(concat_ws('|', user_id, order_key, strftime(received_at, '%Y-%m'))) AS key FROM ev")
def month_bucket_dedupe_key(spark, d):
    month = F.date_format("received_at", "yyyy-MM")
    return evidence(spark, d).select("user_id", month.alias("month"), dedupe_key(F.col("user_id"), F.col("order_key"), month).alias("key")).distinct()


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(14, 2)) AS k, json_extract_string(props, '$.missing') IS NULL AS no_missing FROM events")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("decimal(14,2)").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("no_missing"))


@query(E + " SELECT user_id, k, count(*) AS n, count(DISTINCT source_id) AS sources, max(confidence) AS confidence, min(received_at) AS first_at, count(DISTINCT order_key) = 1 AS consistent FROM ev WHERE event = 'shipment' AND k >= 10 GROUP BY 1, 2 HAVING count(*) >= 1 AND max(confidence) >= 0.75")
def carrier_clusters(spark, d):
    g = evidence(spark, d).where("event = 'shipment' and k >= 10").groupBy("user_id", "k")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("sources"), F.max("confidence").alias("confidence"), F.min("received_at").alias("first_at"), F.coalesce(F.min("order_key") == F.max("order_key"), F.lit(False)).alias("consistent")).where("confidence >= 0.75")


@query(E + """, g AS (SELECT user_id, order_key, max(confidence) FILTER (WHERE event = 'order_created') AS anchor, max(confidence) FILTER (WHERE event IN ('shipment', 'order_updated')) AS trusted, count(*) FILTER (WHERE event IN ('shipment', 'order_updated') AND confidence >= 0.72) AS n_support FROM ev GROUP BY 1, 2)
    SELECT user_id, order_key, CASE WHEN anchor >= 0.85 AND trusted >= 0.74 THEN 'create' WHEN anchor >= 0.8 AND trusted >= 0.72 AND n_support >= 2 THEN 'create_supported' ELSE 'review' END AS decision, CASE WHEN anchor >= 0.85 AND trusted >= 0.74 THEN round(least(0.97, anchor + 0.08), 4) WHEN anchor >= 0.8 AND trusted >= 0.72 AND n_support >= 2 THEN round(least(0.95, anchor + 0.08), 4) ELSE anchor END AS confidence FROM g WHERE anchor >= 0.7""")
def review_resolution(spark, d):
    support = F.col("event").isin("shipment", "order_updated")
    g = evidence(spark, d).groupBy("user_id", "order_key").agg(F.max(F.when(F.col("event") == "order_created", F.col("confidence"))).alias("anchor"), F.max(F.when(support, F.col("confidence"))).alias("trusted"), F.count_if(support & (F.col("confidence") >= 0.72)).alias("n_support")).where("anchor >= 0.7")
    strong, supported = F.expr("anchor >= 0.85 and trusted >= 0.74"), F.expr("anchor >= 0.8 and trusted >= 0.72 and n_support >= 2")
    return g.select("user_id", "order_key", F.when(strong, "create").when(supported, "create_supported").otherwise("review").alias("decision"), F.when(strong, boosted(F.col("anchor"), cap=0.97)).when(supported, boosted(F.col("anchor"), cap=0.95)).otherwise(F.col("anchor")).alias("confidence"))


@query(E + """, c AS (SELECT user_id, order_key, k, count(DISTINCT source_id) AS sources, min(received_at) AS first_at FROM ev WHERE event = 'shipment' GROUP BY 1, 2, 3), m AS (SELECT user_id, order_key, count(*) AS clusters, max(sources) AS sources, min(first_at) AS first_at FROM c GROUP BY 1, 2)
    SELECT user_id, order_key, clusters, CASE WHEN clusters > 1 THEN 'blocked' WHEN sources >= 2 THEN 'reconstruct' ELSE 'review' END AS decision, first_at FROM m WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = m.user_id AND ev.order_key = m.order_key AND event = 'order_created' AND confidence >= 0.9)""")
def reconstruction_candidates(spark, d):
    e = evidence(spark, d)
    c = e.where("event = 'shipment'").groupBy("user_id", "order_key", "k").agg(F.count_distinct("source_id").alias("sources"), F.min("received_at").alias("first_at"))
    m = c.groupBy("user_id", "order_key").agg(F.count(F.lit(1)).alias("clusters"), F.max("sources").alias("sources"), F.min("first_at").alias("first_at"))
    m = m.join(e.where("event = 'order_created' and confidence >= 0.9").select("user_id", "order_key").distinct(), ["user_id", "order_key"], "left_anti")
    return m.select("user_id", "order_key", "clusters", F.when(F.col("clusters") > 1, "blocked").when(F.col("sources") >= 2, "reconstruct").otherwise("review").alias("decision"), "first_at")


@query(E + " SELECT source_id, CASE WHEN k % 5 = 0 THEN 'reject' WHEN k % 3 = 0 THEN 'quarantine' ELSE 'accept' END AS disposition FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.user_id = ev.user_id AND o.k = ev.k AND o.event = 'order_created')")
def disposition_policy(spark, d):
    e = evidence(spark, d)
    free = e.join(e.where("event = 'order_created'").select("user_id", "k").distinct(), ["user_id", "k"], "left_anti")
    return free.select("source_id", disposition(F.when(F.col("k") % 5 == 0, "FAIL").otherwise("PASS"), F.when(F.col("k") % 3 == 0, "FAIL").otherwise("PASS")).alias("disposition"))


@query(E + " SELECT source_id, round(greatest(0.0, least(1.0, confidence + 0.05 - 0.1 * (k % 3))), 4) AS clamped, round(least(0.99, confidence + 0.08), 4) AS boosted FROM ev")
def confidence_math(spark, d):
    return evidence(spark, d).select("source_id", clamp4(F.col("confidence") + 0.05 - 0.1 * (F.col("k") % 3)).alias("clamped"), boosted(F.col("confidence")).alias("boosted"))


@query(E + """, o AS (SELECT DISTINCT user_id, strftime(received_at, '%Y-%m') AS month FROM ev WHERE event = 'invoice_or_receipt'), x AS (SELECT DISTINCT user_id FROM ev WHERE event = 'order_created' AND k = 5)
    SELECT user_id, month, sha256(concat_ws('|', user_id, 'targeted', month)) AS key FROM o WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = o.user_id)""")
def followup_jobs(spark, d):
    e = evidence(spark, d)
    o = e.where("event = 'invoice_or_receipt'").select("user_id", F.date_format("received_at", "yyyy-MM").alias("month")).distinct()
    return o.join(e.where("event = 'order_created' and k = 5").select("user_id").distinct(), "user_id", "left_anti").withColumn("key", dedupe_key(F.col("user_id"), F.lit("targeted"), F.col("month")))


@query(E + """ SELECT 'observe' AS mode, event, count(*) FILTER (WHERE confidence >= 0.9) AS would_write, 0 AS written FROM ev GROUP BY 2 UNION ALL SELECT 'write', event, count(*) FILTER (WHERE confidence >= 0.9), count(*) FILTER (WHERE confidence >= 0.9) FROM ev GROUP BY 2""")
def recovery_outcomes(spark, d):
    g = evidence(spark, d).groupBy("event").agg(F.count_if(F.col("confidence") >= 0.9).alias("would_write"))
    return g.select(F.explode(F.array(F.lit("observe"), F.lit("write"))).alias("mode"), "event", "would_write").withColumn("written", F.when(F.col("mode") == "write", F.col("would_write")).otherwise(0))


@query(E + " SELECT source_id, array_to_string(list_filter([CASE WHEN confidence >= 0.9 THEN 'strong' END, CASE WHEN role = 'carrier' THEN 'carrier' END, CASE WHEN k > 50 THEN 'late' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ev")
def array_and_json_shape(spark, d):
    from ..functions.text import reasons

    return evidence(spark, d).select("source_id", F.array_join(reasons(("strong", F.col("confidence") >= 0.9), ("carrier", F.col("role") == "carrier"), ("late", F.col("k") > 50)), ",").alias("reasons"))