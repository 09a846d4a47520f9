"""Queries of the write algebra: checked upserts, enrichment, and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import identifier
from ..operators import merge
from ..sources.tables import EVIDENCE_SQL, evidence, table
from .registry import query

E = f"WITH {EVIDENCE_SQL}"


@query("""WITH u AS (SELECT o_custkey AS user_id, max(o_totalprice) AS total, min(o_orderdate) AS since FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), n AS (SELECT o_custkey AS user_id, max(o_totalprice) AS total, min(o_orderdate) AS since FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
    SELECT user_id, coalesce(n.total, u.total) AS total, coalesce(u.since, n.since) AS since FROM u FULL JOIN n USING (user_id)""")
def purchase_upsert_merge(spark, d):
    """Each user's purchases of two periods: the later total wins, the earlier date stays.  Both together are all orders."""
    orders = table(spark, d, "orders")
    side = lambda when: orders.where(f"o_orderdate {when} TIMESTAMP_NTZ '1996-01-01 00:00:00'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_totalprice").alias("total"), F.min("o_orderdate").alias("since"))
    return merge.merged(side("<"), side(">="), ["user_id"], {"total": "new", "since": "old"})


_NEW = """, t AS (SELECT source_id AS purchase_id, user_id, sender, lower('AB-' || order_key) AS ident FROM ev WHERE event = 'order_created' AND role = 'merchant' AND confidence >= 0.95 QUALIFY row_number() OVER (PARTITION BY user_id, sender, order_key ORDER BY source_id) = 1),
    n AS (SELECT source_id, CASE WHEN source_id % 19 = 0 THEN user_id + 1 ELSE user_id END AS claimed, user_id, sender, CASE WHEN source_id % 2 = 0 THEN 'AB-' || order_key ELSE 'ab-' || order_key END AS order_number, confidence FROM ev WHERE event = 'order_created' AND role = 'merchant' AND confidence < 0.95),
    ok AS (SELECT *, lower(order_number) AS ident FROM n WHERE claimed = user_id), f AS (SELECT user_id, sender, ident, min(source_id) AS first_id, count(*) AS n_sources, max(confidence) AS confidence FROM ok GROUP BY 1, 2, 3)"""


@query(E + _NEW + """ SELECT f.user_id, f.sender, f.ident, coalesce(t.purchase_id, f.first_id) AS purchase_id, CASE WHEN t.purchase_id IS NULL THEN 'created' ELSE 'existing' END AS outcome, n_sources, f.confidence FROM f LEFT JOIN t USING (user_id, sender, ident)
    UNION ALL SELECT user_id, sender, lower(order_number), NULL, 'foreign_source', 1, confidence FROM n WHERE claimed <> user_id""")
def ownership_checked_create(spark, d):
    """New purchases by their identity, letters in either case: created once, found again, or rejected where a source is another user's."""
    e = evidence(spark, d).where("event = 'order_created' and role = 'merchant'")
    keys = ["user_id", "sender", "ident"]
    ident = F.lower(F.concat(F.lit("AB-"), "order_key"))
    target = e.where("confidence >= 0.95").groupBy("user_id", "sender", ident.alias("ident")).agg(F.min("source_id").alias("old_id"))
    new = e.where("confidence < 0.95").select("source_id", F.when(F.col("source_id") % 19 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("claimed"), "user_id", "sender", ident.alias("ident"), "confidence")
    sources = evidence(spark, d).select("source_id", F.col("user_id").alias("owner"))
    checked = new.join(sources, "source_id")
    own = checked.where("claimed = owner").groupBy(*keys).agg(F.min("source_id").alias("first_id"), F.count(F.lit(1)).alias("n_sources"), F.max("confidence").alias("confidence"))
    found = own.join(target, keys, "left").select(*keys, F.coalesce("old_id", "first_id").alias("purchase_id"), F.when(F.col("old_id").isNull(), "created").otherwise("existing").alias("outcome"), "n_sources", "confidence")
    rejected = checked.where("claimed <> owner").select(*keys, F.lit(None).cast("long").alias("purchase_id"), F.lit("foreign_source").alias("outcome"), F.lit(1).cast("long").alias("n_sources"), "confidence")
    return found.unionByName(rejected)


@query("""WITH o AS (SELECT l_orderkey, l_suppkey, min(l_partkey) AS tracking FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), n AS (SELECT l_orderkey, l_suppkey, min(l_partkey) AS tracking, max(CASE l_linestatus WHEN 'F' THEN 'delivered' ELSE 'in_transit' END) AS status FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2),
    el AS (SELECT DISTINCT l_suppkey, tracking, l_orderkey AS held_by FROM o)
    SELECT n.l_orderkey, n.l_suppkey, n.tracking, CASE WHEN count(el.held_by) > 0 THEN 'conflict' WHEN any_value(o.tracking) IS NOT NULL AND any_value(o.tracking) <> n.tracking THEN 'other_tracking' ELSE 'linked' END AS outcome FROM n LEFT JOIN el ON el.l_suppkey = n.l_suppkey AND el.tracking = n.tracking AND el.held_by <> n.l_orderkey LEFT JOIN o ON o.l_orderkey = n.l_orderkey AND o.l_suppkey = n.l_suppkey GROUP BY n.l_orderkey, n.l_suppkey, n.tracking""")
def shipment_conflicts(spark, d):
    """New shipments: those whose number another purchase holds are set aside, those that would change a number as well."""
    items = table(spark, d, "lineitem")
    old = items.where("l_linenumber <= 3").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_partkey").alias("held"))
    new = items.where("l_linenumber > 3").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_partkey").alias("tracking"))
    holders = old.groupBy("l_suppkey", F.col("held").alias("tracking")).agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))
    j = new.join(holders, ["l_suppkey", "tracking"], "left").join(old, ["l_orderkey", "l_suppkey"], "left")
    elsewhere = F.coalesce((F.col("low") != F.col("l_orderkey")) | (F.col("high") != F.col("l_orderkey")), F.lit(False))
    return j.select("l_orderkey", "l_suppkey", "tracking", F.when(elsewhere, "conflict").when(F.col("held") != F.col("tracking"), "other_tracking").otherwise("linked").alias("outcome"))


# fixed values: what a payment's status may be
PAYMENT_STATUSES = ("paid", "pending", "unpaid", "failed", "refunded", "cash_on_delivery", "unknown")
_ORDER = "order_number string, currency string, payment_status string, total string, shipping_amount double, carrier string"


def code(c: Column) -> Column:
    """A currency of three letters in capitals; anything else is null."""
    up = F.upper(F.trim(c))
    return F.when(up.rlike("^[A-Z]{3}$"), up)


_PATCH = """, p AS (SELECT source_id AS purchase_id, user_id, k, lower('O-' || k) AS order_number, CASE WHEN source_id % 3 > 0 THEN value END AS total, CASE WHEN source_id % 4 > 0 THEN 'EUR' END AS currency, CASE WHEN source_id % 5 = 0 THEN 'pending' END AS payment_status, NULL::TIMESTAMP AS paid_at, slug AS carrier FROM ev WHERE event = 'order_created' AND role = 'merchant' QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY source_id) = 1),
    s AS (SELECT source_id, user_id, k, received_at, CASE event WHEN 'order_updated' THEN 'order' ELSE 'payment' END AS kind, CASE WHEN source_id % 7 = 0 THEN ' o-x ' ELSE ' O-' || k || ' ' END AS order_number, (['huf', 'EURO', ' usd ', NULL])[source_id % 4 + 1] AS currency, (['Paid', 'odd', 'failed', ' '])[source_id % 4 + 1] AS status, CASE source_id % 5 WHEN 0 THEN '-3' WHEN 1 THEN 'x' ELSE CAST(source_id % 100 AS VARCHAR) END AS amount, source_id % 9 > 0 AS trusted FROM ev WHERE event IN ('order_updated', 'payment_completed') AND role = 'merchant'),
    c AS (SELECT *, CASE WHEN regexp_matches(upper(trim(currency)), '^[A-Z]{3}$') THEN upper(trim(currency)) END AS cur, CASE WHEN lower(trim(status)) IN ('paid', 'pending', 'unpaid', 'failed', 'refunded', 'cash_on_delivery', 'unknown') THEN lower(trim(status)) END AS st, CASE WHEN TRY_CAST(amount AS DOUBLE) >= 0 THEN TRY_CAST(amount AS DOUBLE) END AS am FROM s WHERE trusted),
    m AS (SELECT p.purchase_id, c.* FROM p JOIN c USING (user_id, k) WHERE lower(trim(c.order_number)) = p.order_number),
    l AS (SELECT purchase_id, arg_max(am, (received_at, source_id)) FILTER (WHERE kind = 'order' AND am IS NOT NULL) AS o_am, arg_max(cur, (received_at, source_id)) FILTER (WHERE kind = 'order' AND cur IS NOT NULL) AS o_cur, arg_min(am, (received_at, source_id)) FILTER (WHERE kind = 'payment' AND am IS NOT NULL) AS p_am, arg_min(cur, (received_at, source_id)) FILTER (WHERE kind = 'payment' AND cur IS NOT NULL) AS p_cur,
        arg_max(st, (received_at, source_id)) FILTER (WHERE st IS NOT NULL) AS st, min(received_at) FILTER (WHERE st = 'paid') AS paid_at, count(*) AS n FROM m GROUP BY 1)"""


@query(E + _PATCH + """ SELECT purchase_id, coalesce(o_am, p.total, p_am) AS total, coalesce(o_cur, p.currency, p_cur) AS currency, coalesce(st, p.payment_status) AS payment_status, l.paid_at, coalesce(n, 0) AS n_sources FROM p LEFT JOIN l USING (purchase_id)""")
def enrichment_and_payment_patch(spark, d):
    """Purchases with what trusted orders and payments say of them.

    An order's values overwrite, a payment's fill gaps; both must name the
    purchase's order.  Values come as JSON: no number, negative amounts, odd
    currencies and unknown statuses count as nothing.  Sources are folded by
    the time they came in.
    """
    e = evidence(spark, d).where("role = 'merchant'")
    i = F.col("source_id")
    p = e.where("event = 'order_created'").withColumn("first", F.struct("source_id", "value")).groupBy("user_id", "k").agg(F.min("first").alias("f"))
    i_p = F.col("f.source_id")
    p = p.select(i_p.alias("purchase_id"), "user_id", "k", F.lower(F.concat(F.lit("O-"), "k")).alias("ident"), F.when(i_p % 3 > 0, F.col("f.value")).alias("old_total"), F.when(i_p % 4 > 0, "EUR").alias("old_currency"), F.when(i_p % 5 == 0, "pending").alias("old_status"))
    nth = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v) + 1).cast("int"))
    payload = F.to_json(F.struct(
        F.when(i % 7 == 0, " o-x ").otherwise(F.concat(F.lit(" O-"), "k", F.lit(" "))).alias("order_number"), nth("huf", "EURO", " usd ", None).alias("currency"), nth("Paid", "odd", "failed", " ").alias("payment_status"),
        F.when(i % 5 == 0, "-3").when(i % 5 == 1, "x").otherwise((i % 100).cast("string")).alias("total"),
    ))
    s = e.where("event in ('order_updated', 'payment_completed')").select("source_id", "user_id", "k", "received_at", (F.col("event") == "order_updated").alias("is_order"), payload.alias("payload"), (i % 9 > 0).alias("trusted")).where("trusted")
    x = s.withColumn("j", F.from_json("payload", _ORDER))
    amount, status = F.col("j.total").try_cast("double"), F.lower(F.trim("j.payment_status"))
    x = x.select("user_id", "k", "received_at", "source_id", "is_order", F.lower(F.trim("j.order_number")).alias("ident"), code(F.col("j.currency")).alias("cur"), F.when(status.isin(*PAYMENT_STATUSES), status).alias("st"), F.when(amount >= 0, amount).alias("am"))
    m = x.join(p.select("purchase_id", "user_id", "k", "ident"), ["user_id", "k", "ident"])
    at = F.struct("received_at", "source_id")
    last = lambda c, ok: F.max_by(c, F.when(ok & F.col(c).isNotNull(), at))
    first = lambda c, ok: F.min_by(c, F.when(ok & F.col(c).isNotNull(), at))
    order = F.col("is_order")
    n = m.groupBy("purchase_id").agg(last("am", order).alias("o_am"), last("cur", order).alias("o_cur"), first("am", ~order).alias("p_am"), first("cur", ~order).alias("p_cur"), last("st", F.lit(True)).alias("st"), F.min(F.when(F.col("st") == "paid", F.col("received_at"))).alias("paid_at"), F.count(F.lit(1)).alias("n"))
    out = p.join(n, "purchase_id", "left")
    return out.select("purchase_id", F.coalesce("o_am", "old_total", "p_am").alias("total"), F.coalesce("o_cur", "old_currency", "p_cur").alias("currency"), F.coalesce("st", "old_status").alias("payment_status"), "paid_at", F.coalesce("n", F.lit(0)).alias("n_sources"))


@query(E + """, p AS (SELECT source_id AS purchase_id, user_id, sender, order_key, (['ordered', 'paid', 'processing', 'cancelled', 'delivered', 'delayed'])[source_id % 6 + 1] AS state FROM ev WHERE event = 'order_created' AND role = 'merchant' QUALIFY row_number() OVER (PARTITION BY user_id, sender, order_key ORDER BY source_id) = 1),
    l AS (SELECT p.purchase_id, ev.event, ev.received_at, CASE ev.event WHEN 'shipment' THEN 'shipment' ELSE 'delivery' END AS relation FROM p JOIN ev USING (user_id, sender, order_key) WHERE ev.event IN ('shipment', 'invoice_or_receipt') AND ev.confidence >= 0.85),
    a AS (SELECT purchase_id, bool_or(relation = 'delivery') AS d, bool_or(relation = 'shipment') AS s, min(received_at) FILTER (WHERE relation = 'delivery') AS delivered_at, min(received_at) FILTER (WHERE relation = 'shipment') AS shipped_at FROM l GROUP BY 1)
    SELECT purchase_id, state AS before, CASE WHEN state = 'cancelled' OR a.purchase_id IS NULL THEN state WHEN d THEN 'delivered' WHEN state IN ('processing', 'ordered', 'paid') THEN 'in_transit' ELSE state END AS after, CASE WHEN state <> 'cancelled' THEN delivered_at END AS delivered_at, CASE WHEN state <> 'cancelled' THEN shipped_at END AS shipped_at FROM p LEFT JOIN a USING (purchase_id)""")
def merchant_lifecycle_patch(spark, d):
    """Purchases after trusted links of their own merchant and order: the furthest state, and the earliest times."""
    e = evidence(spark, d).where("role = 'merchant'")
    keys = ["user_id", "sender", "order_key"]
    p = e.where("event = 'order_created'").groupBy(*keys).agg(F.min("source_id").alias("purchase_id"))
    state = F.element_at(F.array(*map(F.lit, ("ordered", "paid", "processing", "cancelled", "delivered", "delayed"))), (F.col("purchase_id") % 6 + 1).cast("int"))
    links = e.where("event in ('shipment', 'invoice_or_receipt') and confidence >= 0.85").withColumn("delivery", F.col("event") == "invoice_or_receipt")
    a = links.groupBy(*keys).agg(F.bool_or("delivery").alias("d"), F.min(F.when(F.col("delivery"), F.col("received_at"))).alias("delivered_at"), F.min(F.when(~F.col("delivery"), F.col("received_at"))).alias("shipped_at"))
    j = p.join(a, keys, "left").withColumn("before", state)
    after = F.when(F.col("before").isin(*merge.TERMINAL) | F.col("d").isNull(), F.col("before")).when(F.col("d"), "delivered").when(F.col("before").isin("processing", "ordered", "paid"), "in_transit").otherwise(F.col("before"))
    open_ = ~F.col("before").isin(*merge.TERMINAL)
    return j.select("purchase_id", "before", after.alias("after"), F.when(open_, F.col("delivered_at")).alias("delivered_at"), F.when(open_, F.col("shipped_at")).alias("shipped_at"))


@query(E + """, p AS (SELECT source_id AS purchase_id, user_id, sender, upper('N' || order_key || 'x') AS ident FROM ev WHERE event = 'order_created' AND role = 'merchant' AND confidence >= 0.85),
    a AS (SELECT source_id AS attachment_id, user_id, 'www.' || upper(sender) AS domain, CASE WHEN source_id % 8 > 0 THEN 'n-' || order_key || '/X' END AS order_number, (['application/pdf', 'image/png'])[source_id % 2 + 1] AS mime, CASE WHEN source_id % 10 > 0 THEN sha256(CAST(k AS VARCHAR)) END AS hash FROM ev WHERE event = 'invoice_or_receipt'),
    x AS (SELECT attachment_id, any_value(mime) AS mime, any_value(hash) AS hash, any_value(order_number) AS o, count(p.purchase_id) AS n, min(p.purchase_id) AS p FROM a LEFT JOIN p ON p.user_id = a.user_id AND p.sender = regexp_replace(lower(a.domain), '^www\\.', '') AND p.ident = upper(regexp_replace(a.order_number, '[^a-zA-Z0-9]', '', 'g')) GROUP BY 1)
    SELECT attachment_id, n, CASE WHEN mime <> 'application/pdf' OR hash IS NULL THEN 'rejected' WHEN o IS NULL OR n = 0 THEN 'unmatched' WHEN n > 1 THEN 'review' ELSE 'linkable' END AS decision, CASE WHEN mime = 'application/pdf' AND hash IS NOT NULL AND n = 1 THEN p END AS purchase_id FROM x""")
def attachment_guard(spark, d):
    """Attached invoices and the one purchase of their sender and order; without a hash, or of another type, they are rejected."""
    e, i = evidence(spark, d), F.col("source_id")
    p = e.where("event = 'order_created' and role = 'merchant' and confidence >= 0.85").groupBy("user_id", F.col("sender").alias("domain"), identifier(F.concat(F.lit("N"), "order_key", F.lit("x"))).alias("ident")).agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("p"))
    domain = F.regexp_replace(F.lower(F.concat(F.lit("www."), F.upper("sender"))), r"^www\.", "")
    ident = F.when(i % 8 > 0, identifier(F.concat(F.lit("n-"), "order_key", F.lit("/X"))))
    a = e.where("event = 'invoice_or_receipt'").select(i.alias("attachment_id"), "user_id", domain.alias("domain"), ident.alias("ident"), (i % 2 == 0).alias("pdf"), F.when(i % 10 > 0, F.sha2(F.col("k").cast("string"), 256)).alias("hash"))
    j = a.join(p, ["user_id", "domain", "ident"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    decided = F.when(~F.col("pdf") | F.col("hash").isNull(), "rejected").when(F.col("n") == 0, "unmatched").when(F.col("n") > 1, "review").otherwise("linkable")
    return j.select("attachment_id", "n", decided.alias("decision"), F.when(decided == "linkable", F.col("p")).alias("purchase_id"))


@query("""WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(14, 2))) AS products, CAST(round(count(*) * 1.5, 2) AS DECIMAL(14, 2)) AS shipping, CAST(round(sum(l_discount), 2) AS DECIMAL(14, 2)) AS discount, count(*) = count(l_extendedprice) AND min(l_returnflag) = max(l_returnflag) AS complete FROM lineitem GROUP BY 1),
    t AS (SELECT s.*, CASE WHEN l_orderkey % 2 = 0 THEN products + shipping - discount + CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0.01 WHEN l_orderkey % 3 = 1 THEN 0.02 ELSE 0 END AS DECIMAL(14, 2)) ELSE CAST(o_totalprice AS DECIMAL(14, 2)) END AS total FROM s JOIN orders ON o_orderkey = l_orderkey)
    SELECT l_orderkey, complete AND abs(products + shipping - discount - total) <= 0.01 AS reconciled, CASE WHEN complete AND abs(products + shipping - discount - total) <= 0.01 THEN CAST(products AS DOUBLE) END AS subtotal FROM t""")
def subtotal_global_tolerance(spark, d):
    """The products' sum becomes the subtotal where it, shipping and discount make the total to a hundredth."""
    money = lambda c: c.cast("decimal(14,2)")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(money(F.col("l_extendedprice"))).alias("products"), money(F.round(F.count(F.lit(1)) * 1.5, 2)).alias("shipping"), money(F.round(F.sum("l_discount"), 2)).alias("discount"), ((F.count(F.lit(1)) == F.count("l_extendedprice")) & (F.min("l_returnflag") == F.max("l_returnflag"))).alias("complete"))
    j = s.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    made = F.col("products") + F.col("shipping") - F.col("discount")
    off = F.when(F.col("l_orderkey") % 3 == 0, F.lit("0.01")).when(F.col("l_orderkey") % 3 == 1, F.lit("0.02")).otherwise(F.lit("0")).cast("decimal(14,2)")
    total = F.when(F.col("l_orderkey") % 2 == 0, made + off).otherwise(money(F.col("o_totalprice")))
    ok = F.col("complete") & (F.abs(made - total) <= F.lit("0.01").cast("decimal(14,2)"))
    return j.select("l_orderkey", ok.alias("reconciled"), F.when(ok, F.col("products").cast("double")).alias("subtotal"))


@query(E + """, t AS (SELECT user_id, order_key, k % 3 AS number, max(confidence) AS confidence, min(source_id) AS message FROM ev WHERE event = 'invoice_or_receipt' AND confidence >= 0.85 GROUP BY 1, 2, 3),
    c AS (SELECT a.user_id, a.order_key, a.k % 3 AS number, a.source_id, a.confidence FROM ev a WHERE event = 'invoice_or_receipt' AND confidence >= 0.65 AND confidence < 0.85 AND EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.order_key = a.order_key AND b.event IN ('shipment', 'order_updated') AND b.confidence >= 0.7 AND b.source_id <> a.source_id)),
    n AS (SELECT user_id, order_key, number, max(confidence) AS confidence, count(*) AS n FROM c GROUP BY 1, 2, 3)
    SELECT user_id, order_key, number, greatest(coalesce(t.confidence, n.confidence), coalesce(n.confidence, t.confidence)) AS confidence, CASE WHEN t.confidence IS NULL THEN 'added' WHEN n.confidence IS NULL THEN 'kept' ELSE 'duplicate' END AS outcome, coalesce(n.n, 0) AS n_sources FROM t FULL JOIN n USING (user_id, order_key, number)""")
def corroborated_document_upsert(spark, d):
    """Doubtful invoices that other evidence of their order supports join the documents, once for each number, with the greater confidence."""
    e, keys = evidence(spark, d), ["user_id", "order_key", "number"]
    invoices = e.where("event = 'invoice_or_receipt'").withColumn("number", F.col("k") % 3)
    target = invoices.where("confidence >= 0.85").groupBy(*keys).agg(F.max("confidence").alias("old"))
    support = e.where("event in ('shipment', 'order_updated') and confidence >= 0.7").select("user_id", "order_key").distinct()  # other events than invoices, so other sources
    new = invoices.where("confidence >= 0.65 and confidence < 0.85").join(support, ["user_id", "order_key"], "left_semi").groupBy(*keys).agg(F.max("confidence").alias("new"), F.count(F.lit(1)).alias("n"))
    j = target.join(new, keys, "full")
    return j.select(*keys, F.greatest("old", "new").alias("confidence"), F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").otherwise("duplicate").alias("outcome"), F.coalesce("n", F.lit(0)).alias("n_sources"))


#: An event of the fold, as text: what it is, the payment that is known then, and whether a shipment is.
_STEP = """CASE split_part(e, '/', 1) WHEN 'payment_failed' THEN CASE WHEN split_part(e, '/', 2) = 'paid' THEN CASE WHEN s = 'payment_failed' THEN 'paid' ELSE s END WHEN s IN ('cancelled', 'refunded', 'returned', 'delivered', 'in_transit', 'shipped', 'paid') THEN s ELSE 'payment_failed' END
    WHEN 'cancelled' THEN CASE WHEN split_part(e, '/', 3) = 'true' OR s IN ('cancelled', 'refunded', 'returned', 'delivered', 'in_transit', 'shipped') THEN s ELSE 'cancelled' END WHEN 'delayed' THEN CASE WHEN s IN ('cancelled', 'refunded', 'returned', 'delivered', 'payment_failed') THEN s ELSE 'delayed' END
    WHEN 'order_packing' THEN CASE WHEN split_part(e, '/', 2) = 'failed' OR s IN ('cancelled', 'refunded', 'returned', 'delivered', 'in_transit', 'shipped', 'payment_failed') THEN s ELSE 'processing' END ELSE s END"""
_MEANT = "CASE WHEN k % 10 = 3 THEN 'cancelled' WHEN event = 'invoice_or_receipt' AND k % 4 = 0 THEN 'payment_failed' WHEN event = 'order_updated' THEN 'order_packing' WHEN event = 'shipment' THEN 'delayed' ELSE 'seen' END"
_PAID, _SHIPPED = "CASE source_id % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'failed' END", "source_id % 3 = 1"


@query(E + f""", l AS (SELECT user_id, order_key, list({_MEANT} || '/' || coalesce({_PAID}, '') || '/' || ({_SHIPPED}) ORDER BY received_at, source_id) AS events FROM ev GROUP BY 1, 2) SELECT user_id, order_key, list_reduce(list_prepend('ordered', events), lambda s, e: {_STEP}) AS state, len(events) AS n FROM l""")
def lifecycle_fold(spark, d):
    """The state of each order of a user after all its events in the order of time, with what is known then of payments and shipments; folded day by day."""
    e = evidence(spark, d).select("user_id", "order_key", "received_at", "source_id", F.expr(_MEANT).alias("event"), F.expr(_PAID).alias("payment"), F.expr(_SHIPPED).alias("has_shipment"))
    return merge.folded_states(e, ["user_id", "order_key"], F.to_date("received_at"), ["received_at", "source_id"]).withColumn("n", F.col("n").cast("long"))
