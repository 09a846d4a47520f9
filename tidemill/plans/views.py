"""Queries that read for people, and queries that read payloads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import file_kind, hmac_sha256
from ..sources.mail import listed, picked
from ..sources.messages import message_events, normalized
from ..sources.tables import EVIDENCE_SQL, evidence, table
from .mail import SECRET, SQL_PADS
from .registry import query

E = f"WITH {EVIDENCE_SQL}"

# fixed values: fields of a product that people may edit
EDITABLE = ("name", "brand", "model", "variant", "sku", "gtin", "category", "quantity", "unit_price", "total_price", "currency", "product_url", "image_url")


@query("""WITH l AS (SELECT l_orderkey, (l_linenumber, l_suppkey, l_partkey) AS pos, l_suppkey, CASE WHEN l_linenumber = 4 AND l_suppkey % 5 = 0 THEN 'hide_product' ELSE 'edit_product' END AS action, CASE WHEN l_linenumber % 2 = 0 THEN 'n' || l_suppkey END AS name, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey + 0.5 END AS quantity FROM lineitem),
    o AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_quantity) AS own FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2, 3), r AS (SELECT o.*, p_name, l.pos, l.action, l.name, l.quantity FROM o JOIN part ON p_partkey = o.l_partkey LEFT JOIN l ON l.l_orderkey = o.l_orderkey AND l.l_suppkey % 2 = o.l_linenumber % 2)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(arg_max(name, pos) FILTER (WHERE action = 'edit_product' AND name IS NOT NULL), any_value(p_name)) AS name, coalesce(arg_max(quantity, pos) FILTER (WHERE action = 'edit_product' AND quantity IS NOT NULL), any_value(own))::DOUBLE AS quantity, count(*) FILTER (WHERE action = 'edit_product') AS edits FROM r GROUP BY 1, 2, 3 HAVING NOT coalesce(bool_or(action = 'hide_product'), false)""")
def override_log(spark, d):
    """Products with their log of edits replayed: the last value of each field that may be edited, hidden ones left out.

    Edits come as JSON; fields that may not be edited change nothing.
    """
    items = table(spark, d, "lineitem")
    changes = F.to_json(F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("n"), "l_suppkey")).alias("name"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_partkey") + 0.5).alias("quantity"), F.lit("hacked").alias("purchase_id")))
    log = items.select(F.col("l_orderkey").alias("order"), F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("at"), (F.col("l_suppkey") % 2).alias("parity"), F.when(F.expr("l_linenumber = 4 and l_suppkey % 5 = 0"), "hide_product").otherwise("edit_product").alias("action"), F.from_json(changes, "map<string,string>").alias("raw"))
    log = log.withColumn("changes", F.map_filter("raw", lambda k, _: k.isin(*EDITABLE)))
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    products = items.where("l_linenumber <= 2").groupBy(*keys).agg(F.min("l_quantity").alias("own")).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    j = products.join(log, (F.col("order") == F.col("l_orderkey")) & (F.col("parity") == F.col("l_linenumber") % 2), "left")
    edit = F.col("action") == "edit_product"
    last = lambda k: F.max_by(F.col("changes")[k], F.when(edit & F.map_contains_key("changes", F.lit(k)), F.col("at")))
    g = j.groupBy(*keys, "p_name", "own").agg(last("name").alias("new_name"), last("quantity").cast("double").alias("new_quantity"), F.count_if(edit).alias("edits"), F.coalesce(F.bool_or(F.col("action") == "hide_product"), F.lit(False)).alias("hidden"))
    return g.where("not hidden").select(*keys, F.coalesce("new_name", "p_name").alias("name"), F.coalesce("new_quantity", "own").alias("quantity"), "edits")


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_name || ' ' WHEN 1 THEN ' ' ELSE NULL END AS name, p_partkey % 4 < 2 AS has_name, CAST(p_size - 5 AS DOUBLE) AS quantity, p_retailprice - 910 AS price, (['huf', 'EURO', 'us1', 'GBP', NULL])[p_partkey % 5 + 1] AS currency, p_partkey % 7 = 0 AS foreign_only FROM part)
    SELECT p_partkey, CASE WHEN foreign_only THEN false WHEN has_name AND trim(name) = '' THEN false WHEN quantity < 0.001 OR quantity > 1000 THEN false WHEN price < 0 THEN false WHEN currency IS NOT NULL AND NOT regexp_matches(currency, '^[A-Za-z]{3}$') THEN false ELSE true END AS accepted, CASE WHEN NOT foreign_only AND has_name AND trim(name) <> '' THEN trim(name) END AS name,
      CASE WHEN regexp_matches(currency, '^[A-Za-z]{3}$') THEN upper(currency) END AS currency FROM x""")
def edit_patch_validation(spark, d):
    """Edits as they come in: fields that may be edited, a name if one is given, numbers in their ranges, a currency of three letters."""
    nth = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("p_partkey") % len(v) + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(F.col("p_partkey") % 4 == 1, " ")
    body = F.when(F.col("p_partkey") % 7 == 0, F.to_json(F.struct(F.lit("x").alias("purchase_id")))).otherwise(F.to_json(F.struct(name.alias("name"), (F.col("p_size") - 5).cast("double").alias("quantity"), (F.col("p_retailprice") - 910).alias("unit_price"))))
    p = table(spark, d, "part").select("p_partkey", F.map_filter(F.from_json(body, "map<string,string>"), lambda k, _: k.isin(*EDITABLE)).alias("b"), nth("huf", "EURO", "us1", "GBP", None).alias("code"))
    given, quantity, price = F.trim(F.col("b")["name"]), F.col("b")["quantity"].try_cast("double"), F.col("b")["unit_price"].try_cast("double")
    ok_code = F.col("code").rlike("^[A-Za-z]{3}$")
    bad = (F.size("b") == 0) | F.coalesce(given == "", F.lit(False)) | F.coalesce((quantity < 0.001) | (quantity > 1000), F.lit(False)) | F.coalesce(price < 0, F.lit(False)) | F.coalesce(~ok_code, F.lit(False))
    return p.select("p_partkey", (~bad).alias("accepted"), F.nullif(given, F.lit("")).alias("name"), F.when(ok_code, F.upper("code")).alias("currency"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_suppkey, p_name, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
    x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE ' ' || p_name || '  X ' END AS name, CASE WHEN l_partkey % 3 = 0 THEN ' SKU' || l_partkey ELSE ' ' END AS sku, CASE WHEN l_partkey % 3 = 1 THEN 'G' || l_partkey END AS gtin, p_brand AS variant, l_quantity - 1 AS quantity, CASE WHEN l_suppkey % 8 = 0 THEN -1.0 ELSE l_extendedprice END AS total, (['eur', 'Forint', 'USD'])[l_suppkey % 3 + 1] AS currency, (['https://a.example/x', 'ftp://b', NULL])[l_partkey % 3 + 1] AS url, 0.66 + l_discount AS confidence FROM i)
    SELECT l_orderkey, l_linenumber, CASE WHEN trim(sku) <> '' THEN 'sku:' || lower(trim(sku)) WHEN trim(gtin) <> '' THEN 'gtin:' || lower(trim(gtin)) ELSE 'name:' || lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) || '|variant:' || lower(coalesce(nullif(trim(variant), ''), '')) END AS source_key, CASE WHEN regexp_matches(upper(currency), '^[A-Z]{3}$') THEN upper(currency) END AS currency, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url END AS url, CAST(CAST(total AS DECIMAL(14, 2)) AS DOUBLE) AS total
    FROM x WHERE trim(name) <> '' AND length(trim(name)) <= 500 AND quantity > 0 AND quantity <= 1000 AND total >= 0 AND confidence >= 0.7""")
def product_row_sanitise(spark, d):
    """Products of an order from its JSON: fifty at most, those without a name or with odd numbers left out, each with its key."""
    i = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    nth = lambda by, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (by % len(v) + 1).cast("int"))
    one = F.struct(
        "l_linenumber", F.when(part % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("  X "))).alias("name"), F.when(part % 3 == 0, F.concat(F.lit(" SKU"), part)).otherwise(" ").alias("sku"), F.when(part % 3 == 1, F.concat(F.lit("G"), part)).alias("gtin"), F.col("p_brand").alias("variant"),
        (F.col("l_quantity") - 1).alias("quantity"), F.when(supp % 8 == 0, -1.0).otherwise(F.col("l_extendedprice")).alias("total_price"), nth(supp, "eur", "Forint", "USD").alias("currency"), nth(part, "https://a.example/x", "ftp://b", None).alias("product_url"), (F.lit(0.66) + F.col("l_discount")).alias("confidence"),
    )
    payload = i.groupBy("l_orderkey").agg(F.to_json(F.collect_list(one)).alias("products"))  # the items of one order
    schema = "array<struct<l_linenumber:int,name:string,sku:string,gtin:string,variant:string,quantity:double,total_price:double,currency:string,product_url:string,confidence:double>>"
    ok = lambda p: (F.trim(p["name"]) != "") & (F.length(F.trim(p["name"])) <= 500) & (p["quantity"] > 0) & (p["quantity"] <= 1000) & (p["total_price"] >= 0) & (p["confidence"] >= 0.7)
    rows = payload.select("l_orderkey", F.inline(F.filter(F.slice(F.from_json("products", schema), 1, 50), ok)))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    key = F.coalesce(F.concat(F.lit("sku:"), F.lower(text("sku"))), F.concat(F.lit("gtin:"), F.lower(text("gtin"))), F.concat(F.lit("name:"), F.lower(F.regexp_replace(F.trim("name"), r"\s+", " ")), F.lit("|variant:"), F.lower(F.coalesce(text("variant"), F.lit("")))))
    up = F.upper("currency")
    return rows.select("l_orderkey", "l_linenumber", key.alias("source_key"), F.when(up.rlike("^[A-Z]{3}$"), up).alias("currency"), F.when(F.col("product_url").rlike("(?i)^https?://"), F.col("product_url")).alias("url"), F.col("total_price").cast("decimal(14,2)").cast("double").alias("total"))


@query("""WITH s AS (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, o_orderkey % 11 = 0 AS cancelled, shipped < TIMESTAMP '1998-01-01' AND o_orderstatus = 'F' AS delivered, shipped < TIMESTAMP '1999-01-01' AND o_orderstatus <> 'P' AS sent, o_orderkey % 4 > 0 AS paid FROM orders JOIN s ON l_orderkey = o_orderkey),
    y AS (SELECT *, sent OR delivered AS shipped FROM x)
    SELECT o_orderkey, 'done,' || CASE WHEN paid THEN 'done' WHEN cancelled THEN 'stopped' ELSE 'current' END || ',' || CASE WHEN shipped THEN 'done' WHEN cancelled THEN 'stopped' WHEN paid THEN 'current' ELSE 'future' END || ',' || CASE WHEN delivered THEN 'done' WHEN cancelled THEN 'stopped' WHEN paid AND shipped THEN 'current' ELSE 'future' END || CASE WHEN cancelled THEN ',stopped' ELSE '' END AS steps FROM y""")
def timeline_steps(spark, d):
    """The steps of a purchase: done, stopped where it was cancelled, else the first that is to come is the current one."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"))
    j = table(spark, d, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey"))
    cancelled = F.col("o_orderkey") % 11 == 0
    delivered = (F.col("first") < F.expr("TIMESTAMP_NTZ '1998-01-01'")) & (F.col("o_orderstatus") == "F")
    shipped = delivered | ((F.col("first") < F.expr("TIMESTAMP_NTZ '1999-01-01'")) & (F.col("o_orderstatus") != "P"))
    j = j.select("o_orderkey", cancelled.alias("cancelled"), F.array(F.lit(True), F.col("o_orderkey") % 4 > 0, shipped, delivered).alias("done"))
    open_ = F.array_position("done", False)
    steps = F.transform("done", lambda x, i: F.when(x, "done").when(F.col("cancelled"), "stopped").when(i + 1 == open_, "current").otherwise("future"))
    return j.select("o_orderkey", F.array_join(F.concat(steps, F.when(F.col("cancelled"), F.array(F.lit("stopped"))).otherwise(F.array().cast("array<string>"))), ",").alias("steps"))


@query("""WITH f AS (SELECT page_id, (['Invoice.PDF?dl=1', 'photo.JPeG', 'noext', 'odd.', 'x.tar.gz#a', 'a.%$', ''])[page_id % 7 + 1] AS name FROM pages), c AS (SELECT page_id, regexp_replace(lower(trim(name)), '[?#].*$', '') AS n FROM f)
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN instr(n, '.') = 0 OR ends_with(n, '.') THEN 'none' ELSE coalesce(nullif(left(regexp_replace(string_split(n, '.')[-1], '[^a-z0-9]', '', 'g'), 12), ''), 'other') END AS kind FROM c) GROUP BY 1 ORDER BY n DESC, kind""")
def file_kinds(spark, d):
    """Attachments by the kind that their names end with."""
    name = F.element_at(F.array(*map(F.lit, ("Invoice.PDF?dl=1", "photo.JPeG", "noext", "odd.", "x.tar.gz#a", "a.%$", ""))), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, d, "pages").groupBy(file_kind(name).alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "kind")


@query(f"SELECT event_id, left(sha256(unhex({SQL_PADS['o']} || sha256(unhex({SQL_PADS['i']} || hex(encode(concat_ws('|', user_id, event_type))))))), 24) AS fingerprint, event_id % 3 > 0 AS verified FROM events")
def keyed_fingerprints(spark, d):
    """HMAC fingerprints of what must not be stored, and whether a signature holds."""
    mac = hmac_sha256(SECRET, F.concat_ws("|", "user_id", "event_type"))
    sent = F.when(F.col("event_id") % 3 > 0, mac).otherwise(F.reverse(mac))
    return table(spark, d, "events").select("event_id", F.left(mac, F.lit(24)).alias("fingerprint"), (mac == sent).alias("verified"))


@query("""SELECT 'm' || event_id AS message_id, date_trunc('second', ts) AS received_at, event_type AS subject, CASE event_id % 3 WHEN 0 THEN 'b' || user_id ELSE 's' || user_id END AS body, CASE event_id % 4 WHEN 3 THEN NULL ELSE (['message.created', 'message.created.truncated', 'message.updated'])[event_id % 4 + 1] END AS announced_by FROM events WHERE event_id % 5 > 0""")
def provider_messages(spark, d):
    """A provider's messages in one form, and the notification that announced each; broken ones and those without an id are left out."""
    i = F.col("event_id")
    e = table(spark, d, "events")
    message = F.to_json(F.struct(F.when(i % 5 > 0, F.concat(F.lit("m"), i)).alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("date"), F.col("event_type").alias("subject"), F.when(i % 3 == 0, F.concat(F.lit("b"), "user_id")).alias("body"), F.concat(F.lit("s"), "user_id").alias("snippet")))
    kind = F.element_at(F.array(*map(F.lit, ("message.created", "message.created.truncated", "message.updated", "thread.replied"))), (i % 4 + 1).cast("int"))
    event = F.to_json(F.struct(kind.alias("type"), F.struct(F.struct(F.concat(F.lit("m"), i).alias("id"), F.lit("g").alias("grant_id")).alias("object")).alias("data")))
    rows = normalized(e.select(message.alias("value")).unionByName(e.select(F.lit("{broken").alias("value"))))
    told = message_events(e.select(event.alias("value"))).select("message_id", F.col("type").alias("announced_by"))
    return rows.join(told, "message_id", "left").select("message_id", F.col("received_at").cast("timestamp_ntz").alias("received_at"), "subject", F.col("body_html").alias("body"), "announced_by")


@query(E + """, s AS (SELECT user_id, CASE event WHEN 'order_created' THEN 'processed' WHEN 'shipment' THEN 'unlinked' WHEN 'invoice_or_receipt' THEN 'ignored' ELSE 'pending' END AS status FROM ev) SELECT user_id, count(*) FILTER (WHERE status = 'processed') AS processed, count(*) FILTER (WHERE status = 'unlinked') AS unlinked, count(*) FILTER (WHERE status = 'ignored') AS ignored, count(*) FILTER (WHERE status NOT IN ('processed', 'unlinked', 'ignored')) AS review FROM s GROUP BY 1""")
def scan_outcomes(spark, d):
    """What became of each user's messages; whatever is none of the known outcomes is under review."""
    event = F.col("event")
    outcome = F.when(event == "order_created", "processed").when(event == "shipment", "unlinked").when(event == "invoice_or_receipt", "ignored").otherwise("review")
    g = evidence(spark, d).select("user_id", outcome.alias("o")).groupBy("user_id")
    return g.agg(*[F.count_if(F.col("o") == n).alias(n) for n in ("processed", "unlinked", "ignored", "review")])


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS n FROM orders WHERE o_totalprice IS NOT NULL) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE n <= least(greatest(o_custkey % 7 - 1, 1), 4)""")
def clamped_pages(spark, d):
    """The first page of each customer's orders; a page holds what was asked for, within its limits."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey")
    asked = F.least(F.greatest(F.col("o_custkey") % 7 - 1, F.lit(1)), F.lit(4))
    return table(spark, d, "orders").where("o_totalprice is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= 4).where(F.col("n") <= asked).select("o_custkey", "o_orderkey", "o_totalprice")


@query(E + """, a AS (SELECT * FROM ev WHERE event = 'invoice_or_receipt' AND confidence >= 0.65 AND merchant IS NOT NULL), x AS (SELECT a.user_id, a.k, arg_max(a.source_id, (a.confidence, -epoch_us(a.received_at), -a.source_id)) AS anchor_id FROM a GROUP BY 1, 2),
    s AS (SELECT x.user_id, x.k, x.anchor_id, list_sort(list(DISTINCT b.event)) AS kinds, count(DISTINCT b.source_id) AS n FROM x JOIN ev i ON i.source_id = x.anchor_id JOIN ev b ON b.user_id = x.user_id AND b.k = x.k AND b.event IN ('order_updated', 'shipment', 'payment_completed') AND b.confidence >= 0.75 AND abs(epoch_us(b.received_at) - epoch_us(i.received_at)) <= 14 * 86400000000 GROUP BY 1, 2, 3)
    SELECT anchor_id, n, concat_ws(',', 'invoice_identity_without_purchase', CASE WHEN list_contains(kinds, 'order_updated') THEN 'lifecycle_update' END, CASE WHEN list_contains(kinds, 'payment_completed') THEN 'payment' END, CASE WHEN list_contains(kinds, 'shipment') THEN 'shipment' END) AS reasons, sha256(concat_ws('|', user_id, 'invoice-anchor', k)) AS search_key FROM s
    WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.event = 'order_created' AND o.user_id = s.user_id AND o.k = s.k)""")
def invoice_search_plan(spark, d):
    """Invoices without a purchase that other evidence within fourteen days supports: what to search for, and why."""
    from ..functions.text import dedupe_key, reasons
    from ..operators.joins import interval_join

    e, keys = evidence(spark, d), ["user_id", "k"]
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "received_at", "source_id"))
    a = e.where("event = 'invoice_or_receipt' and confidence >= 0.65 and merchant is not null").groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.source_id").alias("anchor_id"), F.col("b.received_at").alias("anchor_at"))
    a = a.join(e.where("event = 'order_created'").select(*keys).distinct(), keys, "left_anti")
    support = e.where("event in ('order_updated', 'shipment', 'payment_completed') and confidence >= 0.75").select(*keys, "event", "source_id", F.col("received_at").alias("at"))
    has = lambda x: F.bool_or(F.col("event") == x).alias(x)
    g = interval_join(a, support, keys, "anchor_at", "at", 336, symmetric=True).groupBy(*keys, "anchor_id").agg(F.count(F.lit(1)).alias("n"), has("order_updated"), has("payment_completed"), has("shipment"))
    why = reasons(("invoice_identity_without_purchase", F.lit(True)), ("lifecycle_update", F.col("order_updated")), ("payment", F.col("payment_completed")), ("shipment", F.col("shipment")))
    return g.select("anchor_id", "n", F.array_join(why, ",").alias("reasons"), dedupe_key(F.col("user_id"), F.lit("invoice-anchor"), F.col("k")).alias("search_key"))


_PAYLOADS = ('{"confidence": 0.5, "merchant": " Shop ", "order": {"n": 1}}', '{"confidence": "0.5", "merchant": 7}', '{"confidence": null, "merchant": " "}', '{"confidence": {"a": 1}, "order": [1]}', "[1, 2]", "{broken", '{"confidence": 3}')


@query(f"""WITH p AS (SELECT event_id, ({listed(_PAYLOADS)})[event_id % {len(_PAYLOADS)} + 1] AS raw FROM events), j AS (SELECT event_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j FROM p)
    SELECT event_id, CASE WHEN json_type(j, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS confidence, CASE WHEN json_type(j, '$.merchant') = 'VARCHAR' THEN nullif(trim(json_extract_string(j, '$.merchant')), '') END AS merchant, coalesce(json_type(j, '$.order') = 'OBJECT', false) AS has_order FROM j""")
def typed_getters(spark, d):
    """Values of documents of unknown shape, null where they are of another type than asked for."""
    v = F.try_parse_json(picked(_PAYLOADS, F.col("event_id")))
    rows = table(spark, d, "events").select("event_id", v.alias("v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    number, text = kind("$.confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), kind("$.merchant") == "STRING"
    return rows.select("event_id", F.when(number, F.try_variant_get("v", "$.confidence", "double")).alias("confidence"), F.when(text, F.nullif(F.trim(F.try_variant_get("v", "$.merchant", "string")), F.lit(""))).alias("merchant"), F.coalesce(kind("$.order").startswith("OBJECT"), F.lit(False)).alias("has_order"))


@query("""SELECT o_orderkey AS id, 'Shop ' || o_custkey % 7 AS "merchantName", o_totalprice AS "totalAmount", CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'ordered' ELSE 'processing' END AS "currentState", o_orderdate AS "orderedAt" FROM orders""")
def public_purchases(spark, d):
    """Purchases in the shape that clients see, without the columns that are not theirs."""
    state = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "ordered").otherwise("processing")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Shop "), F.col("o_custkey") % 7).alias("merchantName"), F.col("o_totalprice").alias("totalAmount"), state.alias("currentState"), F.col("o_orderdate").alias("orderedAt"))
