"""Queries that resolve evidence into purchases, shipments, payments and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numbers import amount_close, boosted, micros, score_band, time_points
from ..functions.text import LEGAL_FORMS, dedupe_key, fold, reasons, same_party, text_key
from ..operators import merge
from ..operators.bridge import GENERIC, bridged, by_cluster, by_sender
from ..operators.candidates import DAY, alike_names, amount_pairs, best_of_all, standing
from ..operators.joins import interval_join
from ..operators.resolve import purchases, shipments
from ..operators.review import reviewed
from ..operators.validate import may_write_document, may_write_purchase, may_write_shipment
from ..sources.tables import EVIDENCE_SQL, evidence, table
from ..streaming.inbox import drain, replayed
from .registry import query

E = f"WITH {EVIDENCE_SQL}"
AS_OF = "TIMESTAMP_NTZ '2024-01-25 00:00:00'"
_DAYS = "abs(epoch_us({0}) - epoch_us({1})) / 86400e6"

_PURCHASES = """, g AS (SELECT user_id, sender, order_key, min(role) AS role, count(*) AS n, CASE WHEN min(role) = 'carrier' THEN 0 ELSE count(*) FILTER (WHERE event = 'order_created') END AS n_created,
      count(*) FILTER (WHERE event IN ('order_updated', 'payment_completed', 'shipment', 'delivery', 'invoice_or_receipt')) AS n_support, max(confidence) FILTER (WHERE event = 'order_created') AS best FROM ev WHERE order_key IS NOT NULL GROUP BY 1, 2, 3),
    s AS (SELECT user_id, sender, order_key, merchant FROM ev WHERE event = 'order_created' QUALIFY row_number() OVER (PARTITION BY user_id, sender, order_key ORDER BY confidence DESC, received_at, source_id) = 1),
    f AS (SELECT user_id, sender, order_key, merchant FROM ev WHERE merchant IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, sender, order_key ORDER BY received_at, source_id) = 1),
    pd AS (SELECT g.*, coalesce(CASE WHEN role <> 'carrier' THEN s.merchant END, f.merchant) AS merchant, CASE WHEN role = 'carrier' THEN 'lifecycle_only' WHEN role = 'public' THEN 'review' WHEN n_created = 0 THEN 'lifecycle_only' WHEN s.merchant IS NULL THEN 'review' WHEN best >= 0.9 THEN 'create_direct' WHEN best >= 0.8 AND n_support > 0 THEN 'create_corroborated' ELSE 'review' END AS decision
        FROM g LEFT JOIN s USING (user_id, sender, order_key) LEFT JOIN f USING (user_id, sender, order_key)),
    pc AS (SELECT user_id, sender, order_key, n, n_created, n_support, merchant, CASE WHEN n_created = 0 THEN 0.0 WHEN decision = 'create_corroborated' THEN round(least(0.99, best + 0.08), 4) ELSE best END::DOUBLE AS confidence, decision FROM pd)"""


@query(E + _PURCHASES + " SELECT * FROM pc")
def purchase_resolution(spark, d):
    return purchases(evidence(spark, d))


@query(E + _PURCHASES + """ SELECT user_id, sender, order_key FROM pc WHERE merchant IS NOT NULL AND n_created >= 1 AND ((decision = 'create_direct' AND confidence >= 0.9) OR (decision = 'create_corroborated' AND confidence >= 0.88 AND n >= 3 AND n_support >= 2))""")
def purchase_write_gate(spark, d):
    """The candidates that may become purchases without a look at them."""
    return purchases(evidence(spark, d)).where(may_write_purchase(*map(F.col, ("decision", "confidence", "n", "n_created", "n_support", "merchant")))).select("user_id", "sender", "order_key")


#: Purchases that exist: merchants' order confirmations, one of each message in three; an order may so have several.
_EXISTING = ", px AS (SELECT source_id AS purchase_id, user_id, sender, order_key, k, value, received_at AS ordered_at, merchant, slug FROM ev WHERE event = 'order_created' AND role = 'merchant' AND (source_id % 3 = 0 OR confidence >= 0.9))"
_SHIPMENTS = _EXISTING + """, m AS (SELECT user_id, sender, order_key, count(*) AS matches, min(purchase_id) AS low, max(purchase_id) AS high FROM px GROUP BY 1, 2, 3), r AS (SELECT ev.*, matches, low, high FROM ev LEFT JOIN m USING (user_id, sender, order_key) WHERE k IS NOT NULL),
    c AS (SELECT user_id, k AS tracking, count(*) AS n, count(*) FILTER (WHERE role = 'carrier') AS n_carrier, count(*) FILTER (WHERE role <> 'carrier' AND matches = 1) AS n_anchors, count(*) FILTER (WHERE event = 'shipment' AND phase IN ('shipped', 'in_transit', 'out_for_delivery', 'ready_for_pickup')) AS n_physical, max(confidence) AS confidence,
      CASE WHEN count(DISTINCT slug) = 1 THEN min(slug) END AS slug, CASE WHEN bool_or(event = 'delivery' OR coalesce(phase = 'delivered', false)) THEN 'delivered' WHEN count(*) FILTER (WHERE event = 'shipment' AND phase IN ('shipped', 'in_transit', 'out_for_delivery', 'ready_for_pickup')) > 0 THEN 'in_transit' ELSE 'shipment_created' END AS status,
      min(low) FILTER (WHERE role <> 'carrier') AS low, max(high) FILTER (WHERE role <> 'carrier') AS high FROM r GROUP BY 1, 2),
    sc AS (SELECT user_id, tracking, n, n_carrier, n_anchors, n_physical, confidence, slug, status, CASE WHEN low IS NULL THEN 'unmatched' WHEN low = high THEN 'linkable' ELSE 'review' END AS decision, CASE WHEN low = high THEN low END AS purchase_id FROM c)"""


def _existing(e):
    p = e.where("event = 'order_created' and role = 'merchant' and (source_id % 3 = 0 or confidence >= 0.9)")
    return p.select(F.col("source_id").alias("purchase_id"), "user_id", "sender", "order_key", "k", "value", F.col("received_at").alias("ordered_at"), "merchant", "slug")


@query(E + _SHIPMENTS + " SELECT * FROM sc")
def shipment_resolution(spark, d):
    e = evidence(spark, d)
    return shipments(e.withColumn("tracking", F.col("k")), _existing(e))


_PARCELS = _SHIPMENTS.replace("k AS tracking", "k // 10 AS tracking")


@query(E + _PARCELS + """ SELECT user_id, tracking, coalesce(decision = 'linkable' AND slug IS NOT NULL AND status <> 'shipment_created' AND n_physical >= 1 AND n >= 3 AND n_anchors >= 1 AND n_carrier >= 2, false) AS by_tracking,
    coalesce(decision = 'linkable' AND confidence >= 0.85, false) AS as_invoice, n_carrier FROM sc""")
def shipment_write_gate(spark, d):
    """Which shipments and documents may be written; ten of the events' numbers are one parcel here, so that a carrier has several rows of it."""
    e = evidence(spark, d)
    s = shipments(e.withColumn("tracking", F.floor(F.col("k") / 10)), _existing(e))
    return s.select("user_id", "tracking", may_write_shipment(*map(F.col, ("decision", "slug", "status", "n", "n_physical", "n_anchors", "n_carrier"))).alias("by_tracking"), may_write_document(F.col("decision"), F.lit("invoice"), F.col("confidence")).alias("as_invoice"), "n_carrier")


#: What payments and purchases say beside the columns of evidence: a thread, an order number of one of three lengths, a currency and a name.
_SAID = """CASE WHEN {0} % 5 < 2 THEN ({0} // 3) % 40 END AS thread, CASE WHEN k % 9 = 8 THEN NULL WHEN order_key % 3 = 0 THEN 'A-' || k WHEN order_key % 3 = 1 THEN 'ab-' || lpad(CAST(k AS VARCHAR), 3, '0') ELSE 'ABC ' || lpad(CAST(k AS VARCHAR), 4, '0') END AS order_no, CASE WHEN {0} % 2 = 0 THEN 'HUF' ELSE 'EUR' END AS currency"""
_KEY = "upper(regexp_replace({0}, '[^a-zA-Z0-9]', '', 'g'))"
_ALL_PAIRS = _EXISTING + f""", a AS (SELECT *, {_SAID.format("source_id")}, source_id % 13 = 0 AS recurring FROM ev WHERE event = 'payment_completed'), b AS (SELECT * REPLACE (merchant || CASE WHEN purchase_id % 4 = 0 THEN ' Kft' ELSE '' END AS merchant), {_SAID.format("purchase_id")} FROM px),
    ab AS (SELECT a.source_id, a.confidence, a.recurring, b.purchase_id, a.k = b.k AS tracked, coalesce(a.thread = b.thread, false) AS threaded, coalesce({_KEY.format("a.order_no")} = {_KEY.format("b.order_no")}, false) AS ordered, length({_KEY.format("a.order_no")}) AS order_length, a.sender = b.sender AS dom,
        abs(a.value - b.value) AS apart, abs(b.value) AS size, a.currency = b.currency AS coin, a.currency AS currency, lower(a.merchant) AS name_a, lower(b.merchant) AS name_b, {_DAYS.format("a.received_at", "b.ordered_at")} AS days FROM a LEFT JOIN b USING (user_id))"""
_SCORED = _ALL_PAIRS + """, x AS (SELECT *, coalesce(name_a = name_b OR (length(name_a) >= 5 AND length(name_b) >= 5 AND (contains(name_a, name_b) OR contains(name_b, name_a))), false) AS nam, coin AND apart <= greatest(1.0, size * 0.005) AS amt FROM ab),
    s AS (SELECT *, coalesce(140 * tracked::INT + 130 * threaded::INT + CASE WHEN NOT ordered THEN 0 WHEN order_length >= 6 THEN 105 WHEN order_length = 5 THEN 75 ELSE 55 END + 35 * dom::INT + 25 * nam::INT + 25 * amt::INT + CASE WHEN days <= 2 THEN 15 WHEN days <= 7 THEN 10 WHEN days <= 30 THEN 4 ELSE 0 END, 0) AS score FROM x),
    r AS (SELECT *, row_number() OVER w AS rn, lead(score, 1, 0) OVER w AS runner_up FROM s WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, purchase_id)),
    u AS (SELECT source_id, confidence, purchase_id, score, runner_up, runner_up > 0 AND score >= 80 AND score - runner_up < 30 AS ambiguous, coalesce(tracked OR threaded OR (ordered AND (order_length >= 6 OR dom OR nam OR amt)), false) AS anchored FROM r WHERE rn = 1),
    v AS (SELECT *, CASE WHEN score = 0 THEN 'unmatched' WHEN confidence < 0.8 THEN 'review' WHEN score >= 110 AND anchored AND NOT ambiguous THEN 'linkable' WHEN score >= 80 THEN 'review' ELSE 'unmatched' END AS decision FROM u)"""


def _said(rows, number: str):
    """The thread, the order number, the currency and a name of each row."""
    i, k = F.col(number), F.col("k")
    order_no = F.when(k % 9 == 8, None).when(F.col("order_key") % 3 == 0, F.concat(F.lit("A-"), k)).when(F.col("order_key") % 3 == 1, F.concat(F.lit("ab-"), F.lpad(k.cast("string"), 3, "0"))).otherwise(F.concat(F.lit("ABC "), F.lpad(k.cast("string"), 4, "0")))
    return rows.withColumns({"thread": F.when(i % 5 < 2, F.floor(i / 3) % 40), "order_no": order_no, "currency": F.when(i % 2 == 0, "HUF").otherwise("EUR")})


def _sides(spark, d):
    """Payments and purchases with what each says of itself."""
    e = evidence(spark, d)
    a, b = _said(e.where("event = 'payment_completed'"), "source_id"), _said(_existing(e), "purchase_id")
    b = b.withColumn("merchant", F.concat("merchant", F.when(F.col("purchase_id") % 4 == 0, " Kft").otherwise("")))
    key = F.upper(F.regexp_replace("order_no", "[^a-zA-Z0-9]", ""))
    own = a.select(F.col("source_id").alias("probe"), "user_id", "confidence", "k", "thread", key.alias("order"), "sender", "value", "currency", "merchant", micros(F.col("received_at")).alias("t"))
    theirs = b.select(F.col("purchase_id").alias("id"), "user_id", "k", "thread", key.alias("order"), "sender", F.col("value").alias("b_value"), "currency", "merchant", micros(F.col("ordered_at")).alias("t"))
    # both are asked for many times, and each time would read the events' texts and group them again
    folder = _stream_folder(spark)
    for name, side in (("own", own), ("theirs", theirs)):
        side.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/own"), spark.read.parquet(f"{folder}/theirs")


def _rare(own, theirs, keys: tuple[str, ...]):
    """Pairs of a user that share one of the keys or may share an amount, each once, with the columns of both sides (``b_``...)."""
    named = theirs.select("user_id", *[F.col(c).alias(c if c in ("id", "b_value") else f"b_{c}") for c in theirs.columns if c != "user_id"])
    # a pair that shares several keys comes of the first one only
    met = None
    for n, c in enumerate(keys):
        pairs = own.join(named, (own["user_id"] == named["user_id"]) & (own[c] == named[f"b_{c}"])).drop(named["user_id"])
        for before in keys[:n]:
            pairs = pairs.where(~F.coalesce(F.col(before) == F.col(f"b_{before}"), F.lit(False)))
        met = pairs if met is None else met.unionByName(pairs)
    amounts = amount_pairs(own, named, ["user_id"])
    for before in keys:
        amounts = amounts.where(~F.coalesce(F.col(before) == F.col(f"b_{before}"), F.lit(False)))
    return met.unionByName(amounts)


_BITS = {0: ["user_id"], 1: ["user_id", "sender"], 2: ["user_id", "alike"], 3: ["user_id", "sender", "alike"]}


def _band(days, *steps: int):
    out = F.lit(len(steps))
    for n, most in reversed(list(enumerate(steps))):
        out = F.when(days <= most, n).otherwise(out)
    return out


def _scored(spark, d):
    own, theirs = _sides(spark, d)
    name = lambda c: F.trim(F.regexp_replace(fold(F.col(c)), "[^a-z0-9]+", " "))
    own, theirs = own.withColumn("name", name("merchant")), theirs.withColumn("name", name("merchant"))
    # names are few beside the rows that bear them
    names = alike_names(own.select("name"), theirs.select("name"))
    asking = own.join(names, "name", "left")
    common = standing(asking, theirs.withColumn("alike", F.nullif("name", F.lit(""))), _BITS, (2, 7, 30))
    p = _rare(own, theirs, ("k", "thread", "order"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    left, right = F.col("name"), F.col("b_name")
    p = p.withColumns({
        "tracked": flag(F.col("k") == F.col("b_k")), "threaded": flag(F.col("thread") == F.col("b_thread")), "ordered": flag(F.col("order") == F.col("b_order")), "dom": flag(F.col("sender") == F.col("b_sender")), "days": F.abs(F.col("t") - F.col("b_t")) / DAY,
        "nam": flag((left != "") & (right != "") & ((left == right) | ((F.length(left) >= 5) & (F.length(right) >= 5) & (left.contains(right) | right.contains(left))))), "amt": flag((F.col("currency") == F.col("b_currency")) & amount_close(F.col("value"), F.col("b_value"))),
    }).where("tracked or threaded or ordered or amt")
    size = F.length("order")
    n = lambda c: F.col(c).cast("int")
    score = 140 * n("tracked") + 130 * n("threaded") + F.when(~F.col("ordered"), 0).when(size >= 6, 105).when(size == 5, 75).otherwise(55) + 35 * n("dom") + 25 * n("nam") + 25 * n("amt") + time_points(F.col("days"))
    anchored = F.col("tracked") | F.col("threaded") | (F.col("ordered") & ((size >= 6) | F.col("dom") | F.col("nam") | F.col("amt")))
    pairs = p.select("probe", "id", score.alias("score"), (n("dom") + 2 * n("nam")).alias("mask"), _band(F.col("days"), 2, 7, 30).alias("band"), anchored.alias("flags"))
    t = best_of_all(own.select("probe", "confidence"), common, pairs, {0: 0, 1: 35, 2: 25, 3: 60}, (15, 10, 4, 0))
    t = t.select(F.col("probe").alias("source_id"), "confidence", F.col("best.id").alias("purchase_id"), F.coalesce("best.score", F.lit(0)).alias("score"), "runner_up", F.coalesce("best.flags", F.lit(False)).alias("anchored"))
    t = t.withColumn("ambiguous", (F.col("runner_up") > 0) & (F.col("score") >= 80) & (F.col("score") - F.col("runner_up") < 30))
    decided = F.when(F.col("score") == 0, "unmatched").when(F.col("confidence") < 0.8, "review").when((F.col("score") >= 110) & F.col("anchored") & ~F.col("ambiguous"), "linkable").when(F.col("score") >= 80, "review").otherwise("unmatched")
    return t.withColumn("decision", decided)


@query(E + _SCORED + " SELECT source_id, CASE WHEN decision <> 'unmatched' THEN purchase_id END AS purchase_id, score, runner_up, ambiguous, decision FROM v")
def top2_margin_match(spark, d):
    """The purchase of all of its user's that a payment fits best, and by what margin: tracking, thread, order number by its length, domain, name, amount in its currency, and time."""
    return _scored(spark, d).select("source_id", F.when(F.col("decision") != "unmatched", F.col("purchase_id")).alias("purchase_id"), "score", "runner_up", "ambiguous", "decision")


@query(E + _SCORED + " SELECT CASE WHEN score <= 0 THEN 'none' WHEN score < 80 THEN 'weak' WHEN score < 170 THEN 'review' ELSE 'strict' END AS band, count(*) AS n FROM v GROUP BY 1")
def distance_bands(spark, d):
    return _scored(spark, d).groupBy(score_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_CORE = "trim(regexp_replace(regexp_replace({0}, '\\b(?:kft|zrt|bt|nyrt|ltd|limited|inc|llc|gmbh)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_PAY = _ALL_PAIRS + f""", x AS (SELECT *, coalesce({_CORE.format("name_a")} = {_CORE.format("name_b")}, false) AS nam, coalesce(coin AND apart <= CASE WHEN currency = 'HUF' THEN 1 ELSE 0.01 END, false) AS amt FROM ab),
    s AS (SELECT *, CASE WHEN recurring OR purchase_id IS NULL THEN 0 ELSE 90 * dom::INT + 40 * nam::INT + 60 * amt::INT + 30 * ordered::INT + CASE WHEN NOT (dom OR nam OR amt OR ordered) THEN 0 WHEN days <= 2 THEN 20 WHEN days <= 7 THEN 8 ELSE 0 END END AS score, coalesce(dom AND amt AND days <= 2 AND NOT recurring, false) AS strict FROM x),
    r AS (SELECT *, row_number() OVER w AS rn, lead(score, 1, 0) OVER w AS runner_up, count(*) FILTER (WHERE strict) OVER (PARTITION BY source_id) AS n_strict FROM s WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, purchase_id)),
    t AS (SELECT source_id, recurring, purchase_id, score, runner_up, n_strict, CASE WHEN recurring OR score = 0 THEN 'unmatched' WHEN n_strict > 1 THEN 'review' WHEN n_strict = 1 AND strict THEN CASE WHEN confidence < 0.95 THEN 'review' ELSE 'shadow_linkable' END WHEN score >= 80 AND (dom OR nam OR amt) THEN 'review' ELSE 'unmatched' END AS decision FROM r WHERE rn = 1)"""


def _payments(spark, d):
    own, theirs = _sides(spark, d)
    core = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(fold(F.col(c)), r"\b(?:kft|zrt|bt|nyrt|ltd|limited|inc|llc|gmbh)\b", " "), "[^a-z0-9]+", " ")), F.lit(""))
    own, theirs = own.withColumn("alike", core("merchant")).withColumn("recurring", F.col("probe") % 13 == 0), theirs.withColumn("alike", core("merchant"))
    asking = own.where("not recurring")
    common = standing(asking, theirs, {m: keys for m, keys in _BITS.items() if m}, (2, 7))
    p = _rare(asking, theirs, ("order",))
    flag = lambda c: F.coalesce(c, F.lit(False))
    within = F.when(F.col("currency") == "HUF", 1.0).otherwise(0.01)
    p = p.withColumns({
        "ref": flag(F.col("order") == F.col("b_order")), "dom": flag(F.col("sender") == F.col("b_sender")), "nam": flag(F.col("alike") == F.col("b_alike")), "days": F.abs(F.col("t") - F.col("b_t")) / DAY,
        "amt": flag((F.col("currency") == F.col("b_currency")) & (F.abs(F.col("value") - F.col("b_value")) <= within)),
    }).where("ref or amt")
    n = lambda c: F.col(c).cast("int")
    score = 90 * n("dom") + 40 * n("nam") + 60 * n("amt") + 30 * n("ref") + F.when(F.col("days") <= 2, 20).when(F.col("days") <= 7, 8).otherwise(0)
    strict, some = F.expr("dom and amt and days <= 2"), F.expr("dom or nam or amt")
    p = p.withColumn("strict", strict)
    pairs = p.select("probe", "id", score.alias("score"), (n("dom") + 2 * n("nam")).alias("mask"), _band(F.col("days"), 2, 7).alias("band"), F.struct("strict", some.alias("some")).alias("flags"))
    t = best_of_all(own.select("probe", "confidence", "recurring"), common, pairs, {1: 90, 2: 40, 3: 130}, (20, 8, 0))
    t = t.join(p.where("strict").groupBy("probe").agg(F.count(F.lit(1)).alias("n_strict")), "probe", "left").withColumn("n_strict", F.coalesce("n_strict", F.lit(0)))
    score, strict = F.coalesce("best.score", F.lit(0)), (F.col("n_strict") == 1) & F.coalesce("best.flags.strict", F.lit(False))
    # a pair of common features alone has a domain or a name
    some = F.coalesce("best.flags.some", F.lit(True))
    decided = F.when(F.col("recurring") | (score == 0), "unmatched").when(F.col("n_strict") > 1, "review").when(strict & (F.col("confidence") < 0.95), "review").when(strict, "shadow_linkable").when((score >= 80) & some, "review").otherwise("unmatched")
    return t.select(F.col("probe").alias("source_id"), "recurring", F.col("best.id").alias("purchase_id"), score.alias("score"), "runner_up", F.col("n_strict").cast("long").alias("n_strict"), decided.alias("decision"))


@query(E + _PAY + " SELECT source_id, CASE WHEN decision <> 'unmatched' THEN purchase_id END AS purchase_id, score, runner_up, n_strict, decision FROM t")
def payment_scored_match(spark, d):
    """Payments against all purchases of their user: domain, name, amount in its currency's tolerance, reference, and time beside one of them."""
    return _payments(spark, d).drop("recurring").withColumn("purchase_id", F.when(F.col("decision") != "unmatched", F.col("purchase_id")))


@query(E + _PAY + " SELECT CASE WHEN recurring THEN 'recurring' ELSE 'purchase' END AS context, CASE WHEN score <= 0 THEN 'none' WHEN score < 80 THEN 'weak' WHEN score < 170 THEN 'review' ELSE 'strict' END AS band, decision, n_strict > 1 AS ambiguous, count(*) AS n, false AS would_write FROM t GROUP BY ALL")
def payment_diagnostics(spark, d):
    """What may be told of payments under observation: bands and decisions, no identities."""
    t = _payments(spark, d)
    return t.groupBy(F.when(F.col("recurring"), "recurring").otherwise("purchase").alias("context"), score_band(F.col("score")).alias("band"), "decision", (F.col("n_strict") > 1).alias("ambiguous")).agg(F.count(F.lit(1)).alias("n")).withColumn("would_write", F.lit(False))


# parties: merchants as they are called in orders, and parcel senders as carriers write them
_NAMES = ("Blue Kettle Kft", "Red Widget Zrt", "Tea and Cups Ltd", "Shop")
_CALLED = ("Blue Ketle Kft", "Widget", "Tea and Cup Ltd", "Shop Kft", "Green Lamp")


def _party_key(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def _core(x: str) -> str:
    return f"string_split(regexp_extract({x}, '^(.+?)(?: (?:{'|'.join(LEGAL_FORMS)}))*$', 1), ' ')"


def _same_party(a: str, b: str) -> str:
    zipped = f"list_zip({_core(a)}, {_core(b)})"
    edit = "(z[1] = z[2] OR (abs(len(z[1]) - len(z[2])) <= 1 AND least(len(z[1]), len(z[2])) >= 4 AND levenshtein(z[1], z[2]) <= 1))"
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR (len({a}) >= 5 AND len({b}) >= 5 AND (contains({a}, {b}) OR contains({b}, {a}))) OR (len({_core(a)}) >= 2 AND len({_core(a)}) = len({_core(b)}) AND len(list_filter({zipped}, lambda z: NOT {edit})) = 0 AND len(list_filter({zipped}, lambda z: z[1] <> z[2])) = 1)))"


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: A number that counts as a parcel's has ten characters at least; a purchase may have a parcel of the same carrier stored.
_NUMBER = "CASE WHEN {0} >= 10 THEN 'TRK' || lpad(CAST({0} AS VARCHAR), 7, '0') ELSE 'T' || {0} END"
_BRIDGE = f""", p AS (SELECT source_id AS purchase_id, user_id, k, order_key, slug AS expected, {_party_key(f"({_sql_list(_NAMES)})[source_id % {len(_NAMES)} + 1]")} AS name, CASE WHEN source_id % 5 = 0 THEN {_party_key(f"({_sql_list(_CALLED)})[source_id % {len(_CALLED)} + 1]")} END AS legal FROM ev WHERE event = 'order_created' AND role = 'merchant' AND source_id % 4 <> 3),
    st AS (SELECT purchase_id, coalesce(expected, 'mpl') AS slug, {_NUMBER.format("(k + purchase_id % 2)")} AS tracking FROM p WHERE purchase_id % 6 = 0),
    an AS (SELECT p.purchase_id, p.user_id, make_timestamp(epoch_us(a.received_at) // 6) AS at, round(least(1.0, a.confidence + 0.2), 4) AS confidence, a.slug, a.source_id % 3 = 0 AS delivers, CASE WHEN a.source_id % 2 = 0 THEN {_NUMBER.format("a.k")} END AS tracking FROM p JOIN ev a ON a.user_id = p.user_id AND a.order_key = p.order_key AND a.event = 'order_updated' AND a.role = 'merchant'),
    cr AS (SELECT source_id AS carrier_id, user_id, coalesce(slug, 'mpl') AS slug, {_NUMBER.format("k")} AS tracking, make_timestamp(epoch_us(received_at) // 6) AS at, round(least(1.0, confidence + 0.2), 4) AS confidence, coalesce(phase = 'delivered', false) AS delivers, CASE WHEN source_id % 3 > 0 THEN {_party_key(f"({_sql_list(_CALLED)})[source_id % {len(_CALLED)} + 1]")} END AS consignor FROM ev WHERE event = 'shipment' AND k >= 10),
    cl AS (SELECT user_id, slug, tracking, max(confidence) AS confidence, count(*) AS n, list(DISTINCT consignor) FILTER (WHERE consignor IS NOT NULL) AS consignors FROM cr GROUP BY 1, 2, 3),
    ta AS (SELECT cl.slug AS c_slug, cl.tracking AS c_tracking, an.*, coalesce(an.tracking = cl.tracking, false) AS exact FROM cl JOIN an USING (user_id) WHERE (an.tracking IS NULL OR length(an.tracking) < 10 OR an.tracking = cl.tracking) AND (an.confidence >= 0.8 OR (an.confidence >= 0.75 AND an.tracking = cl.tracking))),
    sa AS (SELECT ta.user_id, c_slug, c_tracking, purchase_id, bool_or(coalesce(ta.slug = c_slug, false)) AS names_carrier FROM ta JOIN cr ON cr.user_id = ta.user_id AND cr.slug = c_slug AND cr.tracking = c_tracking AND NOT cr.delivers
        WHERE NOT ta.delivers AND epoch_us(cr.at) - epoch_us(ta.at) BETWEEN 0 AND CASE WHEN exact THEN 168 ELSE 36 END * 3600000000 GROUP BY 1, 2, 3, 4),
    da AS (SELECT DISTINCT ta.user_id, c_slug, c_tracking, purchase_id FROM ta JOIN cr ON cr.user_id = ta.user_id AND cr.slug = c_slug AND cr.tracking = c_tracking WHERE ta.delivers AND epoch_us(ta.at) - epoch_us(cr.at) BETWEEN 0 AND 36 * 3600000000),
    c AS (SELECT sa.user_id, sa.c_slug AS slug, sa.c_tracking AS tracking, count(*) AS n_purchases, min(purchase_id) AS purchase_id, bool_or(da.purchase_id IS NOT NULL) AS delivered FROM sa JOIN p USING (user_id, purchase_id) JOIN cl ON cl.user_id = sa.user_id AND cl.slug = sa.c_slug AND cl.tracking = sa.c_tracking LEFT JOIN da USING (user_id, c_slug, c_tracking, purchase_id)
        WHERE (names_carrier OR (p.expected = sa.c_slug AND da.purchase_id IS NOT NULL)) AND (cl.consignors IS NULL OR len(list_filter(cl.consignors, lambda c: {_same_party("c", "p.name")} OR coalesce({_same_party("c", "p.legal")}, false))) > 0)
          AND NOT EXISTS (SELECT 1 FROM st WHERE st.purchase_id = sa.purchase_id AND st.slug = sa.c_slug AND st.tracking <> sa.c_tracking) GROUP BY 1, 2, 3)"""


@query(E + _BRIDGE + """ SELECT cl.user_id, cl.slug, cl.tracking, cl.n, CASE WHEN cl.confidence < 0.85 THEN 'review' WHEN n_purchases = 1 THEN 'linkable' WHEN n_purchases > 1 THEN 'review' ELSE 'unmatched' END AS decision, CASE WHEN cl.confidence >= 0.85 AND n_purchases = 1 THEN c.purchase_id END AS purchase_id, cl.confidence >= 0.85 AND n_purchases = 1 AND delivered AS corroborated FROM cl LEFT JOIN c USING (user_id, slug, tracking)""".replace("cl.confidence >= 0.85 AND n_purchases = 1 AND delivered AS", "coalesce(cl.confidence >= 0.85 AND n_purchases = 1 AND delivered, false) AS"))
def tracking_bridge(spark, d):
    """Clusters of a carrier's messages, and the one purchase whose merchant announced the parcel before."""
    e = evidence(spark, d)
    nth = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("source_id") % len(values) + 1).cast("int"))
    number = lambda k: F.when(k >= 10, F.concat(F.lit("TRK"), F.lpad(k.cast("string"), 7, "0"))).otherwise(F.concat(F.lit("T"), k))
    p = e.where("event = 'order_created' and role = 'merchant' and source_id % 4 <> 3").select(F.col("source_id").alias("purchase_id"), "user_id", "k", "order_key", F.col("slug").alias("expected"), text_key(nth(_NAMES)).alias("name"), F.when(F.col("source_id") % 5 == 0, text_key(nth(_CALLED))).alias("legal"))
    stored = p.where("purchase_id % 6 = 0").select("purchase_id", F.coalesce("expected", F.lit("mpl")).alias("slug"), number(F.col("k") + F.col("purchase_id") % 2).alias("tracking"))
    # the messages here are surer than the table's, and closer in time
    at = F.timestamp_micros(F.floor(micros(F.col("received_at")) / 6).cast("long"))
    sure = F.round(F.least(F.lit(1.0), F.col("confidence") + 0.2), 4)
    a = e.where("event = 'order_updated' and role = 'merchant'").select("user_id", "order_key", at.alias("anchor_at"), sure.alias("anchor_confidence"), F.col("slug").alias("anchor_slug"), (F.col("source_id") % 3 == 0).alias("delivers"), F.when(F.col("source_id") % 2 == 0, number(F.col("k"))).alias("anchor_tracking"))
    anchors = p.select("purchase_id", "user_id", "order_key").join(a, ["user_id", "order_key"]).drop("order_key")
    rows = e.where("event = 'shipment' and k >= 10").select("user_id", F.coalesce("slug", F.lit("mpl")).alias("slug"), number(F.col("k")).alias("tracking"), at.alias("carrier_at"), sure.alias("confidence"), F.coalesce(F.col("phase") == "delivered", F.lit(False)).alias("delivered"), F.when(F.col("source_id") % 3 > 0, text_key(nth(_CALLED))).alias("consignor"))
    found = bridged(p.drop("k", "order_key"), stored, anchors, rows)
    one = F.col("decision") == "linkable"
    return found.select("user_id", "slug", "tracking", "n", "decision", "purchase_id", (one & F.col("corroborated")).alias("corroborated"))


def _label(x: str) -> str:
    return f"array_to_string(list_filter(string_split({_party_key(f'coalesce({x}, chr(32))')}, ' '), lambda w: length(w) > 1 AND NOT list_contains({_sql_list(GENERIC)}, w)), ' ')"


_PARCEL = _EXISTING + f""", b AS (SELECT purchase_id, user_id, sender, order_key, merchant, CASE WHEN purchase_id % 3 = 1 THEN 'scitec.hu' ELSE sender END AS domain, ordered_at, round(value / 20) AS total, CASE WHEN purchase_id % 3 > 0 THEN ' huf' ELSE 'EUR' END AS currency, round(least(1.0, 0.94 + value / 1000), 4) AS sure FROM px),
    un AS (SELECT user_id, domain, order_key, min(purchase_id) AS purchase_id FROM b GROUP BY 1, 2, 3 HAVING count(*) = 1), an AS (SELECT un.purchase_id, ev.user_id, ev.received_at AS at, ev.confidence, ev.slug FROM ev JOIN un ON un.user_id = ev.user_id AND un.domain = ev.sender AND un.order_key = ev.order_key WHERE ev.event IN ('shipment', 'order_updated') AND ev.role = 'merchant'),
    cr AS (SELECT source_id, user_id, slug, k // 50 AS tracking, received_at AS at, confidence, CASE phase WHEN 'created' THEN 'shipment_created' ELSE phase END AS phase, CASE source_id % 4 WHEN 0 THEN 'BioTechUSA Kft.' WHEN 1 THEN 'Shop' || k % 3 || ' Example Kft' WHEN 2 THEN merchant END AS called, CASE WHEN source_id % 2 = 0 THEN round(value / 20) END AS cod FROM ev WHERE event = 'shipment' AND role = 'carrier' AND slug IS NOT NULL),
    cl AS (SELECT user_id, slug, tracking, max(confidence) AS confidence, bool_or(coalesce(phase = 'ready_for_pickup', false)) AS ready, count(DISTINCT source_id) AS n_sources, bool_or(coalesce(phase IS NOT NULL AND phase <> 'shipment_created', false)) AS physical, list(DISTINCT {_label("called")}) AS labels FROM cr GROUP BY 1, 2, 3),
    al AS (SELECT purchase_id, list_filter([{_label("merchant")}, {_label("domain")}, {_label("regexp_replace(domain, '[.][^.]*$', '')")}], lambda x: x <> '') AS aliases FROM b),
    m AS (SELECT cl.user_id, cl.slug, cl.tracking, an.purchase_id, max(an.confidence) AS anchor FROM cl JOIN an USING (user_id) JOIN al USING (purchase_id) WHERE (an.slug IS NULL OR an.slug = cl.slug) AND len(list_filter(labels, lambda l: length(l) >= 4 AND len(list_filter(aliases, lambda x: x = l OR (length(x) >= 5 AND length(l) >= 5 AND (contains(x, l) OR contains(l, x))))) > 0)) > 0
        AND EXISTS (SELECT 1 FROM cr WHERE cr.user_id = cl.user_id AND cr.slug = cl.slug AND cr.tracking = cl.tracking AND abs(epoch_us(an.at) - epoch_us(cr.at)) <= 7 * 86400000000) GROUP BY 1, 2, 3, 4),
    c AS (SELECT user_id, slug, tracking, count(*) AS n, min(purchase_id) AS purchase_id, max(anchor) AS anchor FROM m GROUP BY 1, 2, 3),
    v AS (SELECT cl.user_id, cl.slug, cl.tracking, count(*) AS n, min(purchase_id) AS purchase_id, max(b.sure) AS anchor FROM cl JOIN b USING (user_id) WHERE n_sources >= 2 AND physical AND b.sure >= 0.95 AND b.domain = 'scitec.hu' AND cl.slug = 'foxpost' AND list_contains(labels, 'biotechusa')
        AND EXISTS (SELECT 1 FROM cr WHERE cr.user_id = cl.user_id AND cr.slug = cl.slug AND cr.tracking = cl.tracking AND abs(cod - total) < 0.001 AND upper(trim(b.currency)) = 'HUF') AND EXISTS (SELECT 1 FROM cr WHERE cr.user_id = cl.user_id AND cr.slug = cl.slug AND cr.tracking = cl.tracking AND abs(epoch_us(b.ordered_at) - epoch_us(cr.at)) <= 7 * 86400000000)
        AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = cl.user_id AND c.slug = cl.slug AND c.tracking = cl.tracking) GROUP BY 1, 2, 3)"""


@query(E + _PARCEL + """, f AS (SELECT cl.*, coalesce(c.n, v.n) AS n, coalesce(c.purchase_id, v.purchase_id) AS p, coalesce(c.anchor, v.anchor) AS anchor, CASE WHEN c.n IS NOT NULL THEN 1 WHEN v.n IS NOT NULL THEN 2 END AS lane FROM cl LEFT JOIN c USING (user_id, slug, tracking) LEFT JOIN v USING (user_id, slug, tracking))
    SELECT user_id, slug, tracking, CASE WHEN n = 1 THEN 'linkable' WHEN n > 1 THEN 'review' ELSE 'unmatched' END AS decision, CASE WHEN n = 1 THEN p END AS purchase_id, CASE WHEN n = 1 THEN least(confidence, anchor) ELSE confidence END AS confidence, CASE WHEN ready THEN 'ready_for_pickup' ELSE 'in_transit' END AS status, lane FROM f""")
def parcel_sender_bridge(spark, d):
    """Parcels of a carrier, and the one purchase whose merchant sent word and is the parcel's sender, or else whose sum the carrier collects."""
    e = evidence(spark, d)
    i, value = F.col("source_id"), F.col("value")
    b = _existing(e).select("purchase_id", "user_id", "sender", "order_key", "merchant", F.when(F.col("purchase_id") % 3 == 1, "scitec.hu").otherwise(F.col("sender")).alias("domain"), "ordered_at", F.round(value / 20).alias("total"), F.when(F.col("purchase_id") % 3 > 0, " huf").otherwise("EUR").alias("currency"), F.round(F.least(F.lit(1.0), 0.94 + value / 1000), 4).alias("purchase_confidence"))
    unique = b.groupBy("user_id", F.col("domain").alias("sender"), "order_key").agg(F.count(F.lit(1)).alias("n"), F.min("purchase_id").alias("purchase_id")).where("n = 1").drop("n")
    anchors = e.where("event in ('shipment', 'order_updated') and role = 'merchant'").join(unique, ["user_id", "sender", "order_key"]).select("purchase_id", F.col("received_at").alias("anchor_at"), F.col("confidence").alias("anchor"), F.col("slug").alias("anchor_slug"))
    called = F.when(i % 4 == 0, "BioTechUSA Kft.").when(i % 4 == 1, F.concat(F.lit("Shop"), F.col("k") % 3, F.lit(" Example Kft"))).when(i % 4 == 2, F.col("merchant"))
    rows = e.where("event = 'shipment' and role = 'carrier' and slug is not null").select("source_id", "user_id", "slug", F.floor(F.col("k") / 50).alias("tracking"), F.col("received_at").alias("carrier_at"), "confidence", "event", F.when(F.col("phase") == "created", "shipment_created").otherwise(F.col("phase")).alias("phase"), called.alias("sender"), F.when(i % 2 == 0, F.round(value / 20)).alias("cod"), F.lit("HUF").alias("cod_currency"))
    return by_sender(b, anchors, rows)


_AMOUNT = "coalesce(CASE WHEN source_id % 5 > 0 THEN round(value) END, round(value * 0.9) + order_key - k % 3)"


@query(E + f""", b AS (SELECT source_id AS purchase_id, user_id, {_AMOUNT} AS amount, received_at AS at FROM ev WHERE event = 'order_created'), a AS (SELECT source_id, user_id, round(value) AS paid, received_at FROM ev WHERE event = 'payment_completed'),
    m AS (SELECT a.source_id, count(b.purchase_id) AS n, min(b.purchase_id) AS p FROM a LEFT JOIN b ON b.user_id = a.user_id AND b.amount = a.paid AND abs(epoch_us(a.received_at) - epoch_us(b.at)) <= 7200000000 GROUP BY 1)
    SELECT source_id, n, CASE WHEN n = 1 THEN 'linkable' ELSE 'review' END AS decision, CASE WHEN n = 1 THEN p END AS purchase_id FROM m""")
def terminal_receipt(spark, d):
    """A receipt of a terminal links to the one purchase of exactly its amount within two hours; the amount is the total, or without one the subtotal and the shipping less the discount."""
    e = evidence(spark, d)
    amount = F.coalesce(F.when(F.col("source_id") % 5 > 0, F.round("value")), F.round(F.col("value") * 0.9) + F.col("order_key") - F.col("k") % 3)
    b = e.where("event = 'order_created'").select(F.col("source_id").alias("purchase_id"), "user_id", amount.alias("amount"), F.col("received_at").alias("at"))
    a = e.where("event = 'payment_completed'").select("source_id", "user_id", F.round("value").alias("amount"), "received_at")
    m = interval_join(a, b, ["user_id", "amount"], "received_at", "at", 2, symmetric=True).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("purchase_id").alias("p"))
    out = a.select("source_id").join(m, "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("source_id", "n", F.when(F.col("n") == 1, "linkable").otherwise("review").alias("decision"), F.when(F.col("n") == 1, F.col("p")).alias("purchase_id"))


_STATES = "(['ordered', 'paid', 'processing', 'payment_failed', 'cancelled', 'in_transit', 'delayed', 'delivered', 'refunded'])[o_orderkey % 9 + 1]"
_LIFE = """sh AS (SELECT l_orderkey, l_suppkey, CASE WHEN min(l_linestatus) = 'F' THEN 'delivered' ELSE 'in_transit' END AS status, min(l_shipdate) AS shipped_at, CASE WHEN min(l_linestatus) = 'F' THEN max(l_shipdate) + INTERVAL 2 DAY END AS delivered_at, CASE WHEN l_suppkey % 3 > 0 THEN max(l_shipdate) + INTERVAL 1 DAY END AS last_event_at FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1, 2),
    la AS (SELECT l_orderkey, greatest(shipped_at, coalesce(delivered_at, shipped_at), coalesce(last_event_at, shipped_at)) AS at, status FROM sh QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY greatest(shipped_at, coalesce(delivered_at, shipped_at), coalesce(last_event_at, shipped_at)) DESC, l_suppkey) = 1)"""


def _shipments_of_orders(spark, d):
    s = table(spark, d, "lineitem").where("l_orderkey % 5 > 0").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linestatus").alias("low"), F.min("l_shipdate").alias("shipped_at"), F.max("l_shipdate").alias("last"))
    done = F.col("low") == "F"
    return s.select("l_orderkey", "l_suppkey", F.when(done, "delivered").otherwise("in_transit").alias("status"), "shipped_at", F.when(done, F.expr("last + INTERVAL 2 DAYS")).alias("delivered_at"), F.when(F.col("l_suppkey") % 3 > 0, F.expr("last + INTERVAL 1 DAY")).alias("last_event_at"))


@query(f"WITH {_LIFE} SELECT l_orderkey, la.at AS latest_at, status FROM la")
def latest_of_three(spark, d):
    """The latest of three times over all shipments of an order, and the status of the shipment that has it."""
    return merge.latest_shipment(_shipments_of_orders(spark, d), ["l_orderkey"], tie="l_suppkey").withColumnRenamed("at", "latest_at")


@query(f"""WITH {_LIFE}, x AS (SELECT o_orderkey, {_STATES} AS state, (['payment_failed', 'cancelled', 'order_packing', 'delayed', 'order_processing'])[o_orderkey % 5 + 1] AS event, CASE o_orderkey % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'failed' END AS payment, la.l_orderkey IS NOT NULL AS has, CASE WHEN la.at > o_orderdate + INTERVAL 40 DAY THEN la.status END AS newer FROM orders LEFT JOIN la ON l_orderkey = o_orderkey),
    y AS (SELECT *, state IN ('cancelled', 'refunded', 'returned', 'delivered') AS final, state IN ('in_transit', 'shipped') AS moving, CASE WHEN newer = 'delivered' THEN 'delivered' WHEN newer IS NOT NULL THEN 'in_transit' END AS recovered FROM x)
    SELECT o_orderkey, state AS before, event, CASE event WHEN 'payment_failed' THEN CASE WHEN payment = 'paid' THEN CASE state WHEN 'payment_failed' THEN 'paid' ELSE state END WHEN final OR moving OR state = 'paid' THEN state ELSE 'payment_failed' END WHEN 'cancelled' THEN CASE WHEN final OR moving OR has THEN state ELSE 'cancelled' END
      WHEN 'delayed' THEN CASE WHEN final OR state = 'payment_failed' THEN state ELSE coalesce(recovered, 'delayed') END ELSE CASE WHEN final OR moving OR state = 'payment_failed' OR coalesce(payment = 'failed', false) THEN state ELSE coalesce(recovered, 'processing') END END AS after FROM y""")
def lifecycle_patch(spark, d):
    """The state of each purchase after an event; a shipment that is newer than the event overrules it."""
    nth = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    late = merge.latest_shipment(_shipments_of_orders(spark, d), ["l_orderkey"], tie="l_suppkey")
    j = table(spark, d, "orders").join(late, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    state, event = nth(("ordered", "paid", "processing", "payment_failed", "cancelled", "in_transit", "delayed", "delivered", "refunded")), nth(("payment_failed", "cancelled", "order_packing", "delayed", "order_processing"))
    payment = F.when(F.col("o_orderkey") % 4 == 0, "paid").when(F.col("o_orderkey") % 4 == 1, "failed")
    newer = F.when(F.expr("at > o_orderdate + INTERVAL 40 DAYS"), F.col("status"))
    return j.select("o_orderkey", state.alias("before"), event.alias("event"), merge.lifecycle_state(state, event, F.col("l_orderkey").isNotNull(), payment, newer).alias("after"))


@query(E + " SELECT user_id, source_id AS anchor_id, confidence FROM ev WHERE event = 'invoice_or_receipt' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, received_at, source_id) = 1")
def anchor_order(spark, d):
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "received_at", "source_id"))
    return evidence(spark, d).where("event = 'invoice_or_receipt'").groupBy("user_id").agg(best.alias("b")).select("user_id", F.col("b.source_id").alias("anchor_id"), (-F.col("b.c")).alias("confidence"))


@query(E + """ SELECT source_id, 'purchase' AS kind, order_key AS identity, confidence FROM ev WHERE order_key IS NOT NULL AND event IN ('order_created', 'order_updated', 'payment_completed') UNION ALL SELECT source_id, 'shipment', k, confidence FROM ev WHERE event = 'shipment' AND k IS NOT NULL
    UNION ALL SELECT source_id, 'document', order_key, confidence FROM ev WHERE event = 'invoice_or_receipt' AND order_key IS NOT NULL""")
def evidence_projection(spark, d):
    """Evidence rows in the three shapes that resolvers read."""
    e, event = evidence(spark, d), F.col("event")
    shape = lambda kind, ok, identity: F.when(ok & identity.isNotNull(), F.struct(F.lit(kind).alias("kind"), identity.alias("identity")))
    shapes = F.array(shape("purchase", event.isin("order_created", "order_updated", "payment_completed"), F.col("order_key")), shape("shipment", event == "shipment", F.col("k")), shape("document", event == "invoice_or_receipt", F.col("order_key")))
    return e.select("source_id", F.explode(F.array_compact(shapes)).alias("s"), "confidence").select("source_id", "s.kind", "s.identity", "confidence")


@query(E + f""", u AS (SELECT DISTINCT user_id FROM ev WHERE received_at >= TIMESTAMP '2024-01-24' AND received_at < TIMESTAMP '2024-01-25')
    SELECT user_id, count(*) AS n, max(received_at) AS last_at, count(*) FILTER (WHERE received_at >= TIMESTAMP '2024-01-18') AS n_week, count(*) FILTER (WHERE received_at >= TIMESTAMP '2024-01-11') AS n_fortnight FROM ev JOIN u USING (user_id) WHERE received_at >= TIMESTAMP '2024-01-25' - INTERVAL 45 DAY AND received_at < TIMESTAMP '2024-01-25' GROUP BY 1""")
def recompute_window(spark, d):
    """The last 45 days of the users that something came in for on the last day."""
    e = evidence(spark, d).where(f"received_at < {AS_OF}")
    since = lambda n: F.expr(f"received_at >= {AS_OF} - INTERVAL {n} DAYS")
    touched = e.where(since(1)).select("user_id").distinct()
    return e.where(since(45)).join(touched, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("received_at").alias("last_at"), F.count_if(since(7)).alias("n_week"), F.count_if(since(14)).alias("n_fortnight"))


@query(E + """, seen AS (SELECT DISTINCT user_id, k FROM ev WHERE event = 'order_created'), c AS (SELECT user_id, k, count(*) AS n FROM ev WHERE event = 'shipment' GROUP BY 1, 2)
    SELECT c.user_id, sum(n)::BIGINT AS checked, count(*) FILTER (WHERE seen.k IS NULL) AS created, (sum(n) - count(*) FILTER (WHERE seen.k IS NULL))::BIGINT AS duplicates, sum(n) > 25 AS has_more FROM c LEFT JOIN seen USING (user_id, k) GROUP BY 1""")
def insert_if_new_counts(spark, d):
    """Of each user: rows looked at, new ones (the first of each key), duplicates, and whether one page would not hold them."""
    e = evidence(spark, d)
    rows = e.where("event = 'shipment'").select("user_id", "k", "source_id")
    fresh = merge.inserted_if_new(e.where("event = 'order_created'"), rows, ["user_id", "k"], ["source_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("created"))
    out = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("checked")).join(fresh, "user_id", "left").withColumn("created", F.coalesce("created", F.lit(0)))
    return out.select("user_id", "checked", "created", (F.col("checked") - F.col("created")).alias("duplicates"), (F.col("checked") > 25).alias("has_more"))


@query(E + """, l AS (SELECT source_id, user_id, k AS thread, CASE WHEN event = 'order_created' THEN order_key END AS purchase FROM ev), t AS (SELECT DISTINCT user_id, thread, purchase FROM l WHERE purchase IS NOT NULL)
    SELECT l.source_id, count(DISTINCT t.purchase) AS n, CASE WHEN count(DISTINCT t.purchase) = 1 THEN min(t.purchase) END AS purchase FROM l JOIN t USING (user_id, thread) WHERE l.purchase IS NULL GROUP BY 1""")
def thread_adjacency(spark, d):
    """Sources without a link, and the purchases that other sources of their thread are linked to."""
    e = evidence(spark, d).select("source_id", "user_id", F.col("k").alias("thread"), F.when(F.col("event") == "order_created", F.col("order_key")).alias("purchase"))
    linked = e.where("purchase is not null").groupBy("user_id", "thread").agg(F.collect_set("purchase").alias("p"))  # order keys of one thread of one user: ten at most
    return e.where("purchase is null").join(linked, ["user_id", "thread"]).select("source_id", F.size("p").cast("long").alias("n"), F.when(F.size("p") == 1, F.get("p", F.lit(0))).alias("purchase"))


@query(E + """, g AS (SELECT user_id, order_key, arg_min(received_at, (received_at, source_id)) FILTER (WHERE event = 'invoice_or_receipt') AS anchor_at, count(*) FILTER (WHERE event = 'invoice_or_receipt') AS n_anchors, bool_or(event = 'order_created' AND confidence >= 0.9) AS ordered FROM ev GROUP BY 1, 2),
    s AS (SELECT g.user_id, g.order_key, count(*) FILTER (WHERE event = 'order_updated') AS n_delays, count(*) FILTER (WHERE event = 'shipment') AS n_pickups FROM g JOIN ev USING (user_id, order_key) WHERE n_anchors = 1 AND abs(epoch_us(received_at) - epoch_us(anchor_at)) <= 14 * 86400000000 GROUP BY 1, 2),
    p AS (SELECT sha256(concat_ws('|', user_id, 'reconstruct', order_key)) AS key, (user_id + order_key) % 3 AS checked FROM (SELECT DISTINCT user_id, order_key FROM ev))
    SELECT g.user_id, g.order_key, n_delays, n_pickups, CASE WHEN n_delays >= 1 AND n_pickups >= 1 AND checked >= 1 THEN 'recover' ELSE 'wait' END AS decision FROM g JOIN s USING (user_id, order_key) JOIN p ON p.key = sha256(concat_ws('|', g.user_id, 'reconstruct', g.order_key)) WHERE NOT ordered""")
def single_merchant_recovery(spark, d):
    """Orders with one invoice, a delay and a pickup within fourteen days, no confirmation, and a search that found none.

    Search proofs are found by the hash of what was searched for.
    """
    e, keys = evidence(spark, d), ["user_id", "order_key"]
    invoice = F.col("event") == "invoice_or_receipt"
    g = e.groupBy(*keys).agg(F.min(F.when(invoice, F.struct("received_at", "source_id"))).alias("first"), F.count_if(invoice).alias("n_anchors"), F.bool_or(F.expr("event = 'order_created' and confidence >= 0.9")).alias("ordered")).where("n_anchors = 1 and not ordered")
    anchors = g.select(*keys, F.col("first.received_at").alias("anchor_at"))
    near = interval_join(anchors, e.select(*keys, "event", F.col("received_at").alias("at")), keys, "anchor_at", "at", 336, symmetric=True)
    s = near.groupBy(*keys).agg(F.count_if(F.col("event") == "order_updated").alias("n_delays"), F.count_if(F.col("event") == "shipment").alias("n_pickups")).withColumn("key", dedupe_key(F.col("user_id"), F.lit("reconstruct"), F.col("order_key")))
    proofs = e.select(*keys).distinct().select(dedupe_key(F.col("user_id"), F.lit("reconstruct"), F.col("order_key")).alias("key"), ((F.col("user_id") + F.col("order_key")) % 3).alias("checked"))
    ok = (F.col("n_delays") >= 1) & (F.col("n_pickups") >= 1) & (F.col("checked") >= 1)
    return s.join(proofs, "key").select(*keys, "n_delays", "n_pickups", F.when(ok, "recover").otherwise("wait").alias("decision"))


@query(E + """, g AS (SELECT user_id, count(*) FILTER (WHERE event = 'order_created' AND confidence < 0.9 AND confidence >= 0.7) AS review, count(*) FILTER (WHERE event = 'shipment' AND merchant IS NULL) AS unlinked, count(*) FILTER (WHERE event = 'invoice_or_receipt' AND confidence >= 0.65) AS invoices FROM ev GROUP BY 1)
    SELECT drain, mode, sum(n)::BIGINT AS scanned, CASE mode WHEN 'write' THEN sum(n)::BIGINT ELSE 0 END AS applied, count(*) FILTER (WHERE n > 0) AS users FROM (SELECT user_id, unnest(['review', 'unlinked', 'invoices']) AS drain, unnest([review, unlinked, invoices]) AS n FROM g), (VALUES ('observe'), ('write')) m(mode) GROUP BY 1, 2""")
def recovery_drains(spark, d):
    """What three recoveries would take up, by user first; observing writes nothing."""
    g = evidence(spark, d).groupBy("user_id").agg(F.count_if(F.expr("event = 'order_created' and confidence < 0.9 and confidence >= 0.7")).alias("review"), F.count_if(F.expr("event = 'shipment' and merchant is null")).alias("unlinked"), F.count_if(F.expr("event = 'invoice_or_receipt' and confidence >= 0.65")).alias("invoices"))
    long = g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("drain"), F.col(c).alias("n")) for c in ("review", "unlinked", "invoices")])).alias("x")).select("x.*")
    sums = long.groupBy("drain").agg(F.sum("n").alias("scanned"), F.count_if(F.col("n") > 0).alias("users"))
    return sums.select("drain", F.explode(F.array(F.lit("observe"), F.lit("write"))).alias("mode"), "scanned", "users").withColumn("applied", F.when(F.col("mode") == "write", F.col("scanned")).otherwise(0))


#: Two rows a source; states, subjects and names by the row.
_STATES_OF = ("validated", "guardrailed", "review", None, "validated")
_LEGAL = ("Blue Kettle Kft", None, "Kettle", "Tea Bolt Zrt")
_REVIEW_ROWS = f""", w AS (SELECT source_id AS row_id, source_id // 2 AS source_id, user_id, sender, order_key AS "order", event, CASE WHEN source_id % 6 = 0 THEN 'Rendelésedet összekészítettük!' ELSE 'Hello' END AS subject, CASE WHEN source_id % 3 > 0 THEN 'review' ELSE 'processed' END AS processing, (['validated', 'guardrailed', 'review', NULL, 'validated'])[source_id % 5 + 1] AS validation, merchant,
        (['Blue Kettle Kft', NULL, 'Kettle', 'Tea Bolt Zrt'])[source_id % 4 + 1] AS legal, {_NUMBER.format("k")} AS tracking, CASE WHEN source_id % 2 = 0 THEN 'paid' ELSE 'failed' END AS payment, round(least(1.0, confidence + 0.1), 4) AS confidence FROM ev WHERE order_key IS NOT NULL),
    pk AS (SELECT *, regexp_matches({_party_key("subject")}, 'osszekeszitettuk|packing') AS packs FROM w), an AS (SELECT * FROM pk WHERE processing = 'review' AND event = 'order_created' AND NOT packs AND merchant IS NOT NULL AND confidence >= 0.7 QUALIFY row_number() OVER (PARTITION BY user_id, sender, "order" ORDER BY confidence DESC, row_id) = 1),
    sp AS (SELECT an.row_id AS anchor, s.*, {_party_key("coalesce(an.legal, '')")} AS la, {_party_key("coalesce(s.legal, '')")} AS ls, s.validation IN ('validated', 'guardrailed') AND ((s.event IN ('order_updated', 'shipment', 'delivery', 'invoice_or_receipt') AND s.confidence >= 0.7) OR (s.event = 'payment_completed' AND s.payment = 'paid' AND s.confidence >= 0.75)) AS trusted,
        s.validation = 'review' AND s.event = 'payment_completed' AND s.payment = 'failed' AND s.confidence >= 0.75 AS identity, s.validation IN ('validated', 'guardrailed') AND s.event = 'order_created' AND s.confidence >= 0.75 AND s.packs AS packing FROM an JOIN pk s USING (user_id, sender, "order") WHERE s.source_id <> an.source_id),
    su AS (SELECT anchor, count(*) FILTER (WHERE trusted) AS n_trusted, count(*) FILTER (WHERE identity) AS n_identity, count(*) FILTER (WHERE packing) AS n_packing, max(confidence) FILTER (WHERE trusted) AS t, max(confidence) FILTER (WHERE packing) AS p, bool_or(trusted AND event = 'shipment' AND confidence >= 0.75 AND (length(tracking) >= 10 OR (la <> '' AND ls <> '' AND (la = ls OR (length(la) >= 5 AND length(ls) >= 5 AND (contains(la, ls) OR contains(ls, la))))))) AS strong FROM sp GROUP BY 1),
    rs AS (SELECT an.*, coalesce(n_trusted, 0) AS n_trusted, coalesce(n_identity, 0) AS n_identity, coalesce(n_packing, 0) AS n_packing, CASE WHEN an.confidence >= 0.85 AND (coalesce(t, 0) >= 0.74 OR coalesce(p, 0) >= 0.8) THEN least(0.97, an.confidence + 0.08) WHEN an.confidence >= 0.8 AND coalesce(t, 0) >= 0.72 AND n_trusted + n_identity + n_packing >= 2 THEN least(0.95, an.confidence + 0.08) WHEN strong THEN least(0.92, an.confidence + 0.12) END AS raised FROM an LEFT JOIN su ON su.anchor = an.row_id)"""


@query(E + _REVIEW_ROWS + """ SELECT user_id, sender, "order", row_id AS anchor, round(coalesce(raised, confidence), 4)::DOUBLE AS confidence, CASE WHEN raised IS NULL THEN 'review' ELSE 'create' END AS decision, n_trusted, n_identity, n_packing FROM rs""")
def review_support(spark, d):
    """Confirmations under review, and how far other sources raise them."""
    e, i = evidence(spark, d).where("order_key is not null"), F.col("source_id")
    nth = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    number = F.when(F.col("k") >= 10, F.concat(F.lit("TRK"), F.lpad(F.col("k").cast("string"), 7, "0"))).otherwise(F.concat(F.lit("T"), "k"))
    rows = e.select(
        i.alias("row_id"), F.floor(i / 2).alias("source_id"), "user_id", "sender", F.col("order_key").alias("order"), "event", F.when(i % 6 == 0, "Rendelésedet összekészítettük!").otherwise("Hello").alias("subject"), F.when(i % 3 > 0, "review").otherwise("processed").alias("processing"),
        nth(_STATES_OF).alias("validation"), "merchant", nth(_LEGAL).alias("legal"), number.alias("tracking"), F.when(i % 2 == 0, "paid").otherwise("failed").alias("payment"), F.round(F.least(F.lit(1.0), F.col("confidence") + 0.1), 4).alias("confidence"),
    )
    return reviewed(rows)


def _stream_folder(spark) -> str:
    """A new folder in the one that driver and executors share."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="tidemill-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedupe_counts(spark, d):
    """The event table read as a stream, in one run over all that is there; what comes out is a table of files."""
    out = replayed(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema, _stream_folder(spark))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def inbox_drain(spark, d):
    """The event table drained batch by batch into a table of sums, one part for each batch; a batch that is repeated replaces its part."""
    folder = _stream_folder(spark)

    def merge_batch(batch, number: int) -> None:
        sums = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
        sums.write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")

    drain(spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/event[s].parquet"), merge_batch, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/sums").groupBy("user_id").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


PARTY_GRAM = 3


@query(f"""WITH n AS (SELECT DISTINCT p_name || ' ' || (['Kft', 'Zrt', 'Bolt Ltd'])[p_partkey % 3 + 1] AS name FROM part UNION SELECT replace(p_name, 'l', 'll') || ' Bt' FROM part), k AS (SELECT name, {_party_key("name")} AS key FROM n)
    SELECT a.name AS a, b.name AS b FROM k a JOIN k b ON a.name < b.name WHERE {_same_party("a.key", "b.key")}""")
def party_fuzzy_match(spark, d):
    """Names of companies that look like one party.

    Equal names, names in other names and names one letter apart share a run
    of three letters, or are equal; so candidates meet by such runs, the
    rarest of each name first, and none is missed: of a contained name every
    run is in the other, and an edit spoils three runs at most, so a name asks
    with its four rarest (all, if it has fewer).
    """
    part = table(spark, d, "part")
    forms = F.element_at(F.array(F.lit("Kft"), F.lit("Zrt"), F.lit("Bolt Ltd")), (F.col("p_partkey") % 3 + 1).cast("int"))
    n = part.select(F.concat_ws(" ", "p_name", forms).alias("name")).unionByName(part.select(F.concat(F.replace("p_name", F.lit("l"), F.lit("ll")), F.lit(" Bt")).alias("name"))).distinct().withColumn("key", text_key(F.col("name")))
    core = F.regexp_extract("key", rf"^(.+?)(?: (?:{'|'.join(LEGAL_FORMS)}))*$", 1)
    runs = lambda t: F.array_distinct(F.when(F.length(t) < PARTY_GRAM, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (PARTY_GRAM - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(PARTY_GRAM)))))
    n = n.withColumn("asks", F.when(F.length(core) < PARTY_GRAM, F.col("key")).otherwise(core))
    held = n.select("name", "key", F.explode(runs(F.col("key"))).alias("run"))
    asked = n.select("name", "key", F.explode(runs(F.col("asks"))).alias("run")).join(held.groupBy("run").agg(F.count(F.lit(1)).alias("times")), "run")
    asked = asked.withColumn("place", F.row_number().over(W.partitionBy("name").orderBy("times", "run"))).where("place <= 4")
    pairs = asked.select(F.col("name").alias("x"), F.col("key").alias("x_key"), "run").join(held.select(F.col("name").alias("y"), F.col("key").alias("y_key"), "run"), "run").where("x <> y").where(same_party(F.col("x_key"), F.col("y_key")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


_LANES = """, g AS (SELECT user_id, sender, order_key, bool_or(event = 'order_created') AS ordered, max(confidence) FILTER (WHERE event = 'order_updated') AS auxiliary, bool_or(coalesce(phase = 'delivered', false)) AS delivered, min(received_at) AS since FROM ev WHERE role = 'merchant' GROUP BY 1, 2, 3),
    i AS (SELECT user_id, sender, order_key, source_id AS invoice_id, received_at AS at FROM ev WHERE role = 'merchant' AND event = 'invoice_or_receipt' AND confidence >= 0.65 QUALIFY row_number() OVER (PARTITION BY user_id, sender, order_key ORDER BY confidence DESC, received_at, source_id) = 1),
    s AS (SELECT i.user_id, i.sender, i.order_key, invoice_id, ev.k // 10 AS tracking, ev.received_at AS s_at, ev.slug FROM i JOIN ev USING (user_id, sender, order_key) WHERE ev.event = 'shipment' AND ev.confidence >= 0.75 AND ev.k >= 10 AND ev.slug IS NOT NULL AND abs(epoch_us(ev.received_at) - epoch_us(i.at)) <= 14 * 86400000000),
    p AS (SELECT s.user_id, s.sender, s.order_key, invoice_id, count(DISTINCT c.source_id) AS n_proofs FROM s JOIN ev c ON c.user_id = s.user_id AND c.role = 'carrier' AND c.event = 'shipment' AND c.confidence >= 0.85 AND c.k // 10 = s.tracking AND abs(epoch_us(c.received_at) - epoch_us(s.s_at)) <= 7 * 86400000000 GROUP BY 1, 2, 3, 4)"""


@query(E + _LANES + """ SELECT i.invoice_id, coalesce(n_proofs, 0) AS n_proofs, CASE WHEN coalesce(n_proofs, 0) > 0 AND auxiliary >= 0.7 AND (i.user_id + i.order_key) % 3 >= 1 THEN 'reconstruct' ELSE 'wait' END AS decision, CASE WHEN coalesce(n_proofs, 0) > 0 AND auxiliary >= 0.7 AND (i.user_id + i.order_key) % 3 >= 1 THEN CASE WHEN delivered THEN 0.9 ELSE 0.88 END END::DOUBLE AS confidence, since FROM i JOIN g USING (user_id, sender, order_key) LEFT JOIN p USING (user_id, sender, order_key, invoice_id) WHERE NOT ordered""")
def reconstruction_lane(spark, d):
    """Invoices without an order confirmation whose parcel the merchant announced and the carrier confirms.

    The merchant's word is within fourteen days of the invoice, the carrier's
    within seven of that, by the same number; some other update of the order
    and a search that found nothing must support them.
    """
    e, keys = evidence(spark, d), ["user_id", "sender", "order_key"]
    merchants = e.where("role = 'merchant'")
    invoice = F.when(F.expr("event = 'invoice_or_receipt' and confidence >= 0.65"), F.struct((-F.col("confidence")).alias("c"), "received_at", "source_id"))
    g = merchants.groupBy(*keys).agg(F.min(invoice).alias("i"), F.bool_or(F.col("event") == "order_created").alias("ordered"), F.max(F.when(F.col("event") == "order_updated", F.col("confidence"))).alias("auxiliary"), F.bool_or(F.coalesce(F.col("phase") == "delivered", F.lit(False))).alias("delivered"), F.min("received_at").alias("since"))
    g = g.where("not ordered and i is not null").select(*keys, F.col("i.source_id").alias("invoice_id"), F.col("i.received_at").alias("at"), "auxiliary", "delivered", "since")
    number = F.floor(F.col("k") / 10).alias("tracking")
    announced = merchants.where("event = 'shipment' and confidence >= 0.75 and k >= 10 and slug is not null").select(*keys, number, F.col("received_at").alias("s_at"))
    s = interval_join(g.select(*keys, "invoice_id", "at"), announced, keys, "at", "s_at", 336, symmetric=True).select("user_id", "invoice_id", "tracking", "s_at")
    carried = e.where("role = 'carrier' and event = 'shipment' and confidence >= 0.85").select("user_id", number, F.col("received_at").alias("c_at"), "source_id")
    proofs = interval_join(s, carried, ["user_id", "tracking"], "s_at", "c_at", 168, symmetric=True).groupBy("invoice_id").agg(F.count_distinct("source_id").alias("n_proofs"))
    j = g.join(proofs, "invoice_id", "left").withColumn("n_proofs", F.coalesce("n_proofs", F.lit(0)))
    ok = F.coalesce((F.col("n_proofs") > 0) & (F.col("auxiliary") >= 0.7) & ((F.col("user_id") + F.col("order_key")) % 3 >= 1), F.lit(False))
    return j.select("invoice_id", "n_proofs", F.when(ok, "reconstruct").otherwise("wait").alias("decision"), F.when(ok, F.when(F.col("delivered"), 0.9).otherwise(0.88)).alias("confidence"), "since")


#: What lane two reads: merchants' names, parcels of fifty numbers, sums, and messages that are surer and closer in time than the table's.
_LANE_2 = _LANES + """, x AS (SELECT *, round(least(1.0, confidence + 0.2), 4) AS sure, make_timestamp(epoch_us(received_at) // 4) AS t, lower('web' || replace(merchant, ' ', '')) AS name FROM ev),
    v AS (SELECT x.user_id, x.sender, x.order_key, source_id AS invoice_id, t AS at, name FROM x JOIN g USING (user_id, sender, order_key) WHERE role = 'merchant' AND event = 'invoice_or_receipt' AND sure >= 0.65 AND NOT ordered AND (x.user_id + x.order_key) % 3 >= 1 AND merchant IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x.user_id, x.sender, x.order_key ORDER BY sure DESC, t, source_id) = 1),
    h AS (SELECT invoice_id, x.source_id AS shipment_id, x.t AS s_at FROM v JOIN x USING (user_id, sender, order_key) WHERE x.event = 'shipment' AND x.sure >= 0.75 AND x.k % 4 > 0 AND abs(epoch_us(x.t) - epoch_us(v.at)) <= 14 * 86400000000),
    cr AS (SELECT source_id, user_id, slug, k // 50 AS tracking, t AS c_at, coalesce(phase IS NOT NULL AND phase <> 'created', false) AS physical, CASE source_id % 3 WHEN 0 THEN 'webshop' || k % 3 || 'kft' WHEN 1 THEN 'other party' END AS called, CASE WHEN source_id % 2 = 0 THEN user_id % 9 * 100 + CASE WHEN source_id % 40 = 0 THEN 1 ELSE 0 END END AS cod FROM x WHERE role = 'carrier' AND event = 'shipment' AND sure >= 0.85 AND slug IS NOT NULL),
    f AS (SELECT v.invoice_id, h.shipment_id, cr.slug, cr.tracking, count(*) AS n_rows FROM v JOIN h USING (invoice_id) JOIN cr USING (user_id) WHERE abs(epoch_us(cr.c_at) - epoch_us(h.s_at)) <= 7 * 86400000000 AND abs(epoch_us(cr.c_at) - epoch_us(v.at)) <= 7 * 86400000000 GROUP BY 1, 2, 3, 4
        HAVING count(DISTINCT cr.source_id) >= 2 AND bool_or(physical) AND max(cod) - min(cod) < 0.001 AND bool_or(length(called) >= 6 AND length(name) >= 6 AND (contains(called, name) OR contains(name, called)))),
    o AS (SELECT invoice_id, shipment_id, count(*) AS n, min(slug) AS slug, min(tracking) AS tracking, min(n_rows) AS n_rows FROM f GROUP BY 1, 2)"""


@query(E + _LANE_2 + """ SELECT invoice_id, min(slug) AS slug, min(tracking) AS tracking, min(n_rows) AS n_rows, 0.9::DOUBLE AS confidence FROM o GROUP BY 1 HAVING count(*) = 1 AND max(n) = 1""")
def reconstruction_by_cluster(spark, d):
    """Invoices without an order confirmation whose shipment has no number, and the one parcel that must be theirs."""
    e, keys = evidence(spark, d), ["user_id", "sender", "order_key"]
    i, k = F.col("source_id"), F.col("k")
    x = e.withColumns({"sure": F.round(F.least(F.lit(1.0), F.col("confidence") + 0.2), 4), "t": F.timestamp_micros(F.floor(micros(F.col("received_at")) / 4).cast("long")), "name": F.lower(F.concat(F.lit("web"), F.replace("merchant", F.lit(" "), F.lit(""))))})
    merchants = x.where("role = 'merchant'")
    invoice = F.when(F.expr("event = 'invoice_or_receipt' and sure >= 0.65 and merchant is not null"), F.struct((-F.col("sure")).alias("c"), "t", "source_id", "name"))
    g = merchants.groupBy(*keys).agg(F.min(invoice).alias("i"), F.bool_or(F.col("event") == "order_created").alias("ordered")).where("not ordered and i is not null and (user_id + order_key) % 3 >= 1")
    invoices = g.select(*keys, F.col("i.source_id").alias("invoice_id"), F.col("i.t").alias("at"), F.col("i.name").alias("merchant"), F.lit(None).cast("string").alias("legal"))
    unnumbered = x.where("event = 'shipment' and sure >= 0.75 and k % 4 > 0").select(*keys, i.alias("shipment_id"), F.col("t").alias("s_at"))
    shipments = interval_join(invoices.select(*keys, "invoice_id", "at"), unnumbered, keys, "at", "s_at", 336, symmetric=True).select("invoice_id", "shipment_id", "s_at")
    called = F.when(i % 3 == 0, F.concat(F.lit("webshop"), k % 3, F.lit("kft"))).when(i % 3 == 1, "other party")
    cod = F.when(i % 2 == 0, (F.col("user_id") % 9 * 100 + F.when(i % 40 == 0, 1).otherwise(0)).cast("double"))
    rows = x.where("role = 'carrier' and event = 'shipment' and sure >= 0.85 and slug is not null").select("source_id", "user_id", "slug", F.floor(k / 50).alias("tracking"), F.col("t").alias("c_at"), F.coalesce(F.col("phase").isNotNull() & (F.col("phase") != "created"), F.lit(False)).alias("physical"), called.alias("sender"), cod.alias("cod"), F.lit("HUF").alias("cod_currency"))
    found = by_cluster(invoices.drop("sender", "order_key"), shipments, rows)
    return found.select("invoice_id", "slug", "tracking", "n_rows", F.lit(0.9).alias("confidence"))
