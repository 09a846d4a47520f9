"""Queries over orders, their items and the dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import amount_close
from ..functions.text import carrier_slug, compact_party, identifier
from ..operators import merge
from ..sources.mail import listed, picked
from ..sources.tables import table
from .registry import query


@query("""WITH i AS (SELECT l_orderkey, count(*) AS n_items, count(DISTINCT l_suppkey) AS n_shipments, sum(CAST(l_extendedprice AS DECIMAL(14, 2))) AS subtotal FROM lineitem GROUP BY 1),
    n AS (SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 2 GROUP BY 1)
    SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(n_items, 0) AS n_items, coalesce(n_shipments, 0) AS n_shipments, CAST(subtotal AS DOUBLE) AS subtotal, preview FROM orders LEFT JOIN i ON l_orderkey = o_orderkey LEFT JOIN n ON n.l_orderkey = o_orderkey""")
def purchase_list_assembly(spark, d):
    """Orders with counts of their items and shipments, and their first two items."""
    item = F.struct("l_linenumber", "l_partkey")
    # by supplier first: distinct suppliers are then rows, and of the items of each only two are kept
    parts = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).alias("sub"), F.slice(F.array_sort(F.collect_list(item)), 1, 2).alias("first"))
    items = parts.groupBy("l_orderkey").agg(F.sum("n").alias("n_items"), F.count("l_suppkey").alias("n_shipments"), F.sum("sub").cast("double").alias("subtotal"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 2).alias("first"))
    out = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", zero("n_items"), zero("n_shipments"), "subtotal", F.array_join(F.transform("first", lambda x: x["l_partkey"].cast("string")), ",").alias("preview"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n, count(l_extendedprice) AS n_priced, sum(CAST(l_extendedprice AS DECIMAL(14, 2))) AS subtotal, count(DISTINCT upper(l_returnflag)) FILTER (WHERE l_returnflag IS NOT NULL) AS n_currencies, max(l_returnflag) FILTER (WHERE l_quantity > 10) AS currency FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CAST(CASE WHEN n = n_priced AND n_currencies = 1 THEN subtotal ELSE CAST(o_totalprice AS DECIMAL(14, 2)) END AS DOUBLE) AS subtotal, n_currencies, currency, abs(subtotal - CAST(o_totalprice AS DECIMAL(14, 2))) <= 0.01 AS reconciled FROM orders JOIN s ON o_orderkey = l_orderkey""")
def subtotal_reconcile(spark, d):
    money = lambda c: F.col(c).cast("decimal(14,2)")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count("l_extendedprice").alias("n_priced"), F.sum(money("l_extendedprice")).alias("sub"), F.size(F.collect_set(F.upper("l_returnflag"))).cast("long").alias("n_currencies"), F.max(F.when(F.col("l_quantity") > 10, F.col("l_returnflag"))).alias("currency"))
    out = table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"))
    return out.select("o_orderkey", F.when((F.col("n") == F.col("n_priced")) & (F.col("n_currencies") == 1), F.col("sub")).otherwise(money("o_totalprice")).cast("double").alias("subtotal"), "n_currencies", "currency", (F.abs(F.col("sub") - money("o_totalprice")) <= 0.01).alias("reconciled"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 5) AS n, min(l_returnflag) = max(l_returnflag) AS consistent FROM lineitem GROUP BY 1")
def currency_consistency(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(F.when(F.col("l_quantity") > 5, F.col("l_returnflag"))).alias("n"), (F.min("l_returnflag") == F.max("l_returnflag")).alias("consistent"))


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE abs(l_extendedprice - o_totalprice) <= greatest(1, abs(o_totalprice) * 0.005)")
def amount_close_join(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.where(amount_close(F.col("l_extendedprice"), F.col("o_totalprice"))).select("o_orderkey", "l_linenumber", "l_partkey")


@query("""WITH c AS (SELECT p.p_partkey, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first FROM part p LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 49 GROUP BY 1)
    SELECT p_partkey, n, CASE WHEN n = 0 THEN 'unmatched' WHEN n > 1 THEN 'review' ELSE 'linkable' END AS decision, CASE WHEN n = 1 THEN first END AS order_id FROM c""")
def document_cardinality_guard(spark, d):
    hits = table(spark, d, "lineitem").where("l_quantity >= 49").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"), F.min("l_orderkey").alias("first"))
    c = table(spark, d, "part").join(hits, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.select("p_partkey", "n", F.when(F.col("n") == 0, "unmatched").when(F.col("n") > 1, "review").otherwise("linkable").alias("decision"), F.when(F.col("n") == 1, F.col("first")).alias("order_id"))


@query("""WITH a AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey, CASE WHEN a.n > 1 OR r.n > 1 THEN 'ambiguous' WHEN a.n = 1 AND r.n = 1 AND a.s <> r.s THEN 'conflict' WHEN a.n = 1 THEN 'linked_order' WHEN r.n = 1 THEN 'linked_tracking' ELSE 'unmatched' END AS decision FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN r ON r.l_orderkey = o_orderkey""")
def hard_anchor_conflict(spark, d):
    items = table(spark, d, "lineitem")
    side = lambda flag, p: items.where(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias(f"{p}_n"), F.min("l_suppkey").alias(f"{p}_s")).withColumnRenamed("l_orderkey", "o_orderkey")
    j = table(spark, d, "orders").join(side("A", "a"), "o_orderkey", "left").join(side("R", "r"), "o_orderkey", "left")
    return j.select("o_orderkey", F.expr("CASE WHEN a_n > 1 OR r_n > 1 THEN 'ambiguous' WHEN a_n = 1 AND r_n = 1 AND a_s <> r_s THEN 'conflict' WHEN a_n = 1 THEN 'linked_order' WHEN r_n = 1 THEN 'linked_tracking' ELSE 'unmatched' END").alias("decision"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def not_yet_existing_anti(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_returnflag = a.l_returnflag)")
def existing_conflict_anti(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    b = a.groupBy("l_orderkey", "l_returnflag").agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"))
    return a.join(b, ["l_orderkey", "l_returnflag"]).where("low = high").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F'")
def star_lookup(spark, d):
    t = lambda n: table(spark, d, n)
    return t("orders").where("o_orderstatus = 'F'").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def tenant_filter(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderdate IS NOT NULL ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100")
def sorted_page(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 300000) & F.col("o_orderdate").isNotNull())
    return rows.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("""WITH s AS (SELECT l_orderkey, l_suppkey, min(l_shipdate) AS shipped_at, max(l_shipdate) AS last_at, max(CASE l_linestatus WHEN 'F' THEN 4 ELSE 2 END) AS r FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
    u AS (SELECT l_orderkey, l_suppkey, min(l_shipdate) AS shipped_at, max(l_shipdate) AS last_at, max(CASE l_linestatus WHEN 'F' THEN 4 ELSE 2 END) AS r FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2)
    SELECT l_orderkey, l_suppkey, least(coalesce(s.shipped_at, u.shipped_at), coalesce(u.shipped_at, s.shipped_at)) AS shipped_at, greatest(coalesce(s.last_at, u.last_at), coalesce(u.last_at, s.last_at)) AS last_at, CASE greatest(coalesce(s.r, 0), coalesce(u.r, 0)) WHEN 4 THEN 'delivered' ELSE 'in_transit' END AS status FROM s FULL JOIN u USING (l_orderkey, l_suppkey)""")
def shipment_upsert_merge(spark, d):
    items = table(spark, d, "lineitem")

    def side(rows):
        status = F.when(F.bool_or(F.col("l_linestatus") == "F"), "delivered").otherwise("in_transit")
        return rows.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("shipped_at"), F.max("l_shipdate").alias("last_at"), status.alias("status"))

    return merge.merged(side(items.where("l_linenumber <= 3")), side(items.where("l_linenumber >= 3")), ["l_orderkey", "l_suppkey"], {"shipped_at": "least", "last_at": "greatest", "status": "status"})


@query("""WITH a AS (SELECT l_partkey, max(l_discount) AS confidence FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_partkey, max(l_discount) AS confidence FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT l_partkey, greatest(coalesce(a.confidence, r.confidence), coalesce(r.confidence, a.confidence)) AS confidence FROM a FULL JOIN r USING (l_partkey)""")
def document_upsert_merge(spark, d):
    side = lambda f: table(spark, d, "lineitem").where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.max("l_discount").alias("confidence"))
    return merge.merged(side("A"), side("R"), ["l_partkey"], {"confidence": "greatest"})


@query("SELECT p_partkey, upper(regexp_replace(p_brand || '-' || p_name, '[^a-zA-Z0-9]', '', 'g')) AS id FROM part")
def identifier_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", identifier(F.concat_ws("-", "p_brand", "p_name")).alias("id"))


_CALLED = ("DHL Express", "DPD Hungária Kft.", "MPL", "Magyar Posta Logisztika", "GLS (General)", "Foxpost Zrt", "Packeta", "Ampl Bt", "Kő & Bor Inc", "--", "UPS-Standard")
_NAME = f"({listed(_CALLED)})[s_suppkey % {len(_CALLED)} + 1] || CASE WHEN s_suppkey % 3 = 0 THEN ' ' || s_name ELSE '' END"
_LOW = f"lower({_NAME})"


@query(rf"""SELECT s_suppkey, CASE WHEN contains({_LOW}, 'express') THEN 'express-one' WHEN contains({_LOW}, 'dpd') THEN 'dpd' WHEN contains({_LOW}, 'gls') THEN 'gls' WHEN contains({_LOW}, 'foxpost') THEN 'foxpost' WHEN contains({_LOW}, 'packeta') THEN 'packeta' WHEN regexp_matches({_LOW}, '\bmpl\b') OR contains({_LOW}, 'magyar posta logisztika') THEN 'mpl'
    ELSE nullif(regexp_replace(regexp_replace(lower(strip_accents({_NAME})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') END AS slug, regexp_replace(regexp_replace(lower(strip_accents({_NAME})), '\b(kft|zrt|nyrt|bt|ltd|gmbh|inc|llc)\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS party FROM supplier""")
def carrier_slug_compact_party(spark, d):
    name = F.concat(picked(_CALLED, F.col("s_suppkey")), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), "s_name")).otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", carrier_slug(name).alias("slug"), compact_party(name).alias("party"))


@query("""WITH m AS (SELECT l_orderkey, l_suppkey, l_shipdate, l_linenumber FROM lineitem WHERE l_returnflag = 'N'), c AS (SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem WHERE l_returnflag = 'A'),
    p AS (SELECT m.l_orderkey, m.l_linenumber, m.l_suppkey, c.l_partkey FROM m JOIN c ON m.l_orderkey = c.l_orderkey AND c.l_shipdate BETWEEN m.l_shipdate AND m.l_shipdate + INTERVAL 3 DAY)
    SELECT l_orderkey, l_linenumber, l_suppkey, min(l_partkey) AS tracking FROM p GROUP BY 1, 2, 3 HAVING count(DISTINCT l_partkey) = 1""")
def back_bridge(spark, d):
    items = table(spark, d, "lineitem")
    m = items.where("l_returnflag = 'N'").select("l_orderkey", "l_suppkey", "l_shipdate", "l_linenumber")
    c = items.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey", F.col("l_shipdate").alias("at"))
    p = m.join(c, "l_orderkey").where("at between l_shipdate and l_shipdate + interval 3 days")
    return p.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.count_distinct("l_partkey").alias("n"), F.min("l_partkey").alias("tracking")).where("n = 1").drop("n")
