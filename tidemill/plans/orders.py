"""Orders read whole from the messages of single shops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.commerce import sender_domain
from ..operators.orders import whole_orders
from ..sources import receipts as S
from .registry import query

_WITHOUT_FIRST = f"CASE WHEN form = {S.BROKEN_PRODUCT} THEN list[2:] ELSE list END"


@query(f"""WITH i AS (SELECT l_orderkey AS id, CAST(l_quantity AS INT) AS q, CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS unit, p_name || ' no ' || l_linenumber AS name, lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS sku, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey),
    o AS (SELECT id, (id // 4) % 8 AS form, id % 4 AS shop, lpad(CAST(id AS VARCHAR), 8, '0') AS number, md5(CAST(id AS VARCHAR)) AS h, sum(unit * q)::BIGINT AS s, list({{'name': name, 'sku': sku, 'q': q, 'unit': unit}} ORDER BY l_linenumber, l_partkey, unit, q) AS list FROM i GROUP BY id),
    k AS (SELECT *, {_WITHOUT_FIRST} AS kept, CASE shop WHEN 0 THEN form NOT IN ({S.STRANGER}, {S.OTHER_NUMBER}) WHEN 1 THEN form NOT IN ({S.STRANGER}, {S.OTHER_NUMBER}, {S.WRONG_SUM}, {S.BROKEN_PRODUCT}) WHEN 2 THEN form NOT IN ({S.STRANGER}, {S.OTHER_NUMBER}) AND len({_WITHOUT_FIRST}) > 0 ELSE form NOT IN ({S.STRANGER}, {S.OTHER_NUMBER}, {S.WRONG_SUM}, {S.SPECIAL}) END AS ok, form = {S.ON_DELIVERY} AS cod FROM o),
    -- each product that the shop's messages tell of; the marketplace counts an address once
    p AS (SELECT *, CASE shop WHEN 0 THEN list_transform(kept, lambda x: x.name || '|' || '' || '|SKU-' || x.sku || '|' || x.q || '|' || x.unit || '|' || x.unit * x.q || '|' || CASE WHEN form = {S.SPECIAL} THEN 'https://limone.hu/p/' || x.sku ELSE '' END)
        WHEN 1 THEN list_transform(kept, lambda x: x.name || '|Ízesítés: csokoládé||' || x.q || '|' || x.unit || '|' || x.unit * x.q || '|')
        WHEN 2 THEN list_transform(list_filter(kept, lambda x, i: NOT list_contains(list_transform(kept[1:i - 1], lambda y: y.name || y.sku), x.name || x.sku)), lambda x: x.name || '||' || x.sku || '|1|' || x.unit * x.q || '|' || x.unit * x.q || '|https://allegro.hu/ajanlat/' || replace(x.name, ' ', '-') || '-' || x.sku) ELSE [] END AS products FROM k),
    t AS (SELECT *, CASE shop WHEN 1 THEN s + {S.SHIPPING} + CASE WHEN cod THEN {S.FEE} ELSE 0 END WHEN 2 THEN s + {S.SHIPPING} ELSE s + {S.SHIPPING} - {S.DISCOUNT} + CASE WHEN form = {S.WRONG_SUM} THEN 1 ELSE 0 END END AS total FROM p WHERE ok)
    SELECT id, ['limone', 'gymbeam', 'allegro', 'jatekbolt'][shop + 1] AS parser, CASE shop WHEN 1 THEN 'order_updated' ELSE 'order_created' END AS event, CASE shop WHEN 0 THEN 'Limone.hu' WHEN 1 THEN 'GymBeam' WHEN 2 THEN 'Bolt ' || number ELSE 'JatekBolt.hu' END AS merchant,
        CASE shop WHEN 0 THEN '2024-' || number WHEN 2 THEN h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] ELSE number END AS order_number, CASE WHEN shop <> 2 THEN s END::DOUBLE AS subtotal, {S.SHIPPING}::DOUBLE AS shipping, CASE WHEN shop IN (0, 3) THEN {S.DISCOUNT} END::DOUBLE AS discount, total::DOUBLE AS total,
        CASE WHEN cod THEN 'cash_on_delivery' WHEN shop IN (1, 2) OR (shop = 3 AND form = {S.PAID_BY_CARD}) THEN 'pending' ELSE 'unknown' END AS payment_status, CASE shop WHEN 0 THEN CASE WHEN cod THEN 'Utanvet' ELSE 'Bankkartya' END WHEN 1 THEN CASE WHEN cod THEN 'Utánvét' ELSE 'Bankkártya' END WHEN 2 THEN CASE WHEN cod THEN 'utánvét' ELSE 'bankkártya' END ELSE CASE WHEN cod THEN 'utanvet' WHEN form = {S.PAID_BY_CARD} THEN 'klarna' ELSE 'bankkartya' END END AS payment_method,
        CASE shop WHEN 0 THEN 'Express One futarszolgalat' WHEN 1 THEN 'Express One' WHEN 2 THEN 'Futár' || CASE WHEN cod THEN ' utánvét' ELSE '' END || ', DPD' ELSE 'futarszolgalat dpd' END AS shipping_method, CASE WHEN cod AND shop < 3 THEN total END::DOUBLE AS cod_amount, len(products) AS n_products, array_to_string(products, ';') AS products, CASE shop WHEN 1 THEN 0.99 ELSE 0.995 END::DOUBLE AS confidence FROM t""")
def whole_orders_read(spark, d):
    """Orders with their products and sums, of the messages that a shop's parser accepts."""
    m = S.receipts(spark, d).withColumn("sender", sender_domain(F.col("address")))
    o = whole_orders(m).select("id", "order.*")
    said = F.transform("products", lambda p: F.concat_ws("|", p["name"], F.coalesce(p["variant"], F.lit("")), F.coalesce(p["sku"], F.lit("")), p["quantity"], p["unit_price"].cast("long"), p["total_price"].cast("long"), F.coalesce(p["url"], F.lit(""))))
    money = lambda c: F.col(c).cast("double").alias(c)
    return o.select("id", "parser", "event", "merchant", "order_number", money("subtotal"), money("shipping"), money("discount"), money("total"), "payment_status", "payment_method", "shipping_method", money("cod_amount"), F.size("products").cast("long").alias("n_products"), F.array_join(said, ";").alias("products"), "confidence")
