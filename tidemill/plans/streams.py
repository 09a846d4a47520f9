"""Results of streams that are worked off batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from ..operators.store import MergeTable
from ..sources.tables import EVIDENCE_SQL, evidence, table
from ..streaming.inbox import Inbox
from ..streaming.recompute import WINDOW_DAYS, Recomputed
from .registry import query
from .resolution import _stream_folder
from .writes import code

#: Batches that the event table comes in, and the windows that a user's newest row ends.
BATCHES, WINDOWS = 4, (7, 30)
#: Rows that a batch works off at most, and the time of each batch.
LIMIT, START, MINUTES = 300, "2024-02-01 00:00:00", 3


def by_user(rows):
    """Counts of a user's rows and of those of the last days."""
    newest = F.max("received_at")
    newest_of = rows.groupBy("user_id").agg(newest.alias("last_at"))
    since = lambda n: F.count_if(F.col("received_at") > F.col("last_at") - F.expr(f"INTERVAL {n} DAYS"))
    return rows.join(newest_of, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("last_at").alias("last_at"), *[since(n).alias(f"n_{n}") for n in WINDOWS], F.round(F.max("confidence"), 4).alias("best"))


@query(f"""WITH {EVIDENCE_SQL}, m AS (SELECT *, max(received_at) OVER (PARTITION BY user_id) AS last_at FROM ev)
    SELECT user_id, count(*) AS n, max(last_at) AS last_at, {", ".join(f"count(*) FILTER (WHERE received_at > last_at - INTERVAL {n} DAY) AS n_{n}" for n in WINDOWS)}, round(max(confidence), 4) AS best FROM m WHERE received_at > last_at - INTERVAL {WINDOW_DAYS} DAY GROUP BY 1""")
def streamed_recompute(spark, d):
    """Users' results after the events came in by batches, newer ones before older ones, and one batch twice."""
    e, folder = evidence(spark, d), _stream_folder(spark)
    done = Recomputed(spark, folder, by_user, buckets=4)
    part = lambda k: e.where(F.pmod(F.xxhash64("source_id"), F.lit(BATCHES)) == k)
    for number, k in enumerate([*reversed(range(BATCHES)), 0]):
        done.batch(part(k), number)
    return done.results()


def _ticks() -> str:
    """The inbox after each batch, in DuckDB."""
    now = lambda k: f"TIMESTAMP '{START}' + INTERVAL {k * MINUTES} MINUTE"
    out = ["i AS (SELECT event_id AS id, event_id % 4 AS batch, TIMESTAMP '" + START + "' - to_minutes(CAST(event_id % 97 AS BIGINT)) AS next_at FROM events)", "s0 AS (SELECT id, 'pending' AS status, 0 AS attempts, next_at FROM i WHERE false)"]
    for k in range(BATCHES):
        out.append(f"w{k} AS MATERIALIZED (SELECT * FROM s{k} UNION ALL SELECT id, 'pending', 0, next_at FROM i WHERE batch = {k})")
        out.append(f"c{k} AS MATERIALIZED (SELECT id, attempts + 1 AS attempts, next_at FROM w{k} WHERE status IN ('pending', 'retry') AND next_at <= {now(k)} ORDER BY next_at, id LIMIT {LIMIT})")
        out.append(f"""s{k + 1} AS MATERIALIZED (SELECT w.id, CASE WHEN c.id IS NULL THEN w.status WHEN (c.id + c.attempts) % 3 > 0 THEN 'processed' WHEN c.attempts >= 3 THEN 'dead' ELSE 'retry' END AS status, coalesce(c.attempts, w.attempts) AS attempts,
            CASE WHEN c.id IS NULL OR (c.id + c.attempts) % 3 > 0 OR c.attempts >= 3 THEN w.next_at ELSE {now(k)} + to_minutes(CAST(least(greatest(c.attempts, 1), 10) AS BIGINT)) END AS next_at FROM w{k} w LEFT JOIN c{k} c ON c.id = w.id)""")
    return "WITH " + ", ".join(out)


@query(_ticks() + f" SELECT id, status, attempts, next_at AS next_attempt_at FROM s{BATCHES}")
def bounded_drain(spark, d):
    """The events as an inbox of which a batch works off a bounded number, in order; a third fails, waits and is tried again, and after three times is dead."""
    e, folder = table(spark, d, "events"), _stream_folder(spark)
    start = F.lit(START).cast("timestamp")
    rows = e.select(F.col("event_id").alias("id"), (start - F.make_dt_interval(mins=(F.col("event_id") % 97).cast("int"))).alias("next_attempt_at"))
    inbox = Inbox(spark, folder, lambda claimed: claimed.withColumn("ok", (F.col("id") + F.col("attempts")) % 3 > 0), LIMIT, most_attempts=3)
    for k in range(BATCHES):
        inbox.batch(rows.where(F.col("id") % BATCHES == k), k, start + F.make_dt_interval(mins=F.lit(k * MINUTES)))
    out = inbox.active(BATCHES - 1).unionByName(inbox.finished().drop("batch"))
    return out.select("id", "status", F.col("attempts"), F.col("next_attempt_at").cast("timestamp_ntz").alias("next_attempt_at"))


# fixed values: the most products of a source, letters of a name, and pieces of a product
MOST_PRODUCTS, MOST_LETTERS, MOST_PIECES = 50, 500, 1000
_PRODUCTS = """, w AS (SELECT l_orderkey AS purchase_id, l_orderkey * 100 + l_suppkey % 100 AS source_id, l_linenumber AS n, p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE ' ' || p_name || '  x' END AS name, CASE WHEN p_partkey % 3 = 0 THEN ' SKU-' || p_partkey || ' ' END AS sku, CASE WHEN l_linenumber % 2 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE l_quantity END AS quantity,
        CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE l_extendedprice END AS total, (['eur', 'EURO', NULL])[p_partkey % 3 + 1] AS currency, l_discount * 10 AS confidence, l_suppkey % 7 > 0 AS trusted, l_extendedprice AS tie FROM lineitem JOIN part ON p_partkey = l_partkey),
    g AS (SELECT *, CASE WHEN NOT trusted THEN 'source' WHEN trim(name) = '' THEN 'name' WHEN quantity <= 0 OR quantity > 1000 THEN 'quantity' WHEN total < 0 THEN 'price' WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END AS problem, CASE WHEN sku IS NOT NULL THEN 'sku:' || lower(trim(sku)) ELSE 'name:' || lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) || '|variant:' END AS source_key FROM w),
    f AS (SELECT * FROM g WHERE problem IS NULL)"""


@query(f"""WITH o AS (SELECT 1){_PRODUCTS} SELECT purchase_id, source_key, arg_max(trim(name), (n, tie, p_partkey)) AS name, arg_max(brand, (n, tie, p_partkey)) FILTER (WHERE brand IS NOT NULL) AS brand, arg_max(quantity, (n, tie, p_partkey)) AS quantity, arg_max(total, (n, tie, p_partkey)) AS total,
    arg_max(CASE WHEN regexp_matches(upper(currency), '^[A-Z]{{3}}$') THEN upper(currency) END, (n, tie, p_partkey)) FILTER (WHERE regexp_matches(upper(currency), '^[A-Z]{{3}}$')) AS currency, arg_max(source_id, (n, tie, p_partkey)) AS source_id, max(confidence) AS confidence FROM f GROUP BY 1, 2""")
def product_upsert(spark, d):
    """Products of purchases, written by two batches, the second one twice: the latest of what is known, the greatest confidence."""
    return _product_table(spark, d).rows()


@query(f"""WITH o AS (SELECT 1){_PRODUCTS}, k AS (SELECT *, CASE WHEN n <= 3 THEN 0 ELSE 1 END AS batch FROM g), e AS (SELECT DISTINCT purchase_id, source_key FROM k WHERE problem IS NULL AND batch = 0)
    SELECT source_id, batch, CASE WHEN problem IS NOT NULL THEN 'rejected: ' || problem WHEN batch = 1 AND e.source_key IS NOT NULL THEN 'updated' ELSE 'inserted' END AS outcome, count(*) AS n FROM k LEFT JOIN e USING (purchase_id, source_key) GROUP BY 1, 2, 3""")
def product_outcomes(spark, d):
    """What became of the products of each source: inserted, updated, or rejected and why."""
    return _product_table(spark, d).outcomes()


def _product_table(spark, d) -> MergeTable:
    m = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, part = F.col("l_linenumber"), F.col("p_partkey")
    rows = m.select(
        F.col("l_orderkey").alias("purchase_id"), (F.col("l_orderkey") * 100 + F.col("l_suppkey") % 100).alias("source_id"), n.alias("n"), F.col("l_extendedprice").alias("tie"), part.alias("part"), F.when(part % 17 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit("  x"))).alias("name"), F.when(part % 3 == 0, F.concat(F.lit(" SKU-"), part, F.lit(" "))).alias("sku"),
        F.when(n % 2 == 0, F.col("p_brand")).alias("brand"), F.when(part % 13 == 0, 0.0).otherwise(F.col("l_quantity")).alias("quantity"), F.when(part % 11 == 0, -1.0).otherwise(F.col("l_extendedprice")).alias("total"), F.when(part % 3 == 0, "eur").when(part % 3 == 1, "EURO").alias("currency"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_suppkey") % 7 > 0).alias("trusted"),
    )
    folder = _stream_folder(spark)
    # every batch reads its updates several times, so they are made once
    products_of(rows).withColumn("source", F.col("source_id")).write.parquet(f"{folder}/updates")
    u = spark.read.parquet(f"{folder}/updates")
    kind = "purchase_id long, source_key string, name string, brand string, quantity double, total double, currency string, source_id long, confidence double"
    done = MergeTable(spark, folder, kind, ["purchase_id", "source_key"], {"name": "new", "brand": "new", "quantity": "new", "total": "new", "currency": "new", "source_id": "new", "confidence": "greatest"}, ["n", "tie", "part"], buckets=4)
    for batch, part_of in ((0, "n <= 3"), (1, "n > 3"), (1, "n > 3")):
        done.apply(u.where(part_of), batch)
    return done


def products_of(rows):
    """Products with the key that they are known by in a purchase, and what speaks against them: an untrusted source, a name, a quantity, a price or a confidence that can't be."""
    name, sku = F.trim("name"), F.nullif(F.trim("sku"), F.lit(""))
    problem = (
        F.when(~F.col("trusted"), "source").when((name == "") | (F.length(name) > MOST_LETTERS), "name").when((F.col("quantity") <= 0) | (F.col("quantity") > MOST_PIECES), "quantity").when(F.col("total") < 0, "price").when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence")
    )
    key = F.when(sku.isNotNull(), F.concat(F.lit("sku:"), F.lower(sku))).otherwise(F.concat(F.lit("name:"), F.lower(F.regexp_replace(name, r"\s+", " ")), F.lit("|variant:")))
    return rows.select("*", problem.alias("problem"), key.alias("source_key")).withColumns({"name": name, "currency": code(F.col("currency"))})


@query(f"""WITH {EVIDENCE_SQL}, m AS (SELECT user_id, k, received_at, source_id, unnest(CASE source_id % 4 WHEN 0 THEN ['controlled', 'evidence'] WHEN 1 THEN ['confidence', 'evidence'] WHEN 2 THEN ['nested', 'note "x"'] ELSE [] END) AS key, unnest(CASE source_id % 4 WHEN 0 THEN ['true', CAST(source_id AS VARCHAR)] WHEN 1 THEN ['0.5', CAST(source_id AS VARCHAR)] WHEN 2 THEN ['{{"a":[1,' || source_id || ',null]}}', '"é"'] ELSE [] END) AS value FROM ev),
    l AS (SELECT user_id, k, key, arg_max(value, (received_at, source_id)) AS value FROM m GROUP BY 1, 2, 3), j AS (SELECT user_id, k, '{{' || string_agg(to_json(key) || ':' || value, ',' ORDER BY key) || '}}' AS metadata FROM l GROUP BY 1, 2)
    SELECT e.user_id, e.k, coalesce(metadata, '{{}}') AS metadata FROM (SELECT DISTINCT user_id, k FROM ev) e LEFT JOIN j ON j.user_id = e.user_id AND j.k = e.k""")
def metadata_merge(spark, d):
    """What several messages add to a parcel's metadata, member by member, the later over the earlier."""
    e, i = evidence(spark, d), F.col("source_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    added = F.when(i % 4 == 0, text('{"controlled":true,"evidence":', i, "}")).when(i % 4 == 1, text('{"confidence":0.5,"evidence":', i, "}")).when(i % 4 == 2, text('{"nested":{"a":[1,', i, ',null]},"note \\"x\\"":"é"}')).otherwise("[1]")
    return merge.merged_objects(e.select("user_id", "k", "received_at", "source_id", added.alias("metadata")), ["user_id", "k"], "metadata", ["received_at", "source_id"])
