"""Joins, parsers and streams on small made cases: against all pairs, and with what breaks them."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import bridge, candidates, orders
from tidemill.streaming.inbox import Inbox
from tidemill.streaming.recompute import Recomputed

DAY = candidates.DAY


# all candidates without all pairs
def test_standing_counts_every_row(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(2), rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(80 * DAY) if rng.random() < 0.6 else rng.randrange(80) * DAY) for k in range(300)]
    probes = [(k, rng.randrange(3), rng.choice("abcd") if rng.random() < 0.9 else None, rng.randrange(80) * DAY if k % 2 else rng.randrange(80 * DAY)) for k in range(80)]
    got = candidates.standing(spark.createDataFrame(probes, "probe long, user_id int, sender string, t long"), spark.createDataFrame(rows, "id long, user_id int, sender string, t long"), {0: ["user_id"], 1: ["user_id", "sender"]}, (2, 7, 30))
    got = {(r.probe, r.mask, r.band): (r.n, r["first"]) for r in got.collect()}
    for p, user, sender, t in probes:
        for mask in (0, 1):
            for band, span in enumerate((2 * DAY, 7 * DAY, 30 * DAY, 10**18)):
                own = [i for i, u, s, at in rows if u == user and (mask == 0 or (s is not None and s == sender)) and abs(at - t) <= span]
                assert got.get((p, mask, band)) == ((len(own), min(own)) if own else None)


def test_best_of_all_equals_all_pairs(spark):
    rng = random.Random(5)
    points, time = {0: 0, 1: 35, 2: 25, 3: 60}, (15, 10, 4, 0)
    make = lambda n, start: [(start + k, rng.randrange(3), rng.choice("ab"), rng.choice(["shop one", "shop one kft", "tea"]), rng.randrange(9), rng.randrange(60 * DAY)) for k in range(n)]
    rows, probes = make(150, 1000), make(60, 0)
    named = lambda a, b: a == b or (len(a) >= 5 and len(b) >= 5 and (a in b or b in a))
    band = lambda days: 0 if days <= 2 else 1 if days <= 7 else 2 if days <= 30 else 3
    want, pairs = {}, []
    for p, user, sender, name, k, t in probes:
        scored = []
        for i, u, s, n, j, at in rows:
            if u == user:
                mask, b, rare = (s == sender) + 2 * named(name, n), band(abs(at - t) / DAY), 140 if j == k else 0
                scored.append((-(points[mask] + time[b] + rare), i))
                pairs += [(p, i, points[mask] + time[b] + rare, mask, b, True)] if rare else []
        scored.sort()
        want[p] = (-scored[0][0], scored[0][1], -scored[1][0]) if scored and scored[0][0] else (None, None, 0)
    schema = "user_id int, sender string, name string, k int, t long"
    a, b = spark.createDataFrame(probes, f"probe long, {schema}"), spark.createDataFrame(rows, f"id long, {schema}")
    names = candidates.alike_names(a.select("name"), b.select("name"))
    assert {tuple(r) for r in names.collect()} == {(x, y) for x in {r[3] for r in probes} for y in {r[3] for r in rows} if named(x, y)}
    common = candidates.standing(a.join(names, "name"), b.withColumn("alike", F.col("name")), {0: ["user_id"], 1: ["user_id", "sender"], 2: ["user_id", "alike"], 3: ["user_id", "sender", "alike"]}, (2, 7, 30))
    out = candidates.best_of_all(a.select("probe"), common, spark.createDataFrame(pairs, "probe long, id long, score int, mask int, band int, flags boolean"), points, time)
    got = {r.probe: ((r.best.score, r.best.id, r.runner_up) if r.best else (None, None, 0)) for r in out.collect()}
    assert got == want


def test_amounts_meet(spark):
    rng = random.Random(1)
    values = [0.0, 0.5, 199.5, 200.0, 200.5, 201.0, 1e6, 1e6 + 4_999, 1e6 + 5_001, -300.0, -301.4] + [rng.uniform(0, 10 ** rng.randrange(1, 7)) for _ in range(60)]
    df = spark.createDataFrame([(k, 1, v) for k, v in enumerate(values)], "id int, user_id int, value double")
    got = {(r.a, r.b) for r in candidates.amount_pairs(df.withColumnRenamed("id", "a"), df.toDF("b", "user_id", "b_value"), ["user_id"]).collect()}
    assert {(a, b) for a, x in enumerate(values) for b, y in enumerate(values) if abs(x - y) <= max(1, 0.005 * abs(y))} <= got and len(got) < len(values) ** 2 / 4


# whole orders
def products(spark, function, text, *more):
    row = spark.createDataFrame([(text,)], "body string").select(function(F.col("body"), *more).alias("p")).first()
    return [(p.name, p.variant, p.sku, p.quantity, int(p.total_price), p.url) for p in row.p]


def test_products_over_lines(spark):
    text = "1x early\n5 Ft\nRendelési összesítő:\n2x Fehérje 300 g\n Ízesítés: málna \n\nméret: M\n12 990 Ft\n3x no price\n1 x Kreatin\n4.500 HUF\n0x none\n10 Ft\nlost\n900 Ft\nSzállítás: 990 Ft\n9x late\n1 Ft"
    want = [("Fehérje 300 g", "Ízesítés: málna | méret: M", None, 2, 12990, None), ("Kreatin", None, None, 1, 4500, None)]
    assert products(spark, orders.listed_products, text) == want
    assert products(spark, orders.listed_products, "") == [] and products(spark, orders.listed_products, "Rendelési összesítő\n" + "1x a b\n1 Ft\n" * 70)[49:] == [("a b", None, None, 1, 1, None)]
    run_on = "x Rendelési összesítő: 2x BCAA 300 g Ízesítés: málna 4 990 Ft 1x Omega 3 Ft 500 Ft 1x nothing Szállítás: 990 Ft"
    assert products(spark, orders.run_on_products, run_on) == [("BCAA 300 g", "Ízesítés: málna", None, 2, 4990, None), ("Omega 3 Ft", None, None, 1, 500, None)]


def test_products_in_blocks_and_by_offers(spark):
    text = "Kedvezmeny 10 (AB)\n-5 Ft\n1 db\n-5 Ft\nTea [URL: https://x.hu/t] (T-1)\n1 200 Ft\n\n2 db\n2 400 Ft (br)\nCup (C-2)\n100 Ft x\nPot (P-3)\n10 Ft\nKettle (K-4)\n7 Ft\n1 db\n7 Ft"
    assert products(spark, orders.block_products, text) == [("Tea", None, "T-1", 2, 2400, "https://x.hu/t"), ("Kettle", None, "K-4", 1, 7, None)]
    offers = "a [URL: https://s.hu/ajanlat/kek-bogre-1234567?x=1] 1 990 Ft [b](https://s.hu/ajanlat/kek-bogre-1234567) 5 Ft [URL: https://s.hu/ajanlat/%C3%A1r+1] none [URL: https://s.hu/mas/1] 9 Ft"
    assert products(spark, orders.offer_products, offers, F.lit("HUF")) == [("kek bogre", None, "1234567", 1, 1990, "https://s.hu/ajanlat/kek-bogre-1234567"), ("ár+1", None, None, 1, 9, "https://s.hu/ajanlat/%C3%A1r+1")]


@pytest.mark.parametrize(("change", "accepted"), [(("", ""), True), (("48 245", "48 246"), False), (("nem minősül", "minősül"), False), (("98765432", "98765433"), False), (("DPD\nF", "GLS\nF"), False), (("Fizetési mód:\nKlarna", ""), False), (("-5 280", "5280"), True)])
def test_received_orders_reconcile(spark, change, accepted):
    body = "Köszönjük rendelésed\nEz az e-mail nem minősül a megrendelés visszaigazolásának, csupán a vételi ajánlat megérkezéséről értesítünk.\nMegrendelésed részletei:\nRendelési szám: 98765432\nTermékek összesen:\n52 775 Ft\nFutárszolgálat DPD:\n750 Ft\nEngedmény (27% ÁFA):\n-5 280 Ft\nÖsszesen:\n48 245 Ft\nSzállítási mód\nFutárszolgálat DPD\nFizetési mód:\nKlarna"
    rows = [("jatekbolt.hu", "Megrendelési szám: 98765432", body.replace(*change) if change[0] else body), ("jatekbolt.hu.attacker.example", "Megrendelési szám: 98765432", body), (None, None, None), ("jatekbolt.hu", "", "")]
    got = orders.whole_orders(spark.createDataFrame(rows, "sender string, subject string, body string")).collect()
    assert [(r.order.order_number, int(r.order.total), r.order.payment_status) for r in got] == [("98765432", 48245, "pending")] * accepted


# parcels
def test_parcels_of_verified_senders(spark):
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    purchases = [(1, 1, "Scitec", "scitec.hu", at(10), 5000.0, "HUF", 0.97), (2, 2, "Scitec", "scitec.hu", at(10), 5000.0, "HUF", 0.97), (3, 2, "Scitec", "scitec.hu", at(12), 5000.0, " huf", 0.99), (4, 3, "Scitec", "scitec.hu", at(10), 5000.0, "EUR", 0.99), (5, 4, "Scitec", "scitec.hu", at(10), 5000.0, "HUF", 0.94), (6, 5, "Kek Bogre Kft", "bogre.hu", at(10), 1.0, "HUF", 0.5), (7, 6, "Scitec", "scitec.hu", at(28), 5000.0, "HUF", 0.99)]
    rows = []
    for user in (1, 2, 3, 4, 6):
        rows += [(10 * user, user, "foxpost", "A", at(11), 0.9, "shipment", "shipment_created", "BioTechUSA Kft.", None, None), (10 * user + 1, user, "foxpost", "A", at(12), 0.95, "shipment", "ready_for_pickup", None, 5000.0, "HUF")]
    rows += [(90, 1, "foxpost", "B", at(11), 0.9, "shipment", "in_transit", "BioTechUSA", 5000.0, "HUF"), (91, 5, "gls", "C", at(13), 0.9, "shipment", "in_transit", "Kék Bögre", None, None), (92, 5, "gls", "D", at(30), 0.9, "shipment", "in_transit", "Kék Bögre", None, None)]
    anchors = [(6, at(11), 0.8, None), (6, at(12), 0.85, "gls"), (6, at(12), 0.99, "dpd")]
    out = bridge.by_sender(
        spark.createDataFrame(purchases, "purchase_id long, user_id long, merchant string, domain string, ordered_at timestamp, total double, currency string, purchase_confidence double"), spark.createDataFrame(anchors, "purchase_id long, anchor_at timestamp, anchor double, anchor_slug string"),
        spark.createDataFrame(rows, "source_id long, user_id long, slug string, tracking string, carrier_at timestamp, confidence double, event string, phase string, sender string, cod double, cod_currency string"),
    )
    got = {(r.user_id, r.tracking): (r.decision, r.purchase_id, r.confidence, r.status, r.lane) for r in out.collect()}
    no = ("unmatched", None)
    assert got[1, "A"] == ("linkable", 1, 0.95, "ready_for_pickup", 2) and got[2, "A"][:2] == ("review", None) and got[2, "A"][4] == 2
    # another currency, a doubtful purchase, one source only, too late
    assert got[3, "A"][:2] == no and got[4, "A"][:2] == no and got[1, "B"][:2] == no and got[6, "A"][:2] == no
    assert got[5, "C"] == ("linkable", 6, 0.85, "in_transit", 1) and got[5, "D"][:2] == no


# streams
def test_recompute_follows_a_stream(spark, tmp_path):
    rng = random.Random(9)
    start = dt.datetime(2024, 3, 1)
    rows = [(k, rng.randrange(7), start + dt.timedelta(hours=rng.randrange(24 * 120))) for k in range(400)]
    source = tmp_path / "in"
    for part in (rows[200:], rows[:250], rows[100:300]):  # out of order, and rows that come twice
        spark.createDataFrame(part, "source_id long, user_id long, received_at timestamp").coalesce(1).write.mode("append").parquet(str(source))
    compute = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("received_at").alias("last_at"))
    done = Recomputed(spark, str(tmp_path / "t"), compute, buckets=3)
    done.follow(spark.readStream.schema("source_id long, user_id long, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(source)), str(tmp_path / "c"))
    newest = {u: max(t for _, v, t in rows if v == u) for u in range(7)}
    want = {u: (sum(v == u and t > newest[u] - dt.timedelta(days=45) for _, v, t in rows), newest[u]) for u in range(7)}
    read = lambda: {r.user_id: (r.n, r.last_at) for r in done.results().collect()}
    assert read() == want
    done.batch(spark.read.parquet(str(source)), 2)  # the last batch once more
    assert read() == want
    done.batch(spark.createDataFrame([], "source_id long, user_id long, received_at timestamp"), 3)
    assert read() == want


def test_inbox_is_drained_in_order(spark, tmp_path):
    start, minute = dt.datetime(2024, 3, 1), dt.timedelta(minutes=1)
    worked = []

    def work(claimed):
        worked.append([(r.id, r.attempts) for r in claimed.orderBy("next_attempt_at", "id").collect()])
        return claimed.withColumn("ok", F.col("id") % 3 > 0)

    inbox = Inbox(spark, str(tmp_path), work, limit=4, most_attempts=2)
    arrived = lambda ids, at: spark.createDataFrame([(i, at) for i in ids], "id long, next_attempt_at timestamp")
    inbox.batch(arrived([5, 3, 4, 1, 2, 9], start), 0, F.lit(start))
    inbox.batch(arrived([1, 2, 7, 7], start - minute), 1, F.lit(start + 30 * dt.timedelta(seconds=1)))
    inbox.batch(arrived([], start), 2, F.lit(start + 2 * minute))
    assert worked == [[(1, 1), (2, 1), (3, 1), (4, 1)], [(7, 1), (5, 1), (9, 1)], [(3, 2), (9, 2)]]
    ended = {r.id: (r.status, r.attempts, r.batch) for r in inbox.finished().collect()}
    assert ended == {1: ("processed", 1, 0), 2: ("processed", 1, 0), 4: ("processed", 1, 0), 7: ("processed", 1, 1), 5: ("processed", 1, 1), 3: ("dead", 2, 2), 9: ("dead", 2, 2)}
    inbox.batch(arrived([], start), 2, F.lit(start + 2 * minute))  # the batch once more gives the same
    assert worked[3] == worked[2] and {r.id: (r.status, r.attempts, r.batch) for r in inbox.finished().collect()} == ended and inbox.active(2).count() == 0


# merges
def test_objects_merge_member_by_member(spark):
    from tidemill.operators.merge import merged_objects

    rows = [(1, 1, '{"a":1,"b":{"c":[1,null]}}'), (1, 3, '{"a":null,"d \\"x\\" \\\\":"é"}'), (1, 2, '{"a":2,"b":"t"}'), (2, 1, "[1]"), (2, 2, "broken"), (3, 1, None), (4, 1, '{"z":true}')]
    out = merged_objects(spark.createDataFrame(rows, "k int, at int, m string"), ["k"], "m", ["at"])
    got = {r.k: r.m for r in out.collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {1: {"a": None, "b": "t", 'd "x" \\': "é"}, 2: {}, 3: {}, 4: {"z": True}}


def test_table_is_merged_by_batches(spark, tmp_path):
    from tidemill.operators.store import MergeTable

    table = MergeTable(spark, str(tmp_path), "k long, name string, c double, first string", ["k"], {"name": "new", "c": "greatest", "first": "old"}, ["at"], buckets=3)
    schema = "k long, name string, c double, first string, at int, source_id long, problem string"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    rows = lambda: {r.k: (r.name, r.c, r["first"]) for r in table.rows().collect()}
    one = batch((1, "a", 0.5, None, 1, 10, None), (1, None, 0.2, "x", 2, 10, None), (2, "b", 0.1, "y", 1, 11, None), (3, "no", 9.0, "n", 1, 11, "price"))
    table.apply(one, 0)
    assert rows() == {1: ("a", 0.5, "x"), 2: ("b", 0.1, "y")}
    two = batch((2, "c", None, "z", 3, 12, None), (4, "d", 1.0, None, 1, 12, None), (2, None, 0.7, None, 4, 13, None))
    for _ in range(2):  # a batch that is repeated changes nothing more
        table.apply(two, 1)
        assert rows() == {1: ("a", 0.5, "x"), 2: ("c", 0.7, "y"), 4: ("d", 1.0, None)}
        told = sorted((r.batch, r.source_id, r.outcome, r.n) for r in table.outcomes().collect())
        assert told == [(0, 10, "inserted", 2), (0, 11, "inserted", 1), (0, 11, "rejected: price", 1), (1, 12, "inserted", 1), (1, 12, "updated", 1), (1, 13, "updated", 1)]
    table.apply(batch().limit(0), 2)
    assert len(rows()) == 3
