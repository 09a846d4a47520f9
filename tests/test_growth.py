"""What keeps queries in proportion to their tables: texts read once, only where they are asked for, and no task with a fixed share."""

from pyspark.sql import functions as F

from tidemill.functions import commerce as C
from tidemill.functions import text as T
from tidemill.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shadow_orders_are_read_once(spark):
    """a filter on the order used to move below its projection, with all patterns in it a second time."""
    assert plan(QUERIES["generic_shadow"](spark, SF)).count("resumen del pedido") == 1


def test_signs_are_read_of_confirmations_only(spark):
    """a text without a confirmation is asked for no other sign, which the plan says by what stands first."""
    order = str(C.generic_order(F.col("s"), F.col("t"), F.col("b")))
    assert order.index("thank(?:s| you)?") < order.index("fizetesi mod") and order.count("thank(?:s| you)?") == 1


def test_patterns_in_one_pass(spark):
    """one pattern for all, with the same answer."""
    texts = ["Thank you for your order", "thanks for your order!", "xthanks for your order", "merci pour votre commande", "webcas.expressone.hu/request_curier", "from now on", "On Monday Ann wrote:", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (C.CONFIRMATIONS, C.DISCLAIMERS, C.PICKUP_URLS, T.HISTORY, C.CAMPAIGN, C.OF_PARCELS):
        each = F.lit(False)
        for p in patterns:
            each = each | F.col("t").rlike(p)
        together = C.any_of(F.col("t"), patterns)
        assert str(together).lower().count("rlike(") == 1
        assert [r.a == r.b for r in df.select(F.coalesce(each, F.lit(False)).alias("a"), F.coalesce(together, F.lit(False)).alias("b")).collect()] == [True] * len(texts)


def test_ascii_is_not_translated(spark):
    """only texts with other letters are translated, the same way."""
    got = spark.createDataFrame([("Plain TEXT",), ("Árvíztűrő TÜKÖR",), ("é",), ("",), (None,)], "t string").select(T.fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == ["plain text", "arvizturo tukor", "e", "", None] and "octet_length" in str(T.fold(F.col("t"))).lower()


def test_needed_words_stand_in_what_matches(spark):
    """an identity is looked for only where a word that it needs stands."""
    said = {
        "order no. ab12": "ab12", "order # ab12": "ab12", "rendeles: ab12": None, "megrendelesszam: ab12": "ab12", "bestellnr. ab12": "ab12", "auftragsnummer ab12": "ab12", "commande n° ab12": "ab12", "pedido n° ab12": "ab12", "#ab12 szamu rendeleshez": "ab12", "a ab12 szamu megrendelesed": "ab12", "ab1234 - rendelesed": "ab1234", "nothing ab12": None,
    }
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", C.identity(F.col("t"), C.LATER_ORDER_IDS).alias("o")).collect()
    assert {r.t: r.o for r in got} == said
    assert all(C.NEEDED[p] for p in (*C.ORDER_IDS, *C.LATER_ORDER_IDS, *C.TRACKING_IDS, *C.INVOICE_IDS))


def test_quoted_history_as_before(spark):
    """texts without a quotation take a shorter way to the same."""
    said = {"a\r\nb\n\n\n\nc\n": "a\nb\n\nc", "a\n> b\nc": "a\nc", "a\n-- original message --\nb": "a", "a\nfrom: x\nto: y\nsubject: z\nb": "a", "a\nfrom: x\nb": "a\nfrom: x\nb", "a > b": "a > b", "a\nOn x WROTE:\nb": "a", "": ""}
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", T.without_history(F.col("t")).alias("f")).collect()
    assert {r.t: r.f.strip("\n") for r in got} == said


def test_context_is_read_once(spark):
    """words of money were looked for again for each reason and field that they bear on."""
    assert plan(QUERIES["validator_status"](spark, SF)).count("cash on delivery") <= 2


def test_one_shop_writes_its_text(spark):
    """the other shops' texts of an order were written as well and thrown away."""
    from tidemill.sources.receipts import receipts

    assert "element_at(array(" not in plan(receipts(spark, SF))


def test_a_bucket_is_written_by_many_tasks(spark, tmp_path):
    """a bucket used to be one task's, whatever its size."""
    from tidemill.operators.store import MergeTable

    table = MergeTable(spark, str(tmp_path), "k long, name string", ["k"], {"name": "new"}, ["at"], buckets=1)
    updates = spark.range(2000).selectExpr("id as k", "concat('n', id) as name", "1 as at", "id as source_id", "cast(null as string) as problem")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch in (0, 1):
            table.apply(updates, batch)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.rows().count() == 2000 and len(list((tmp_path / "rows" / "bucket=0").glob("*.parquet"))) > 1


def test_updates_of_products_are_made_once(spark):
    """each batch made its updates anew from items and parts, three times."""
    import tidemill.plans.streams as streams

    made = []
    real, streams.MergeTable = streams.MergeTable, type("Seen", (streams.MergeTable,), {"apply": lambda self, updates, batch: made.append(updates._jdf.queryExecution().optimizedPlan().toString())})
    try:
        streams._product_table(spark, SF)
    finally:
        streams.MergeTable = real
    assert len(made) == 3 and not any("Join" in p for p in made)


def test_accents_and_returns_go_in_one_pass(spark):
    """three translations of each text were made for one."""
    from tidemill.operators.orders import unaccented

    text = unaccented(F.col("t"))
    got = spark.createDataFrame([("Ő\r\nû é €\r",), ("",), (None,)], "t string").select(text.alias("f")).collect()
    assert [r.f for r in got] == ["O\nu e €", "", None] and str(text).count("translate(") == 1


def test_scored_joins_read_events_once(spark):
    """F7, F8: the events' texts were parsed and grouped again for each of a dozen joins."""
    assert "json" not in plan(QUERIES["top2_margin_match"](spark, SF)).lower() and "json" not in plan(QUERIES["payment_scored_match"](spark, SF)).lower()
