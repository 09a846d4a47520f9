"""Guard rails of extractions: what a carrier may say, what money needs, and what may be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commerce import currency_evident, money_context
from ..functions.text import reasons

# fixed values: fields of a purchase, which carriers don't know
PURCHASE_FIELDS = ("merchant", "order_number", "total", "currency", "payment_status", "paid_amount", "paid_currency")
# fixed values: events that a carrier's message can't be
NOT_OF_CARRIERS = ("order_created", "order_updated", "payment_completed")
TRUSTED = ("validated", "guardrailed")
# fixed values: parsers whose results are only observed
SHADOW_ONLY = r"^generic-(?:order-confirmation|lifecycle)-v[0-9]+(?:\.[0-9]+)*$"


def _money(amount: str, currency: str, waived: Column) -> tuple[Column, Column, Column]:
    """reason, whether the amount goes, and whether the currency goes."""
    a, c = F.col(amount), F.nullif(F.col(currency), F.lit(""))
    bare = (a < 0) | ~F.col("__of_money")
    unsaid = ~F.col(f"__names_{currency}")
    reason = F.when(a.isNull(), None).when(bare, f"{amount}_lacks_monetary_evidence").when(c.isNull(), F.when(~waived, f"{amount}_missing_currency")).when(unsaid, f"{amount}_currency_lacks_evidence")
    return reason, reason.isNotNull(), reason.isNotNull() & c.isNotNull() & (bare | unsaid)


def validated(rows: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """status, event, confidence, eligible, reasons and blocked fields of each extraction.

    ``rows`` has event, confidence, carrier (boolean), context (subject and
    body) and the columns of PURCHASE_FIELDS, cod_amount, cod_currency and
    n_products; all but the first two may be null.  Carriers neither create
    orders nor report payments, and lose the fields of purchases; of others,
    amounts need words of money and their currency in the text.
    """
    carrier, raw, status = F.coalesce("carrier", F.lit(False)), F.col("event"), F.col("payment_status")
    # what a text says is read once, before it is asked of several times, and only where an amount asks it
    texts, sums, has = rows.withColumn("__context", F.lower(F.coalesce("context", F.lit("")))), (("total", "currency"), ("paid_amount", "paid_currency")), lambda a: ~carrier & F.col(a).isNotNull()
    texts = texts.withColumn("__of_money", F.when(has("total") | has("paid_amount"), money_context(F.col("__context"))))
    rows = texts.withColumns({f"__names_{c}": F.when(has(a), currency_evident(F.col("__context"), F.nullif(F.col(c), F.lit("")))) for a, c in sums})
    downgraded = carrier & raw.isin(*NOT_OF_CARRIERS)
    event = F.when(downgraded, "shipment").otherwise(raw)
    confidence = F.when(downgraded, F.least("confidence", F.lit(0.85))).otherwise(F.col("confidence"))
    cleared = [(f, carrier & F.col(f).isNotNull()) for f in PURCHASE_FIELDS] + [("products", carrier & (F.col("n_products") > 0))]
    any_cleared = F.lit(False)
    for _, c in cleared:
        any_cleared = any_cleared | F.coalesce(c, F.lit(False))
    total, no_total, no_currency = _money("total", "currency", F.lit(False))
    paid, no_paid, no_paid_currency = _money("paid_amount", "paid_currency", (raw == "payment_completed") & F.coalesce(status == "paid", F.lit(False)))
    other = ~carrier
    bad_cod = F.coalesce(F.col("cod_amount") < 0, F.lit(False))
    unpaid = (event == "payment_completed") & ~F.coalesce(status == "paid", F.lit(False))
    identified = other & (event == "order_created") & (F.coalesce("merchant", F.lit("")) != "") & (F.coalesce("order_number", F.lit("")) != "")
    eligible = identified & (confidence >= 0.9)
    supported = identified & (confidence >= 0.8) & (confidence < 0.9)
    money = [F.when(other, total), F.when(other, paid)]
    first = F.concat(
        reasons(("carrier_sender_blocks_purchase_creation", carrier), ("carrier_sender_event_downgraded_to_shipment", downgraded), ("carrier_sender_cleared_purchase_fields", any_cleared)),
        F.array_compact(F.array(*money)), reasons(("negative_cod_amount_blocked", bad_cod), ("payment_completed_without_explicit_paid_status", unpaid)),
    )
    told = F.size(first) > 0
    verdict = F.when(unpaid, "review").when(supported, "guardrailed").when(told, "guardrailed").when((event == "order_created") & ~eligible, "review").otherwise("validated")
    last = reasons(("order_created_requires_corroboration", ~unpaid & supported), ("order_created_not_auto_eligible", ~unpaid & ~supported & ~told & (event == "order_created") & ~eligible))
    blocked = reasons(*cleared, ("total", other & no_total), ("currency", other & no_currency), ("paid_amount", other & no_paid), ("paid_currency", other & no_paid_currency), ("cod_amount", bad_cod), ("cod_currency", bad_cod & F.col("cod_currency").isNotNull()))
    return rows.select(*keep, verdict.alias("status"), event.alias("event"), confidence.alias("confidence"), eligible.alias("eligible"), F.array_join(F.concat(first, last), ",").alias("reasons"), F.array_join(blocked, ",").alias("blocked"))


def trusted(status: Column, nested_status: Column, parser: Column) -> Column:
    """Whether evidence counts: the nested status before the column's, and never from a parser under observation."""
    return ~F.coalesce(parser.rlike(SHADOW_ONLY), F.lit(False)) & F.coalesce(F.coalesce(nested_status, status).isin(*TRUSTED), F.lit(False))


def may_write_purchase(decision: Column, confidence: Column, n: Column, n_created: Column, n_support: Column, merchant: Column) -> Column:
    direct = (decision == "create_direct") & (confidence >= 0.9)
    corroborated = (decision == "create_corroborated") & (confidence >= 0.88) & (n >= 3) & (n_support >= 2)
    return F.coalesce(merchant.isNotNull() & (merchant != "") & (n_created >= 1) & (direct | corroborated), F.lit(False))


def may_write_shipment(decision: Column, slug: Column, status: Column, n: Column, n_physical: Column, n_anchors: Column, n_carrier: Column) -> Column:
    return F.coalesce((decision == "linkable") & slug.isNotNull() & (status != "shipment_created") & (n_physical >= 1) & (n >= 3) & (n_anchors >= 1) & (n_carrier >= 2), F.lit(False))


def may_write_document(decision: Column, kind: Column, confidence: Column) -> Column:
    return F.coalesce((decision == "linkable") & (kind == "invoice") & (confidence >= 0.85), F.lit(False))
