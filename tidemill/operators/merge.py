"""Merging new rows into a table: each rule is a column expression over the joined old and new row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank of a shipment's status; a merge never goes back.
STATUS_RANK = {"incoming": 1, "shipment_created": 1, "in_transit": 2, "ready_for_pickup": 3, "delivered": 4}
TERMINAL = ("cancelled", "refunded", "returned")


def rank(status: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    return F.coalesce(ranks[status], F.lit(0))


def further(old: Column, new: Column) -> Column:
    """The status of higher rank; terminal states stay."""
    return F.when(old.isin(*TERMINAL), old).when(rank(new) > rank(old), new).otherwise(F.coalesce(old, new))


RULES = {
    "new": lambda old, new: F.coalesce(new, old),
    "old": lambda old, new: F.coalesce(old, new),
    "greatest": F.greatest,
    "least": F.least,
    "status": further,
}


def merged(target: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """``target`` with ``updates`` applied: keys and the columns of ``rules`` (new, old, greatest, least, status).

    One full outer join on the keys.  ``updates`` has one row for each key;
    fold several with `folded` first, in a fixed order.
    """
    old = target.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in rules])
    new = updates.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rules])
    return old.join(new, keys, "full").select(*keys, *[RULES[r](F.col(f"__old_{c}"), F.col(f"__new_{c}")).alias(c) for c, r in rules.items()])


def folded(updates: DataFrame, keys: list[str], columns: list[str], order: list[str], first: bool = False) -> DataFrame:
    """Of each column the last (or first) non-null value by ``order``."""
    pick = F.min_by if first else F.max_by
    at = F.struct(*order)
    return updates.groupBy(*keys).agg(*[pick(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def inserted_if_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows whose keys ``target`` lacks, the first of each key."""
    fresh = rows.join(target.select(*keys).distinct(), keys, "left_anti")
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


# fixed values: states that nothing follows, and states of a parcel on its way
FINAL, MOVING = ("cancelled", "refunded", "returned", "delivered"), ("in_transit", "shipped")
PROGRESS = ("order_processing", "order_packing", "ready_to_ship")


def lifecycle_state(old: Column, event: Column, has_shipment: Column, payment: Column, newer: Column | None = None) -> Column:
    """The state of a purchase after an event.

    ``newer`` is the status of a shipment whose latest time is after the
    event, null if there is none; it overrules progress and delays.  A failed
    payment never overrides a paid one, and restores it; cancellations change
    nothing that is final or on its way; progress never takes back a failure.
    """
    newer = F.lit(None).cast("string") if newer is None else newer
    final, moving = old.isin(*FINAL), old.isin(*MOVING)
    failed = F.when(payment == "paid", F.when(old == "payment_failed", "paid").otherwise(old)).when(final | moving | (old == "paid"), old).otherwise("payment_failed")
    cancelled = F.when(final | moving | has_shipment, old).otherwise("cancelled")
    recovered = F.when(newer == "delivered", "delivered").when(newer.isNotNull(), "in_transit")
    progress = F.when(final | moving | (old == "payment_failed") | F.coalesce(payment == "failed", F.lit(False)), old).otherwise(F.coalesce(recovered, F.lit("processing")))
    delayed = F.when(final | (old == "payment_failed"), old).otherwise(F.coalesce(recovered, F.lit("delayed")))
    return F.when(event == "payment_failed", failed).when(event == "cancelled", cancelled).when(event.isin(*PROGRESS), progress).when(event == "delayed", delayed).otherwise(old)


def latest_shipment(rows: DataFrame, keys: list[str], times: tuple[str, ...] = ("last_event_at", "delivered_at", "shipped_at"), tie: str = "shipment_id") -> DataFrame:
    """keys, at and status: the latest of all times of a key's shipments, and the status of its row; ties go to the first row."""
    at = F.greatest(*times)
    dated = rows.where(at.isNotNull())
    return dated.groupBy(*keys).agg(F.max(at).alias("at"), F.max_by("status", F.struct(at.alias("at"), (-F.col(tie)).alias("first"))).alias("status"))


#: States of a purchase that `folded_states` starts from.
STATES = ("ordered", "paid", "processing", "payment_failed", "cancelled", "refunded", "returned", "shipped", "in_transit", "delayed", "delivered")


def folded_states(events: DataFrame, keys: list[str], span: Column, order: list[str], first: str = "ordered") -> DataFrame:
    """keys, state and n: the state of each key after all its events, in order.

    ``events`` has event, payment (null, paid or failed) and has_shipment.
    ``span`` cuts a key's events into spans that follow each other in order.
    What a span does to every state is found by itself, so a key with many
    events is folded in as many tasks as it has spans; then the spans are
    applied one after the other.
    """
    step = lambda state, x: lifecycle_state(state, x["event"], F.coalesce(x["has_shipment"], F.lit(False)), x["payment"])
    fold = lambda state: F.aggregate("__events", state.cast("string"), step)
    row = F.struct(*order, "event", "payment", "has_shipment")
    spans = events.withColumn("__span", span).groupBy(*keys, "__span").agg(F.array_sort(F.collect_list(row)).alias("__events"))
    done = spans.select(*keys, "__span", F.size("__events").alias("__n"), F.transform(F.array(*map(F.lit, STATES)), fold).alias("__after"))
    runs = done.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__span", "__after"))).alias("__runs"), F.sum("__n").alias("n"))
    place = lambda state: F.array_position(F.array(*map(F.lit, STATES)), state).cast("int")
    state = F.aggregate("__runs", F.lit(first), lambda s, r: F.element_at(r["__after"], place(s)))
    return runs.select(*keys, state.alias("state"), "n")


def merged_objects(rows: DataFrame, keys: list[str], column: str, order: list[str]) -> DataFrame:
    """keys and ``column``: the JSON objects of a key merged, member by member, the later by ``order`` over the earlier.

    Values are taken whole, of whatever kind; members come in the order of
    their names.  What is no object, and null, has no members; a key of which
    nothing has members has an empty object.
    """
    parsed = rows.select(*keys, F.struct(*order).alias("__at"), F.try_parse_json(column).alias("__object"))
    known = parsed.select(*keys).distinct()
    members = parsed.where(F.schema_of_variant("__object").startswith("OBJECT")).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("__object").outer()))
    # the last of each member is found before the members of a key meet
    last = members.groupBy(*keys, "key").agg(F.max_by(F.to_json("value"), "__at").alias("value"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda m: F.concat(F.to_json(F.parse_json(F.concat(F.lit('"'), F.regexp_replace(m["key"], r'(["\\])', r"\\$1"), F.lit('"')))), F.lit(":"), m["value"]))
    each = last.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias(column))
    return known.join(each, keys, "left").select(*keys, F.coalesce(column, F.lit("{}")).alias(column))
