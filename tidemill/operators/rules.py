"""Rules as data: profiles with sender gates, patterns and provenance, evaluated on all messages at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp4
from ..functions.text import in_domain

# fixed values: kinds of sources that can carry a decision, and the confidence that one needs
CARRYING, LEAST_CONFIDENCE = ("observed_real_email", "official_documentation", "verified_template"), 0.85
# fixed values: how much each source counts for each kind of fact
AUTHORITY = {
    "commerce_identity": {"generic_email": 20, "commerce_protocol": 45, "merchant": 70, "invoice_pdf": 80},
    "logistics_state": {"generic_email": 15, "commerce_protocol": 35, "merchant": 55, "carrier_direct": 90},
    "payment_state": {"generic_email": 15, "commerce_protocol": 35, "merchant": 55, "payment_provider_direct": 90},
    "invoice_state": {"generic_email": 15, "commerce_protocol": 35, "merchant": 50, "invoice_provider_direct": 90, "invoice_pdf": 95},
}


@dataclass(frozen=True)
class Rule:
    """A pattern on a field of a message; required unless said otherwise."""

    name: str
    field: str
    pattern: str
    delta: float = 0.0
    required: bool = True
    sources: tuple[str, ...] = ()


@dataclass(frozen=True)
class Event:
    name: str
    base: float
    rules: tuple[Rule, ...]
    negative: tuple[Rule, ...] = ()
    prohibitions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    """Rules of one sender or protocol.  Without domains and addresses every sender passes the gate."""

    name: str
    status: str
    events: tuple[Event, ...]
    domains: tuple[str, ...] = ()
    addresses: tuple[str, ...] = ()
    negative: tuple[Rule, ...] = ()
    provenance: dict[str, str] = field(default_factory=dict, hash=False)
    order_ids: tuple[str, ...] = ()


def gate(profile: Profile, sender: Column, address: Column) -> Column:
    """A trusted domain or one below it, and a trusted address, where the profile names any."""
    ok = F.lit(True)
    if profile.domains:
        ok = ok & reduce(Column.__or__, [in_domain(sender, d) for d in profile.domains])
    if profile.addresses:
        ok = ok & F.lower(F.trim(address)).isin(*[a.lower() for a in profile.addresses])
    return F.coalesce(ok, F.lit(False))


def _hit(rule: Rule, lists: tuple[str, ...]) -> Column:
    pattern = f"(?i){rule.pattern}"
    found = F.exists(rule.field, lambda x: x.rlike(pattern)) if rule.field in lists else F.col(rule.field).rlike(pattern)
    return F.coalesce(found, F.lit(False))


def evaluate(messages: DataFrame, profiles: list[Profile], sender: str = "sender", address: str = "address", lists: tuple[str, ...] = ("attachments", "dkim", "return_path", "transport"), keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """profile, event, confidence, blocked, eligible, provenance, order_id, rules and negatives of each event found in each message.

    An event is found if the sender passes the gate, all required rules match
    and one positive rule does; a negative rule blocks it.  Confidence is the
    base and the deltas of the matching rules.  What is found may enter a
    decision if its profile is in production, it isn't blocked, its confidence
    suffices and a source of its rules carries.  Profiles are few and stand as
    literals in one expression, the cheap gate first: a scan without shuffle
    or join.
    """
    outcomes = []
    for p in profiles:
        text = F.concat_ws("\n", *[F.col(c) for c in ("subject", "body", "html") if c in messages.columns], F.array_join("attachments", "\n"))
        order = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, f"(?i){x}", 1)), F.lit("")) for x in p.order_ids]) if p.order_ids else F.lit(None).cast("string")
        for e in p.events:
            hit = {r: _hit(r, lists) for r in (*e.rules, *p.negative, *e.negative)}
            negative = (*p.negative, *e.negative)
            ok = reduce(Column.__and__, [hit[r] for r in e.rules if r.required], gate(p, F.col(sender), F.col(address)))
            ok = ok & reduce(Column.__or__, [hit[r] for r in e.rules])
            blocked = reduce(Column.__or__, [hit[r] for r in negative], F.lit(False))
            confidence = clamp4(reduce(Column.__add__, [F.when(hit[r], F.lit(r.delta)).otherwise(0.0) for r in e.rules], F.lit(e.base)))
            names = lambda rules, hit=hit: F.array_compact(F.array(*[F.when(hit[r], F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
            levels = F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(hit[r], F.lit(p.provenance[s])) for r in hit for s in r.sources if s in p.provenance]))))
            eligible = F.lit(p.status == "production") & ~blocked & (confidence >= LEAST_CONFIDENCE) & F.arrays_overlap(levels, F.array(*map(F.lit, CARRYING)))
            found = F.struct(
                F.lit(p.name).alias("profile"), F.lit(e.name).alias("event"), confidence.alias("confidence"), blocked.alias("blocked"), F.coalesce(eligible, F.lit(False)).alias("eligible"), levels.alias("provenance"),
                order.alias("order_id"), names(e.rules).alias("rules"), names(negative).alias("negatives"), F.array(*map(F.lit, e.prohibitions)).cast("array<string>").alias("prohibitions"),
            )
            outcomes.append(F.when(ok, found))
    return messages.select(*keep, F.explode(F.array_compact(F.array(*outcomes))).alias("__found")).select(*keep, "__found.*")


def registered(profiles: list[Profile], status: str) -> list[Profile]:
    return [p for p in profiles if p.status == status]


def diagnostics(found: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """What may be told of evidence that is only observed: no text, address or identity, only whether there is one.

    Evidence that may enter a decision has no place here and fails the query.
    """
    observed = F.assert_true(~F.col("eligible"), F.lit("evidence under observation became eligible"))
    return found.select(*keep, "profile", "event", "confidence", "blocked", F.col("order_id").isNotNull().alias("has_order_id"), F.array_join("rules", ",").alias("rules"), F.array_join("negatives", ",").alias("negatives"), F.coalesce(observed.cast("boolean"), F.lit(False)).alias("would_write"))


def authority(domain: Column, source: Column) -> Column:
    """How much a source counts for a kind of fact; 0 if it says nothing."""
    table = F.create_map(*[F.lit(x) for d, own in AUTHORITY.items() for s, n in own.items() for x in (f"{d}/{s}", n)])
    return F.coalesce(table[F.concat_ws("/", domain, source)], F.lit(0))
