"""Parsers of single senders as data: gates, patterns and what they extract; the first that matches speaks for a message."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import in_domain, let


@dataclass(frozen=True)
class Program:
    """All patterns must match.  ``identity`` is a field and a pattern with one group; a second one, if given, must agree with it."""

    name: str
    event: str
    phase: str | None
    confidence: float
    identity: tuple[str, str]
    domains: tuple[str, ...] = ()
    addresses: tuple[str, ...] = ()
    subject: tuple[str, ...] = ()
    body: tuple[str, ...] = ()
    agrees: tuple[str, str] | None = None
    extracts: dict[str, str] = field(default_factory=dict, hash=False)  # from the body


_FOXPOST, _MPL = r"\bcsomagszam\s*:\s*(clfox[0-9a-z]{6,20})\b", r"\bcsomagazonosito\s*:\s*(?:\[\s*)?([a-z0-9-]{10,32})\b"
_SENDER = r"\bfelado\s*:\s*([^\n]{2,80})"
# fixed values: senders, wordings and confidences of single merchants' and carriers' messages, on folded text
PROGRAMS = (
    Program("mpl", "shipment", "shipped", 0.995, ("body", _MPL), addresses=("csomag@posta.hu",), subject=("^csomagot adtak fel neked$",), body=(r"\bertesitunk, hogy csomagot adtak fel neked\b", _SENDER), extracts={"party": _SENDER}),
    Program("mpl", "shipment", "out_for_delivery", 0.995, ("body", _MPL), addresses=("csomag@posta.hu",), subject=("^csomagod a kezbesitonel van$",), body=(r"\bcsomagod a kezbesitonel van\b", _SENDER), extracts={"party": _SENDER}),
    Program("mpl", "shipment", "ready_for_pickup", 0.995, ("body", _MPL), addresses=("csomag@posta.hu",), subject=("^csomagod a postan atveheto$",), body=(r"(?s)\bcsomagod.{0,120}?atveheto az alabbi postan\b", _SENDER), extracts={"party": _SENDER}),
    Program("foxpost", "shipment", "shipment_created", 0.99, ("body", _FOXPOST), domains=("foxpost.hu",), subject=(r"\beloertesites\b",), body=(r"\bmeg\s+nem\s+adtak\s+at\s+a\s+foxpost\s+reszere\b", _SENDER), extracts={"party": _SENDER}),
    Program("foxpost", "shipment", "in_transit", 0.99, ("body", _FOXPOST), domains=("foxpost.hu",), subject=(r"\bcsomagod\s+mar\s+a\s+raktarunkban\s+van\b",), body=(_SENDER,), extracts={"party": _SENDER}),
    Program("foxpost", "shipment", "ready_for_pickup", 0.99, ("body", _FOXPOST), domains=("foxpost.hu",), subject=(r"\bcsomagod\s+megerkezett\b",), body=(r"\bmegerkezett,?\s+amely\s+atveheto\b", r"\bcsomagatvetel\s+hatarideje\b", _SENDER), extracts={"party": _SENDER}),
    Program("gyerekjatekbolt", "order_updated", "payment_failed", 0.99, ("body", r"\brendelesszam\s*:\s*#?([a-z0-9-]{4,20})\b"), domains=("gyerekjatekbolt.hu",), body=(r"\bsikertelen bankkartyas fizetes\b|\btranzakcio sikertelen volt\b|\bbankkartyas fizetes nem sikerult\b|\brendelest nem sikerult befizetni\b",)),
    Program("gyerekjatekbolt", "order_updated", "cancelled", 0.99, ("body", r"\brendelesszam\s*:\s*#?([a-z0-9-]{4,20})\b"), domains=("gyerekjatekbolt.hu",), body=(r"\bjelenlegi allapot\s*:\s*torolve\b|\brendeles(?:enek)?\s+(?:aktualis\s+)?(?:allapota|statusza)\s*:\s*torolve\b|\bmegrendeles(?:e)?\s+torolve\b",)),
    Program("gymbeam", "order_updated", "delayed", 0.99, ("body", r"\b([0-9]{8,20})\s+(?:szamu\s+)?rendeles(?:ed|e)?\s+kesik\b"), domains=("gymbeam.hu",), subject=(r"\bellenorizzuk a kezbesitest\b",)),
    Program("gymbeam", "shipment", "shipment_created", 0.99, ("body", r"\ba\s+([0-9]{8,20})\s+szamu\s+rendelesed(?:et)?\b"), domains=("gymbeam.hu",), subject=(r"\bmegrendelesed uton van\b",), body=(r"\bbecsomagoltuk\b", r"(?s)\bhamarosan\b.{0,120}\b(?:szallito ceg|futarszolgalat)\b.{0,80}\bkezebe kerul\b", r"\ba\s+([a-z0-9-]{10,32})\s+szammal\s+kovetheted\s+a\s+csomagot\b"), extracts={"tracking": r"\ba\s+([a-z0-9-]{10,32})\s+szammal\s+kovetheted\s+a\s+csomagot\b"}),
    Program("marketa", "order_updated", "order_packing", 0.99, ("subject", r"\b([0-9]{6,12})\s+(?:szamu\s+)?rendeles(?:ed|eddel)?\b"), domains=("marketa.hu",), subject=(r"\belkezdtuk\s+rendelesed\s+osszekesziteset\b",), body=(r"\braktarunk\s+mar\s+elkezdte\s+becsomagolni\b", r"\b(?:1\s*-\s*2|1-2)\s+munkanapon\s+belul\s+atadja\s+azt\s+a\s+futarszolgalatnak\b")),
    Program("dorko", "shipment", "shipped", 0.99, ("body", r"\brendeles azonosito\s*:\s*(dk[0-9]{5,20})\b"), domains=("dorko.hu",), subject=(r"\bdorko\s*:\s*rendeles elkuldve\b",), body=(r"\bmegrendelese feladasra kerult a megadott cimre\b",)),
    Program("aboutyou", "shipment", "in_transit", 0.99, ("subject", r"\bszallitasi informaciok\s*:\s*(ayhu-[0-9]{3}-[0-9]{6,12})\b"), domains=("aboutyou.hu",), body=(r"\bszallitas megerositese\b", r"\ba csomag uton van\b")),
    Program("alza", "shipment", "ready_for_pickup", 0.99, ("subject", r"\bvedd at\s+([0-9]{9,12})\s+sz\.?\s+megrendelesed\b"), domains=("alza.hu",), body=(r"\bmegrendelesed megerkezett\b", r"\balzaboxba\b"), agrees=("body", r"\b([0-9]{9,12})\s+sz\.?\s+megrendelesed\b")),
    Program("szidibox", "shipment", "shipment_created", 0.995, ("subject", r"\b(so-[0-9]{4}-[0-9]{4,12})\b"), addresses=("szidibox@gmail.com",), subject=(r"megrendeleset osszekeszitettuk\b",), body=(r"kartonshop\.hu", r"\bosszekeszitettuk es hamarosan atadjuk a futarszolgalat reszere\b"), agrees=("body", r"\brendelesszam\s*:\s*(so-[0-9]{4}-[0-9]{4,12})\b")),
    Program("express_one", "payment_completed", None, 0.99, ("body", r"\btotal\s+[a-z]{3}\s*:\s*([0-9][0-9 .,]*)"), addresses=("slip@expressone.hu",), subject=("^fizetesi bizonylat$",), body=(r"\bstatus\s*:\s*success\b", r"\btransaction\s+type\s*:\s*(?:vasarlas|purchase)\b"), extracts={"currency": r"\btotal\s+([a-z]{3})\s*:"}),
)


def parsed(sender: Column, address: Column, subject: Column, body: Column, programs: tuple[Program, ...] = PROGRAMS) -> Column:
    """name, event, phase, confidence, identity and extracts of the first program that matches; null if none does.

    ``subject`` and ``body`` are folded, the sender's gate comes first, so
    patterns are only tried on messages of the sender that they are for.
    """
    fields = {"subject": subject, "body": body}
    found = []
    for p in programs:
        gate = reduce(Column.__or__, [*[in_domain(sender, d) for d in p.domains], *[F.lower(F.trim(address)) == a for a in p.addresses]])
        hits = reduce(Column.__and__, [*[subject.rlike(x) for x in p.subject], *[body.rlike(x) for x in p.body]], F.lit(True))
        group = lambda where: F.upper(F.trim(F.regexp_extract(fields[where[0]], where[1], 1)))
        extracts = F.create_map(*[x for k, v in p.extracts.items() for x in (F.lit(k), F.trim(F.regexp_extract(body, v, 1)))]) if p.extracts else F.create_map().cast("map<string,string>")
        out = lambda i, p=p, extracts=extracts: F.struct(F.lit(p.name).alias("name"), F.lit(p.event).alias("event"), F.lit(p.phase).cast("string").alias("phase"), F.lit(p.confidence).alias("confidence"), i.alias("identity"), extracts.alias("extracts"))
        agree = (lambda i, p=p, group=group: i == group(p.agrees)) if p.agrees else (lambda i: F.lit(True))
        found.append(F.when(gate & hits, let(group(p.identity), lambda i, out=out, agree=agree: F.when((i != "") & agree(i), out(i)))))
    return F.coalesce(*found)
