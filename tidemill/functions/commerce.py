"""Filters and parsers of commerce messages, as column expressions over folded text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import address_domain, any_of, domain, fold, has_any, in_domain, labelled_line, let, markup_types, plain_text, reasons, sender_role, without_history

# fixed values: words that make a subject, a snippet or a file name one of commerce
KEYWORDS = (
    "order", "rendelés", "rendeles", "csomag", "shipment", "shipped", "delivery", "delivered", "tracking", "nyomkövet", "nyomkovet", "invoice", "számla", "szamla", "receipt", "nyugta",
    "refund", "visszatér", "visszater", "return", "visszaküld", "visszakuld", "payment", "fizetés", "fizetes", "subscription", "előfizetés", "elofizetes",
)
# fixed values: patterns of an identity or a confirmation, which no advertisement has
ANCHORS = (
    r"\b(?:order\s*(?:number|no\.?|id)|rendeles(?:szam|\s+szama|\s+azonosito)|megrendeles(?:szam|\s+szama|\s+azonosito)|bestellnummer)\s*[:#-]?\s*#?[a-z0-9][a-z0-9._/-]{3,39}\b",
    r"\b(?:tracking(?:\s*(?:number|no\.?|id))?|nyomkovetesi\s*(?:szam|azonosito)|csomag(?:szam|azonosito))\s*[:#-]?\s*[a-z0-9][a-z0-9-]{7,31}\b",
    r"\b(?:invoice(?:\s*(?:number|no\.?|id))?|szamla(?:szam|\s+szama|\s+azonosito))\s*[:#-]?\s*[a-z0-9][a-z0-9._/-]{3,39}\b",
    r"\b(?:thank(?:s| you)? for your order|order confirmation|your order (?:is )?confirmed|we (?:have )?received your order|we've received your order)\b",
    r"\b(?:rendeles visszaigazolas|megrendeles visszaigazolas|koszonjuk (?:a |az )?(?:rendelesed|megrendelesed|rendeleset|megrendeleset)|rendeles(?:ed|e)? (?:sikeresen )?(?:rogzitettuk|beerk(?:ezett|ezett)|megerositve|visszaigazolva))\b",
)
# fixed values: wordings that remind of an earlier purchase, and wordings of campaigns
REPURCHASE = (r"\blegutobbi vasarlasod\b", r"\bpont egy honapja vasaroltal\b", r"\bkorabbi vasarlasod\b", r"\ba kosarad tartalma ez volt\b", r"\bujra kosarba\b", r"\breload_order_link\b", r"\bvasarolj ujra\b", r"\bbuy again\b", r"\breorder now\b")
CAMPAIGN = (
    r"\buj kollekcio\b", r"\bshop the drop\b", r"\bshop now\b", r"\bexkluziv ajanlat", r"\bexclusive offer", r"\bajandek kupon", r"\bkuponkod", r"\bkuponnal kedveskedunk", r"\bnyeremeny",
    r"\bjatek(?:unk|ban|kal)?\b", r"\bakcio(?:s|k)?\b", r"\bkedvezmeny(?:ek|ekkel|es)?\b", r"\blimited time\b", r"\bnew collection\b", r"\bfedezd fel\b", r"\bvarunk(?: az| a)?\b",
)
# fixed values: a courier's confirmations of pickups that senders book
PICKUP_DOMAIN, PICKUP_TERM = "expressone.hu", r"\barufelvetel[a-z]*"
PICKUP_URLS = (r"\brequest_curier\b", r"webcas\.expressone\.hu/request_curier")
PICKUP_WORDS = (r"\brogzitett arufelvetel[a-z]*", r"\barufelvetel[a-z]* statusza", r"\bmegrendelt arufelveteli", r"\barufelvetel[a-z]* lemondas[a-z]*", r"\bmegbizast a futar elfogadta", r"\barufelvetel[a-z]* dija")
# fixed values: wordings of an order confirmation, in messages and in subjects
CONFIRMATIONS = (
    r"\bthank(?:s| you)? for your order\b", r"\byour order (?:is )?confirmed\b", r"\border confirmation\b", r"\bwe (?:have )?received your order\b", r"\bwe've received your order\b",
    r"\bmegrendeles(?:ed|e)? (?:sikeresen )?(?:rogzitettuk|beerk(?:ezett|ezett)|megerositve|visszaigazolva)\b", r"\bkoszonjuk (?:a |az )?(?:rendelesed(?:et)?|megrendelesed(?:et)?|rendeleset|megrendeleset)\b",
    r"\brendeles visszaigazolas\b", r"\bmegrendeles visszaigazolas\b", r"\bbestellbest(?:a|ae)tigung\b", r"\bvielen dank f(?:u|ue)r (?:ihre|deine) bestellung\b", r"\bwir haben (?:ihre|deine) bestellung erhalten\b",
    r"\bconfirmation de commande\b", r"\bmerci pour votre commande\b", r"\bnous avons bien recu votre commande\b", r"\bconfirmacion de (?:tu |su )?pedido\b", r"\bgracias por (?:tu |su )?pedido\b",
)
CONFIRMING_SUBJECTS = (
    r"\border confirmation\b", r"\border #?[a-z0-9][a-z0-9._/-]{2,31} (?:confirmed|received)\b", r"\brendeles(?:i)? visszaigazolas\b", r"\bmegrendeles(?:i)? visszaigazolas\b",
    r"\bbestellbest(?:a|ae)tigung\b", r"\bconfirmation de commande\b", r"\bconfirmacion de pedido\b",
)
DETAILS = r"\b(?:order details|order summary|rendeles reszletei|megrendeles adatai|bestellubersicht|details de la commande|resumen del pedido)\b"
# fixed values: promises of a later message, which say nothing of the present state
PROMISES = (
    r"\b(?:tovabbi\s+e-?mailben\s+)?ertesit(?:unk|juk)[^.!?\n]{0,180}\b(?:amint|amikor|mikor)\b", r"\b(?:e-?mailben\s+)?(?:kuldjuk|kuldeni\s+fogjuk|kuldunk)[^.!?\n]{0,180}\b(?:amint|amikor|mikor)\b",
    r"\bmiutan\b[^.!?\n]{0,120}\b(?:kaptal|kapott|kapsz|kapja|kap)\b[^.!?\n]{0,120}\bertesitest\b[^.!?\n]{0,160}\batveheto\b", r"\bcsak\s+akkor\b[^.!?\n]{0,220}\bmiutan\b[^.!?\n]{0,220}\bertesitest\b[^.!?\n]{0,160}\batveheto\b",
    r"\bwe(?:'ll|\s+will)\s+(?:notify|email|send)[^.!?\n]{0,180}\b(?:when|once|as\s+soon\s+as)\b", r"\byou(?:'ll|\s+will)\s+(?:be\s+notified|receive)[^.!?\n]{0,180}\b(?:when|once|as\s+soon\s+as)\b",
)
# fixed values: how orders are named in confirmations, in order of preference
ORDER_IDS = (
    r"\border\s*(?:number|no\.?|id)\s*[:#-]?\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\border\s*#\s*[:#-]?\s*([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\b(?:rendeles|megrendeles)\s*:\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\b(?:rendeles(?:szam|\s+szama|\s+azonosito)|megrendeles(?:szam|\s+szama|\s+azonosito))\s*[:#-]?\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\b(?:bestellnummer|bestellnr\.?|auftragsnummer)\s*[:#-]?\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\b(?:numero de commande|commande n[°o]?|n[°o]? de commande)\s*[:#-]?\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\b(?:numero de pedido|pedido n[°o]?|pedido)\s*[:#-]?\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
)
# fixed values: how orders are named in later messages, in order of preference
LATER_ORDER_IDS = (
    r"\border\s*(?:number|no\.?|id)\s*[:#-]?\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\border\s*#\s*([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\b(?:rendeles(?:szam|\s+szama|\s+azonosito)|megrendeles(?:szam|\s+szama|\s+azonosito))\s*[:#-]?\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\b(?:a\s+)?(?:rendeles|megrendeles)\s*#\s*([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"#([a-z0-9][a-z0-9._/-]{3,39})\s+szamu\s+(?:rendeleshez|megrendeleshez)\b",
    r"\b(?:a\s+)?([a-z0-9][a-z0-9._/-]{3,39})\s+(?:szamu\s+)?(?:rendelest|megrendelest|rendelesedet|megrendelesedet|rendeleset|megrendeleset|rendelesed|megrendelesed|rendelese|megrendelese)\b",
    r"(?m)^([a-z]{1,8}\d{4,20})\s*-\s*(?:rendelesed|megrendelesed)\b",
    r"\b(?:bestellnummer|bestellnr\.?|auftragsnummer)\s*[:#-]?\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
    r"\b(?:numero de commande|commande n[°o]?|numero de pedido|pedido n[°o]?)\s*[:#-]?\s*#?([a-z0-9][a-z0-9._/-]{3,39})\b",
)
# fixed values: how parcels and invoices are named, in order of preference
TRACKING_IDS = (r"\b(?:tracking(?:\s*(?:number|no\.?|id))?|nyomkovetesi\s*(?:szam|azonosito)|csomag(?:szam|azonosito)|kuldemeny(?:szam|azonosito)|parcel(?:\s*(?:number|no\.?|id))|shipment(?:\s*(?:number|no\.?|id)))\s*[:#-]?\s*([a-z0-9][a-z0-9-]{7,39})\b",)
INVOICE_IDS = (
    r"\b(?:szamla(?:szam|\s+sorszama)?|invoice\s*(?:number|no\.?))\s*[:#-]?\s*([a-z0-9][a-z0-9./_-]{3,39})\b",
    r"(?m)^\s*szamla\s+([a-z0-9][a-z0-9./_-]{3,39})(?:\s|-|$)",
    r"\binvoice\s+([a-z0-9][a-z0-9./_-]{3,39})(?:\s|$)",
)
#: Of each pattern of an identity, words of which a text has one wherever the pattern matches: most texts lack them.
NEEDED = {
    **dict(zip(ORDER_IDS, (("order",), ("order",), ("rendeles",), ("rendeles",), ("bestelln", "auftragsnummer"), ("commande",), ("pedido",)))),
    **dict(zip(LATER_ORDER_IDS, (("order",), ("order",), *[("rendeles",)] * 5, ("bestelln", "auftragsnummer"), ("commande", "pedido")))),
    **dict(zip(TRACKING_IDS, (("tracking", "nyomkovetesi", "csomag", "kuldemeny", "parcel", "shipment"),))),
    **dict(zip(INVOICE_IDS, (("szamla", "invoice"), ("szamla",), ("invoice",)))),
}
#: The same of promises.
PROMISING = ("ertesit", "kuld", "miutan", "csak", "'ll", "will")
# fixed values: wordings by which a message says that it accepts no order
DISCLAIMERS = (
    r"\b(?:ez az|ez a) e-?mail nem minosul (?:a )?megrendeles visszaigazolasanak\b",
    r"\b(?:ez az|ez a) (?:uzenet|ertesites) nem minosul (?:a )?megrendeles visszaigazolasanak\b",
    r"\b(?:csak|csupan) (?:a )?veteli ajanlat (?:be)?erkezeserol ertesit(?:unk|es)\b",
    r"\b(?:a )?(?:rendeles|megrendeles) (?:rogzitese|beerk(?:ezese|ezese)) nem jelenti (?:a )?(?:rendeles|megrendeles) elfogadasat\b",
    r"\b(?:ez (?:egy |az |a )?)?(?:automatikusan kuldott |automatikus )?(?:e-?mail|email|uzenet|ertesites|visszaigazolas)[^\n.]{0,140}\bnem jelent(?:i)?\b[^\n.]{0,140}\b(?:automatikus )?szerzodeskotes(?:t|et)?\b",
    r"\b(?:ez (?:egy |az |a )?)?(?:automatikusan kuldott |automatikus )?(?:e-?mail|email|uzenet|ertesites|visszaigazolas)[^\n.]{0,140}\bnem jelent(?:i)?\b[^\n.]{0,160}\b(?:a )?szerzodes(?: megkoteset| letrejottet)\b",
    r"\b(?:ez (?:egy |az |a )?)?(?:automatikusan kuldott |automatikus )?(?:e-?mail|email|uzenet|ertesites|visszaigazolas)[^\n.]{0,160}\bnem jelent(?:i)?\b[^\n.]{0,180}\b(?:a )?(?:veteli (?:szerzodes megkotesere vonatkozo )?)?ajanlat elfogadasat\b",
    r"\b(?:csak|csupan) (?:azt )?(?:igazolja|erositi meg),? hogy (?:a )?(?:rendelest|megrendelest) megkaptuk\b",
    r"\bthis (?:e-?mail|email|message) does not constitute (?:an? )?(?:order confirmation|acceptance of (?:your )?(?:order|offer))\b",
    r"\bthis (?:e-?mail|email|message) is not (?:an? )?(?:order confirmation|acceptance of (?:your )?(?:order|offer))\b",
    r"\bthis (?:e-?mail|email|message|acknowledg(?:e)?ment)[^\n.]{0,120}\bdoes not mean\b[^\n.]{0,120}\ba contract has been (?:formed|concluded)\b",
    r"\bthis (?:e-?mail|email|message|acknowledg(?:e)?ment)[^\n.]{0,120}\bdoes not constitute\b[^\n.]{0,120}\b(?:a )?contract\b",
    r"\byour order has not yet been accepted\b",
    r"\bwe (?:have )?received your order,? but (?:it|your order) has not (?:yet )?been accepted\b",
    r"\bwe (?:have )?received your order,? but (?:we )?have not (?:yet )?accepted it\b",
    r"\b(?:only|merely) acknowledges? receipt of (?:your )?(?:purchase offer|order request|order)\b",
    r"\backnowledges? receipt (?:only|solely)\b",
)
# fixed values: senders of many merchants' messages, and of their invoices, which no merchant's name follows from
SHARED_SENDERS = ("shopifyemail.com", "my.store-emails.com", "squarespace.info")
INFRASTRUCTURE = ("chameleoon.sk", "szamlazz.hu", "billingo.hu", "myshoprenter.hu")
# fixed values: domains whose messages have parsers of their own
OWN_PARSERS = ("service.gymbeam.hu", "gyerekjatekbolt.com", "alza.hu", "aboutyou.hu", "service-mail.zalando.hu", "dorko.hu", "jatektenger.hu")
# fixed values: wordings of the present state of an order or a parcel, by phase, the furthest first
PHASES = {
    "delivered": (
        r"\b(?:rendelesed|megrendelesed|csomagod) (?:sikeresen )?kezbesitve\b",
        r"\b(?:rendelesedet|megrendelesedet|rendeleset|megrendeleset|csomagodat) (?:sikeresen )?kezbesitett(?:uk|ek)\b",
        r"\b(?:your )?(?:order|package) (?:has been |was )?delivered\b",
        r"\bdelivered successfully\b",
    ),
    "ready_for_pickup": (
        r"\b(?:rendelesed|megrendelesed|csomagod) (?:mar )?atveheto\b",
        r"\batveheto (?:az|a) (?:uzletben|atvevohelyen|automataban|csomagautomataban|ponton)\b",
        r"\b(?:your )?(?:order|package) is ready for (?:collection|pickup)\b",
        r"\bready for (?:collection|pickup)\b",
    ),
    "out_for_delivery": (
        r"\b(?:rendelesed|megrendelesed|csomagod) (?:mar )?(?:a )?kezbesitonel van\b",
        r"\b(?:ma|a mai napon) kezbesit(?:juk|ik) (?:a )?(?:rendelesedet|megrendelesedet|rendeleset|megrendeleset|csomagodat)\b",
        r"\b(?:your )?(?:order|package) is out for delivery\b",
        r"\bout for delivery\b",
    ),
    "shipped": (
        r"\b(?:rendelesedet|megrendelesedet|rendeleset|megrendeleset|rendelesed|megrendelesed|rendelese|megrendelese|csomagodat|rendelt csomagot) [^\n.]{0,80}\b(?:feladtuk|elkuld(?:tuk|tek))\b",
        r"\b(?:rendelesedet|megrendelesedet|rendeleset|megrendeleset|rendelesed|megrendelesed|rendelese|megrendelese|csomagodat) [^\n.]{0,100}\batadtuk [^\n.]{0,60}\b(?:futarnak|futarszolgalatnak|szallitonak)\b",
        r"\b(?:your )?(?:order|package) (?:has been |was )?shipped\b",
        r"\bwe (?:have )?shipped (?:your )?(?:order|package)\b",
    ),
    "in_transit": (
        r"\b(?:csomagod|csomagja) (?:mar )?uton van\b",
        r"\b(?:your )?package is on (?:its|the) way\b",
        r"\b(?:your )?package is in transit\b",
    ),
}
# fixed values: an order that is on its way is a parcel only where the message speaks of one
ORDER_ON_ITS_WAY = (
    r"\b(?:rendelesed|megrendelesed|rendelese|megrendelese) (?:mar )?uton van\b",
    r"\b(?:your )?order is on (?:its|the) way\b",
    r"\b(?:your )?order is in transit\b",
)
OF_PARCELS = (
    r"\bcsomag(?:od|ja|odat|jat|ok|ot)?\b", r"\bfutar(?:nak|szolgalat(?:nak)?)?\b", r"\bkuldemeny(?:ed|e|szam|azonosito|\s+azonositoja)?\b", r"\bnyomkovet",
    r"\btracking\b", r"\bparcel\b", r"\bshipment\b", r"\bcourier\b", r"\bcarrier\b",
)
# fixed values: wordings that tell of an order's invoice
INVOICING = (
    r"\b(?:rendelesedhez|megrendelesedhez|rendeleshez|megrendeleshez) tartozo szamla\b",
    r"\bszamlad (?:elkeszult|kiallitottuk)\b",
    r"\belektronikus szamla(?:d)? [^\n.]{0,80}\b(?:kiallitva|kiallitottuk|kerult kiallit(?:asra|va))\b",
    r"\buj elektronikus szamlad erkezett\b",
    r"\bmellekeltuk (?:a )?szamlad\b",
    r"\bmellekletekent kuldjuk [^\n.]{0,100}\b(?:rendelesed|megrendelesed|rendelese|megrendelese) szamlajat\b",
    r"\b(?:csatolva|mellekletben|mellekletekent) [^\n.]{0,120}\b(?:elkeszult )?szamla(?:t|dat|jat)\b",
    r"\b(?:rendelesed|megrendelesed|rendelese|megrendelese) szamla(?:ja|jat|dat)\b",
    r"\binvoice (?:for|for your) (?:order|purchase)\b",
    r"\byour invoice (?:is ready|has been issued)\b",
)
# fixed values: words that make an amount credible
MONEY_WORDS = ("total", "amount", "paid", "payment", "price", "összesen", "fizetendő", "fizetendo", "összeg", "osszeg", "ár", "ar:", "végösszeg", "vegosszeg", "utánvét", "utanvet", "cash on delivery")
# fixed values: wordings by which a delivery is told from a shipment
DELIVERED = ("kezbesitve", "sikeres kezbesit", "kezbesites megtortent", "sikeresen atadva", "delivered", "delivery complete")
# fixed values: what the parts of an order are called, in order of preference
TOTALS = ("grand total", "order total", "amount due", "vegosszeg", "fizetendo", "osszesen fizetendo", "gesamtbetrag", "gesamtsumme", "total ttc", "total de la commande", "total del pedido")
PAYMENTS = ("payment method", "payment", "fizetesi mod", "zahlungsart", "mode de paiement", "methode de paiement", "metodo de pago")
SHIPPINGS = ("shipping method", "delivery method", "szallitasi mod", "versandart", "mode de livraison", "metodo de envio")


def sender_domain(address: Column) -> Column:
    return domain(address_domain(address))


def pickup_noise(sender: Column, text: Column) -> Column:
    """A sender's own booking of a pickup; ``text`` is folded subject, snippet and raw body."""
    return in_domain(sender, PICKUP_DOMAIN) & text.rlike(PICKUP_TERM) & (any_of(text, PICKUP_URLS) | any_of(text, PICKUP_WORDS))


def promotional_noise(text: Column) -> Column:
    """An advertisement: no anchor, and either a reminder of an earlier purchase or two signs of a campaign."""
    signs = reduce(Column.__add__, [text.rlike(p).cast("int") for p in CAMPAIGN])
    # most texts have no sign at all, which one pass tells
    return (text != "") & any_of(text, (*REPURCHASE, *CAMPAIGN)) & ~any_of(text, ANCHORS) & (any_of(text, REPURCHASE) | (signs >= 2))


def commerce_reasons(messages: DataFrame) -> DataFrame:
    """``messages`` (subject, html, address, folders, attachments) with ``why``: why each is one of commerce, or why it is left out.

    Null subjects and bodies count as empty.  A message is relevant if its
    list has a reason that doesn't begin with ``excluded``.  Texts are made
    once, in projections of their own, before any pattern reads them.
    """
    subject, html = F.coalesce("subject", F.lit("")), F.coalesce("html", F.lit(""))
    texts = messages.withColumn("__plain", F.concat_ws("\n", subject, plain_text(html))).withColumn("__plain", fold(F.col("__plain"))).withColumn("__sender", sender_domain(F.coalesce("address", F.lit("")))).withColumn("__types", markup_types(html))
    # only the courier's messages are read raw
    texts = texts.withColumn("__raw", F.when(in_domain(F.col("__sender"), PICKUP_DOMAIN), fold(F.concat_ws("\n", subject, html))))
    texts = texts.withColumn("__spoken", F.trim(F.regexp_replace("__plain", r"\s+", " "))).withColumn("__searched", F.lower(F.concat_ws(" ", subject, F.array_join("attachments", " "))))
    keyword = reduce(Column.__or__, [F.col("__searched").contains(k) for k in KEYWORDS])
    signals = reasons(("gmail_category_purchases", F.array_contains(F.transform("folders", lambda f: F.upper(f)), "CATEGORY_PURCHASES")), ("structured_commerce_markup", F.size("__types") > 0), ("known_carrier_sender", sender_role(F.col("__sender")) == "carrier"), ("commerce_keyword", keyword))
    why = F.when(pickup_noise(F.col("__sender"), F.col("__raw")), F.array(F.lit("excluded_pickup_service"))).when(promotional_noise(F.col("__spoken")), F.array(F.lit("excluded_promotional_marketing"))).otherwise(signals)
    return texts.withColumn("why", why).drop("__plain", "__raw", "__sender", "__types", "__spoken", "__searched")


def identity(text: Column, patterns: tuple[str, ...], every: bool = False) -> Column:
    """The first group of the first pattern whose first match has a digit in it; with ``every``, of the first match of all that has one."""
    clean = lambda x: F.regexp_replace(F.nullif(x, F.lit("")), r"[.,;:)]+$", "")
    if every:
        found = [F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), clean), lambda v: v.rlike("[0-9]")), F.lit(0)) for p in patterns]
    else:
        found = [let(clean(F.regexp_extract(text, p, 1)), lambda v: F.when(v.rlike("[0-9]"), v)) for p in patterns]
    return F.coalesce(*[F.when(has_any(text, NEEDED[p]), v) if p in NEEDED else v for p, v in zip(patterns, found)])


def without_promises(body: Column) -> Column:
    """The sentences of a folded text, one a line, but those that promise a later message."""
    sentences = F.transform(F.split(F.regexp_replace(body, r"([.!?])\s+", "$1\n"), r"\n+"), lambda s: F.trim(s))
    said = F.filter(sentences, lambda s: s != "")
    return F.array_join(F.when(has_any(body, PROMISING), F.filter(said, lambda s: ~any_of(s, PROMISES))).otherwise(said), "\n")


def delivery_kind(subject: Column, event: Column) -> Column:
    """A delivery counts as one only if the subject says so."""
    text = F.trim(F.regexp_replace(fold(F.coalesce(subject, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when((event == "delivery") & ~reduce(Column.__or__, [text.contains(w) for w in DELIVERED]), "shipment").otherwise(event)


def currency_of(token: Column) -> Column:
    up = F.upper(token)
    return F.when(up.contains("HUF") | up.contains("FT"), "HUF").when(up.contains("EUR") | up.contains("€"), "EUR").when(up.contains("USD") | up.contains("$"), "USD").when(up.contains("GBP") | up.contains("£"), "GBP")


def local_money(raw: Column, currency: Column) -> Column:
    """An amount by the last of comma and point: what stands before it groups thousands; forints have no point."""

    def parsed(m: Column) -> Column:
        v, currency = m["v"], m["currency"]
        comma, dot = F.instr(F.reverse(v), ","), F.instr(F.reverse(v), ".")  # from the end, 0 without
        no = lambda c: F.replace(v, F.lit(c), F.lit(""))
        text = (
            F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(no("."), F.lit(","), F.lit("."))).when((comma > 0) & (dot > 0), no(","))
            .when(comma == 3, F.replace(v, F.lit(","), F.lit("."))).when(comma > 0, no(",")).when((dot > 0) & (dot != 3) & (currency == "HUF"), no(".")).otherwise(v)
        )
        return F.nullif(text, F.lit("")).try_cast("decimal(14,2)")

    return let(F.struct(F.regexp_replace(raw, "[^0-9,.-]", "").alias("v"), currency.alias("currency")), parsed)


#: A currency, an amount.
CURRENCY, AMOUNT = r"(ft|huf|eur|usd|gbp|€|\$|£)", r"([0-9][0-9 .,'’]*)"


def labelled_money(text: Column, labels: tuple[str, ...]) -> Column:
    """amount and currency at the first label that has both; the currency stands before the amount or after it.  Null without."""
    found = []
    for label in labels:
        pattern = rf"(?:^|\n|\b){label}\s*[:#-]?\s*(?:([a-z]{{3}}|€|\$|£)\s*)?{AMOUNT}(?:\s*{CURRENCY})?"
        known = F.regexp_extract(text, pattern, 1).rlike(f"^{CURRENCY}$")
        token = F.when(known, F.regexp_extract(text, pattern, 1)).otherwise(F.regexp_extract(text, pattern, 3))
        parts = F.struct(F.regexp_extract(text, pattern, 2).alias("raw"), currency_of(token).alias("currency"))
        both = let(parts, lambda m: F.struct(local_money(m["raw"], m["currency"]).alias("amount"), m["currency"].alias("currency")))
        found.append(F.when(text.contains(label), let(both, lambda m: F.when(m["amount"].isNotNull() & m["currency"].isNotNull(), m))))
    return F.coalesce(*found)


# fixed values: rows of products, with bars or with a cross
ROWS = (
    r"(?:^|\n)\s*([^\n|]{3,160}?)\s*\|\s*(?:qty|quantity|mennyiseg|menge|qte)\s*[:x]?\s*(\d+)\s*\|\s*([0-9][0-9 .,'’]*)\s*(ft|huf|eur|usd|gbp|€|\$|£)\b",
    r"(?:^|\n)\s*([^\n]{3,160}?)\s+[x×]\s*(\d+)\s+([0-9][0-9 .,'’]*)\s*(ft|huf|eur|usd|gbp|€|\$|£)\b",
)
SUMS = r"^(?:subtotal|shipping|delivery|discount|total|osszesen|szallitas|kedvezmeny)\b"


def product_rows(text: Column) -> Column:
    """name, quantity, total and currency of the rows ``name | qty: n | amount currency``, then of those ``name x n amount currency``, of a folded text; fifty at most."""
    found = []
    none = F.array().cast("array<struct<name:string,quantity:int,total:decimal(14,2),currency:string>>")
    # what a text with such a row has in any case
    may = (text.contains("|"), text.rlike(r"\s[x×]\s*\d+\s+[0-9]"))
    for there, pattern in zip(may, ROWS):
        part = lambda k, pattern=pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
        found.append(F.when(~there, none).otherwise(F.transform(
            F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")),
            lambda r: F.struct(F.trim(r["a"]).alias("name"), r["b"].try_cast("int").alias("quantity"), local_money(r["c"], currency_of(r["d"])).alias("total"), currency_of(r["d"]).alias("currency")),
        )))
    return F.slice(F.filter(F.concat(*found), lambda r: (r["quantity"] > 0) & r["total"].isNotNull() & ~r["name"].rlike(SUMS)), 1, 50)


def generic_order(sender: Column, subject: Column, body: Column) -> Column:
    """order, corroborators, confidence, total and currency of a message that confirms an order; null of others.

    ``subject`` and ``body`` are folded; what the body quotes says nothing.
    Carriers, public mailboxes and senders of many shops confirm nothing, a
    message that says it is no acceptance neither, and two of six signs must
    corroborate the order's number.
    """
    shared = reduce(Column.__or__, [in_domain(sender, d) for d in SHARED_SENDERS])
    may = (sender != "") & (sender_role(sender) == "unknown") & ~shared
    fresh = lambda b: F.struct(subject.alias("subject"), b.alias("body"), F.concat_ws("\n", subject, b).alias("context"))
    return F.when(may, let(without_history(body), lambda b: let(fresh(b), _fresh_order)))


def _fresh_order(m: Column) -> Column:
    subject, body, context = m["subject"], m["body"], m["context"]
    # what decides comes first: the rest is read of confirmations with a number only
    confirms = any_of(context, CONFIRMATIONS) & ~any_of(context, DISCLAIMERS)
    return F.when(confirms, let(identity(context, ORDER_IDS, every=True), lambda order: F.when(order.isNotNull(), _signs(order, subject, body, context))))


def _signs(order: Column, subject: Column, body: Column, context: Column) -> Column:
    read = F.struct(
        order.alias("order"), labelled_money(body, TOTALS).alias("money"), labelled_line(body, PAYMENTS).isNotNull().alias("payment"), labelled_line(body, SHIPPINGS).isNotNull().alias("shipping"), (F.size(product_rows(body)) > 0).alias("rows"), context.rlike(DETAILS).alias("details"),
        any_of(subject, CONFIRMING_SUBJECTS).alias("subject"),
    )

    def decided(r: Column) -> Column:
        n = reduce(Column.__add__, [r[x].cast("int") for x in ("payment", "shipping", "rows", "details", "subject")], r["money"].isNotNull().cast("int"))
        out = F.struct(r["order"].alias("order_id"), n.alias("signs"), F.when(n >= 4, 0.97).when(n == 3, 0.95).otherwise(0.92).alias("confidence"), r["money"]["amount"].alias("total"), r["money"]["currency"].alias("currency"))
        return F.when(n >= 2, out)

    return let(read, decided)


def phase_of(text: Column) -> Column:
    """The furthest phase that a folded text says an order or a parcel is in; null where it says none."""
    transit = any_of(text, PHASES["in_transit"]) | (any_of(text, ORDER_ON_ITS_WAY) & any_of(text, OF_PARCELS))
    return F.coalesce(*[F.when(transit if name == "in_transit" else any_of(text, patterns), F.lit(name)) for name, patterns in PHASES.items()])


def observations(sender: Column, subject: Column, body: Column) -> Column:
    """event, phase, order, tracking, invoice and confidence of what a single merchant's message tells: an invoice, a parcel, both or nothing.

    ``subject`` and ``body`` are folded.  What is quoted and what is promised
    says nothing; senders that speak for many, carriers, public mailboxes and
    merchants with parsers of their own are left to others.
    """

    def fresh(m: Column) -> Column:
        context = F.trim(F.concat_ws("\n", m["subject"], m["body"]))
        of = lambda context: F.struct(context.alias("context"), identity(context, LATER_ORDER_IDS).alias("order"), F.upper(identity(context, TRACKING_IDS)).alias("tracking"))
        return let(let(context, of), lambda r: F.when(F.coalesce(r["order"], r["tracking"]).isNull(), nothing).otherwise(let(read(m, r), told)))

    def read(m: Column, r: Column) -> Column:
        return F.struct(r["order"].alias("order"), r["tracking"].alias("tracking"), identity(r["context"], INVOICE_IDS).alias("invoice"), F.concat_ws("\n", m["subject"], without_promises(m["body"])).alias("now"))

    def told(r: Column) -> Column:
        seen = lambda event, phase, order, tracking, invoice, confidence: F.struct(event.alias("event"), phase.alias("phase"), order.alias("order"), tracking.alias("tracking"), invoice.alias("invoice"), confidence.alias("confidence"))
        none = F.lit(None).cast("string")
        bill = F.when(r["order"].isNotNull() & any_of(r["now"], INVOICING), seen(F.lit("invoice_or_receipt"), none, r["order"], none, r["invoice"], F.when(r["invoice"].isNotNull(), 0.95).otherwise(0.93)))
        both = F.when(r["order"].isNotNull() & r["tracking"].isNotNull(), 0.96).otherwise(0.93)
        parcel = F.when(F.coalesce(r["order"], r["tracking"]).isNotNull(), let(phase_of(r["now"]), lambda p: F.when(p.isNotNull(), seen(F.when(p == "delivered", "delivery").otherwise("shipment"), p, r["order"], r["tracking"], none, both))))
        return F.array_compact(F.array(bill, parcel))

    nothing = F.array().cast("array<struct<event:string,phase:string,order:string,tracking:string,invoice:string,confidence:double>>")
    others = reduce(Column.__or__, [in_domain(sender, d) for d in (*SHARED_SENDERS, *INFRASTRUCTURE)])
    safe = (sender != "") & (sender_role(sender) == "unknown") & ~others & ~sender.isin(*OWN_PARSERS)
    return F.when(safe, let(F.struct(subject.alias("subject"), without_history(body).alias("body")), fresh))


def carrier_message(sender: Column, text: Column) -> Column:
    """tracking, phase and event of a carrier's message; the furthest phase counts."""
    tracking = identity(text, TRACKING_IDS)
    phase = F.when(text.contains("delivered") | text.contains("kezbesitve"), "delivered").when(text.contains("out for delivery") | text.contains("kiszallitas alatt"), "out_for_delivery").when(text.contains("shipped") | text.contains("feladva"), "shipped").when(text.contains("label created") | text.contains("rogzitve"), "created")
    ok = (sender_role(sender) == "carrier") & tracking.isNotNull()
    return F.when(ok, F.struct(tracking.alias("tracking"), phase.alias("phase"), F.when(phase == "delivered", "delivery").otherwise("shipment").alias("event")))


def currency_evident(text: Column, currency: Column) -> Column:
    """Whether a lower-case text names the currency."""
    code = F.lower(F.trim(currency))
    return (
        F.when(code == "huf", text.rlike(r"(?:^|[^a-z])(?:huf|ft|forint)\b")).when(code == "eur", text.rlike(r"(?:^|[^a-z])eur\b|€|(?:^|[^a-z])euro\b")).when(code == "usd", text.rlike(r"(?:^|[^a-z])usd\b|\$|(?:^|[^a-z])dollar\b"))
        .when(code == "gbp", text.rlike(r"(?:^|[^a-z])gbp\b|£|(?:^|[^a-z])pound\b")).otherwise(text.contains(code))
    )


def money_context(text: Column) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in MONEY_WORDS])
