"""Parsers of whole orders: products and money lines of single shops' messages.

Products that span lines are built by one pass over the lines of a body: a
state machine as an aggregate, whose state is the product that is open and the
ones that are closed.  A shop that states its sums has its orders accepted
only if they reconcile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commerce import PAYMENTS, SHIPPINGS, currency_of, local_money
from ..functions.text import ACCENTED, PLAIN, in_domain, labelled_line, let

#: Products of an order that are kept.
MOST = 50
PRODUCT = "struct<name:string,variant:string,sku:string,quantity:int,unit_price:decimal(14,2),total_price:decimal(14,2),url:string>"
FIELDS = ("name", "variant", "sku", "quantity", "unit_price", "total_price", "url")
MONEY = "decimal(14,2)"
# fixed values: the labels after which a product list has ended, in folded text, and those that end a value
STOPS = r"(?i)^(?:szallitas|utanvet|szallitasi mod|fizetesi mod|brutto osszeg)\s*:"
VALUE_ENDS = "Szállítás|Utánvét|Szállítási mód|Fizetési mód|Bruttó összeg|Szállítási cím|Számlázási cím"
# fixed values: labels of a product's properties
DETAILS = r"(?i)\b(?:Grammsúly|Ízesítés|Kapszula|Méret|Kiszerelés(?:\s*\(ml\))?|Tabletta)\s*:"
# fixed values: how payments are called in a marketplace's orders, in folded text
METHODS = {"utanvet": "utánvét", "bankkartya": "bankkártya", "paypal": "PayPal", "google pay": "Google Pay", "apple pay": "Apple Pay", "payu": "PayU", "blik": "BLIK", "banki atutalas": "banki átutalás"}
MARKETPLACE = ("allegro.com", "allegro.hu", "allegro.pl", "allegro.cz", "allegro.sk")
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
PRICE = r"([0-9][0-9\s.,'’]{0,20})\s*(Ft|HUF|EUR|USD|GBP|€|\$|£)\b"
# fixed values: wordings of a payment's state
ON_DELIVERY = r"\b(?:cash on delivery|cod|utanvet|nachnahme)\b"
PAID = r"\b(?:payment received|payment successful|successfully paid|sikeres fizetes|fizetes sikeres|bezahlt|paiement accepte|pago completado)\b"


def unaccented(text: Column) -> Column:
    """A text without accents, in its case; no-break spaces are spaces."""
    return F.translate(text, ACCENTED + "\r", PLAIN)  # what has no counterpart is deleted


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def whole(raw: Column) -> Column:
    """An amount of forints: the digits, whatever stands between them."""
    return F.nullif(F.regexp_replace(raw, "[^0-9-]", ""), F.lit("")).try_cast(MONEY)


def product(**fields: Column) -> Column:
    given = {"quantity": F.lit(1)} | fields
    return F.struct(*[given.get(f, F.lit(None)).alias(f) for f in FIELDS]).cast(PRODUCT)


def _none() -> Column:
    return F.array().cast(f"array<{PRODUCT}>")


def trimmed_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(F.translate(x, "\t ", "  "))), lambda x: x != "")


def listed_products(body: Column) -> Column:
    """Products under a summary, each ``2x name``, lines of details, and a line with its price.

    A product that the next one, the end of the list or the end of the body
    cuts off before its price is none.
    """
    state = "struct<listing:boolean,quantity:int,name:string,details:array<string>,products:array<" + PRODUCT + ">>"
    start = F.struct(F.lit(False).alias("listing"), F.lit(None).cast("int").alias("quantity"), F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("details"), _none().alias("products")).cast(state)

    def step(s: Column, x: Column) -> Column:
        plain = unaccented(x)
        price = found(x, r"(?i)^([0-9][0-9 .]*)\s*(?:Ft|HUF)$")
        begins, head = x.rlike(r"(?i)^\d+\s*x\s+"), found(x, r"(?i)^\d+\s*x\s+(.{2,300})$")
        nothing = F.array().cast("array<string>")
        at = lambda listing, quantity, name, details, products: F.struct(listing.alias("listing"), quantity.alias("quantity"), name.alias("name"), details.alias("details"), products.alias("products")).cast(state)
        shut = lambda listing, products: at(listing, F.lit(None), F.lit(None), nothing, products)
        total = whole(F.replace(price, F.lit("."), F.lit("")))
        closed = product(name=s["name"], variant=F.when(F.size(s["details"]) > 0, F.left(F.array_join(s["details"], " | "), F.lit(500))), quantity=s["quantity"], unit_price=F.round(total / s["quantity"], 2), total_price=total)
        return (
            # null once the list has ended
            F.when(s["listing"].isNull(), s).when(~s["listing"], shut(plain.rlike(r"(?i)\brendelesi osszesito\b"), s["products"]))
            .when(plain.rlike(STOPS), shut(F.lit(None), s["products"]))
            .when(begins, at(F.lit(True), F.when(head.isNotNull(), found(x, r"(?i)^(\d+)\s*x\s+").try_cast("int")), F.trim(head), nothing, s["products"]))
            .when(s["name"].isNull(), s)
            .when(price.isNotNull(), shut(F.lit(True), F.when(s["quantity"] > 0, F.concat(s["products"], F.array(closed))).otherwise(s["products"])))
            .otherwise(at(F.lit(True), s["quantity"], s["name"], F.concat(s["details"], F.array(x)), s["products"]))
        )

    return F.slice(F.aggregate(trimmed_lines(body), start, step, lambda s: s["products"]), 1, MOST)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, " ", " "), r"\s+", " "))


def run_on_products(body: Column) -> Column:
    """The same products where all stand on one line; what follows a name's first property is the variant."""
    section = F.trim(F.regexp_extract(one_line(body), r"(?i)Rendelési összesítő\s*:\s*(.+?)(?=\s+Szállítás\s*:)", 1))
    begin = r"(?i)(?:^|\s)(\d+)\s*x\s+"
    # each chunk begins after a quantity and ends at the next one
    chunks = F.zip_with(F.regexp_extract_all(section, F.lit(begin), F.lit(1)), F.slice(F.split(section, begin), 2, 10_000), lambda q, c: F.struct(q.try_cast("int").alias("quantity"), F.trim(c).alias("text")))
    last = r"(?i)([0-9][0-9 .]*)\s*(?:Ft|HUF)\b(?!.*[0-9]\s*(?:Ft|HUF)\b).*$"

    def read(c: Column) -> Column:
        said = F.struct(c["quantity"].alias("quantity"), whole(F.replace(found(c["text"], last), F.lit("."), F.lit(""))).alias("total"), F.trim(F.regexp_replace(c["text"], last, "")).alias("said"))

        def split(r: Column) -> Column:
            name = F.trim(F.split(r["said"], DETAILS, 2)[0])
            cut = (name != "") & (F.length(name) < F.length(r["said"])) & r["said"].rlike(DETAILS)
            variant = F.when(cut, F.left(F.trim(F.substring(r["said"], F.length(name) + 1, F.length(r["said"]))), F.lit(500)))
            return product(name=F.when(cut, name).otherwise(r["said"]), variant=variant, quantity=r["quantity"], unit_price=F.round(r["total"] / F.nullif(r["quantity"], F.lit(0)), 2), total_price=r["total"])

        return let(said, split)

    good = F.filter(F.transform(chunks, read), lambda p: (p["quantity"] > 0) & p["total_price"].isNotNull() & (p["name"] != ""))
    return F.slice(F.coalesce(good, _none()), 1, MOST)


def block_products(body: Column) -> Column:
    """Products of four lines: name, address and number of the article; unit price; pieces; price."""
    head = r"^(.{3,240}?)(?:\s+\[URL:\s*(https?://[^\]\s]+)\])?\s+\(([^)]{2,40})\)$"
    state = "struct<stage:int,head:string,unit:decimal(14,2),quantity:int,products:array<" + PRODUCT + ">>"
    at = lambda stage, text, unit, quantity, products: F.struct(stage.alias("stage"), text.alias("head"), unit.alias("unit"), quantity.alias("quantity"), products.alias("products")).cast(state)
    null = F.lit(None)

    def step(s: Column, x: Column) -> Column:
        # the last price may be followed by other words, the first fills its line
        exact, price, pieces = found(x, r"(?i)^(-?[0-9][0-9 ]*)\s*Ft$"), found(x, r"(?i)^(-?[0-9][0-9 ]*)\s*Ft\b"), found(x, r"(?i)^(\d+)\s*db$")
        name, total = F.trim(found(s["head"], head)), whole(price)
        closed = product(name=name, sku=F.trim(found(s["head"], head, 3)), quantity=s["quantity"], unit_price=s["unit"], total_price=total, url=found(s["head"], head, 2))
        good = (s["quantity"] > 0) & (s["unit"] >= 0) & (total >= 0) & ~name.rlike(r"(?i)^kedvezmeny\b")
        return (
            F.when((s["stage"] == 1) & exact.isNotNull(), at(F.lit(2), s["head"], whole(exact), null, s["products"]))
            .when((s["stage"] == 2) & pieces.isNotNull(), at(F.lit(3), s["head"], s["unit"], pieces.try_cast("int"), s["products"]))
            .when((s["stage"] == 3) & price.isNotNull(), at(F.lit(0), null, null, null, F.when(good, F.concat(s["products"], F.array(closed))).otherwise(s["products"])))
            .when(x.rlike(head), at(F.lit(1), x, null, null, s["products"])).otherwise(at(F.lit(0), null, null, null, s["products"]))
        )

    return F.slice(F.aggregate(trimmed_lines(body), at(F.lit(0), null, null, null, _none()), step, lambda s: s["products"]), 1, MOST)


def offer_products(body: Column, fallback: Column) -> Column:
    """Products by the addresses of their offers; the price is the first one in the 700 characters after it.

    An address without its query counts once.
    """
    offer = r"(?is)(?:\[URL:\s*|\]\()(https?://[^\]\s)]+/ajanlat/[^\]\s)]+)(?=(.{0,700}))"
    part = lambda k: F.regexp_extract_all(body, F.lit(offer), F.lit(k))

    def read(url: Column, tail: Column) -> Column:
        address = F.regexp_replace(url, "[?#].*$", "")
        path = F.regexp_extract(address, r"(?i)^https?://[^/]+(/.*)$", 1)
        slug = F.regexp_replace(F.try_url_decode(F.replace(F.regexp_extract(path, r"(?i)^.*?/ajanlat/(.*)$", 1), F.lit("+"), F.lit("%2B"))), "^/+|/+$", "")
        token = found(tail, f"(?i){PRICE}", 2)
        currency = F.coalesce(currency_of(token), fallback)
        said = F.struct(slug.alias("slug"), found(slug, r"-(\d{6,20})$").alias("sku"), address.alias("url"), local_money(F.regexp_replace(found(tail, f"(?i){PRICE}"), r"\s", ""), F.lit("EUR")).alias("price"), currency.alias("currency"))

        def made(r: Column) -> Column:
            name = F.trim(F.regexp_replace(F.regexp_replace(F.when(r["sku"].isNull(), r["slug"]).otherwise(F.regexp_replace(r["slug"], r"-\d{6,20}$", "")), "[-_]+", " "), r"\s+", " "))
            return product(name=name, sku=r["sku"], unit_price=r["price"], total_price=r["price"], url=r["url"])

        return let(said, made)

    each = F.filter(F.zip_with(part(1), part(2), read), lambda p: (p["name"] != "") & p["total_price"].isNotNull())
    once = F.aggregate(each, _none(), lambda have, p: F.when(F.exists(have, lambda q: q["url"] == p["url"]), have).otherwise(F.concat(have, F.array(p))))
    return F.slice(once, 1, MOST)


def order(**fields: Column) -> Column:
    """An order's struct; what isn't given is null, and without products the list is empty."""
    kinds = {
        "parser": "string", "event": "string", "merchant": "string", "order_number": "string", "subtotal": MONEY, "shipping": MONEY, "discount": MONEY, "total": MONEY, "currency": "string", "payment_status": "string",
        "payment_method": "string", "shipping_method": "string", "carrier": "string", "cod_amount": MONEY, "confidence": "double", "products": f"array<{PRODUCT}>",
    }
    given = {"products": _none()} | fields
    return F.struct(*[given.get(k, F.lit(None)).cast(v).alias(k) for k, v in kinds.items()])


def _all(*conditions: Column) -> Column:
    return reduce(Column.__and__, [F.coalesce(c, F.lit(False)) for c in conditions])


def webshop_order(sender: Column, subject: Column, body: Column) -> Column:
    """A webshop's confirmation, whose sums follow their labels on lines of their own; ``subject`` and ``body`` without accents."""
    after = lambda label: whole(found(body, rf"(?i)(?:^|\n)\s*{label}\s*\n\s*(-?[0-9][0-9 ]*)\s*Ft\b"))
    line = lambda label: F.trim(found(body, rf"(?i)(?:^|\n)\s*{label}\s*\n\s*([^\n]{{2,160}})"))
    number = found(subject, r"(?i)automata\s+megrendeles\s+visszaigazolas\s*-\s*([0-9]{4,10}-[0-9]{4,12})\b")
    read = F.struct(
        number.alias("number"), after("Osszesen").alias("subtotal"), after("Szallitasi koltseg").alias("shipping"), after("Vegosszeg").alias("total"), F.abs(after(r"Kedvezmeny[^\n]*")).alias("discount"), line("Fizetesi mod").alias("payment"), line("Szallitasi mod").alias("by")
    )

    def decided(r: Column) -> Column:
        cod = F.coalesce(r["payment"].rlike("(?i)utanvet"), F.lit(False))
        made = order(
            parser=F.lit("limone"), event=F.lit("order_created"), merchant=F.lit("Limone.hu"), order_number=r["number"], subtotal=r["subtotal"], shipping=r["shipping"], discount=r["discount"], total=r["total"],
            currency=F.when(F.coalesce(r["total"], r["subtotal"], r["shipping"]).isNotNull(), "HUF"), payment_status=F.when(cod, "cash_on_delivery").otherwise("unknown"), payment_method=r["payment"], shipping_method=r["by"],
            carrier=F.when(r["by"].rlike(r"(?i)express\s*one|expressone"), "Express One"), cod_amount=F.when(cod, r["total"]), confidence=F.lit(0.995), products=block_products(body),
        )
        agrees = found(body, r"(?i)(?:^|\n)\s*azonosito\s*\n\s*([0-9]{4,10}-[0-9]{4,12})\b") == r["number"]
        return F.when(_all(r["number"].isNotNull(), agrees, body.rlike(r"(?i)webaruhazunkban\s+rendelest\s+adott\s+le\b"), body.rlike(r"(?i)ez\s+egy\s+automata\s+visszaigazolas\s+a\s+megrendeles\s+leadasarol\b")), made)

    return F.when(in_domain(sender, "limone.hu"), let(read, decided))


def processed_order(sender: Column, subject: Column, body: Column, raw: Column) -> Column:
    """A shop's notice that an order is being made ready; accepted only if products, shipping and fee make up the total.

    ``subject`` and ``body`` without accents, ``raw`` the body as it is.
    """
    flat, said = F.regexp_replace(body, r"\s+", " "), one_line(raw)
    amount = lambda label: whole(F.replace(found(flat, rf"(?i)\b{label}\s*:\s*([0-9][0-9 .]*)\s*(?:Ft|HUF)\b"), F.lit("."), F.lit("")))
    value = lambda label: F.trim(found(said, rf"(?i){label}\s*:\s*(.+?)(?=\s+(?:{VALUE_ENDS})\s*:|$)"))
    by_lines, run_on = listed_products(raw), run_on_products(raw)
    products = let(F.struct(by_lines.alias("a"), run_on.alias("b")), lambda p: F.when(F.size(p["b"]) > F.size(p["a"]), p["b"]).otherwise(p["a"]))
    read = F.struct(
        found(body, r"(?i)\ba\s+(\d{8,20})\s+szamu\s+rendelesed\s+mar\s+keszul\b").alias("number"), amount("Brutto osszeg").alias("total"), amount("Szallitas").alias("shipping"), amount("Utanvet").alias("fee"), value("Fizetési mód").alias("payment"), value("Szállítási mód").alias("by"), products.alias("products")
    )

    def decided(r: Column) -> Column:
        subtotal = F.aggregate(r["products"], F.lit(0).cast(MONEY), lambda s, p: (s + p["total_price"]).cast(MONEY))
        cod = unaccented(r["payment"]).rlike("(?i)utanvet")
        reconciles = r["shipping"].isNull() | (subtotal + r["shipping"] + F.coalesce(r["fee"], F.lit(0)) == r["total"])
        made = order(
            parser=F.lit("gymbeam"), event=F.lit("order_updated"), merchant=F.lit("GymBeam"), order_number=r["number"], subtotal=subtotal, shipping=r["shipping"], total=r["total"], currency=F.lit("HUF"), payment_status=F.when(cod, "cash_on_delivery").otherwise("pending"),
            payment_method=r["payment"], shipping_method=r["by"], carrier=F.when(unaccented(r["by"]).rlike(r"(?i)express\s*one"), "Express One"), cod_amount=F.when(cod, r["total"]), confidence=F.lit(0.99), products=r["products"],
        )
        return F.when(_all(r["number"].isNotNull(), r["total"].isNotNull(), r["payment"].isNotNull(), r["by"].isNotNull(), F.size(r["products"]) > 0, reconciles), made)

    gate = _all(sender == "service.gymbeam.hu", subject.rlike(r"(?i)\brendelesed feldolgozas alatt van\b"), body.rlike(r"(?i)\bmegkaptuk a rendelesedet\b"), body.rlike(r"(?i)\brendelesi osszesito\b"))
    return F.when(gate, let(read, decided))


def marketplace_order(sender: Column, subject: Column, body: Column, raw_subject: Column, raw: Column) -> Column:
    """A marketplace's confirmation of a purchase from one of its sellers; ``subject`` and ``body`` without accents."""
    number = F.lower(F.coalesce(found(body, rf"(?i)\bmegrendeles\s+szama\s*({UUID})\b"), found(raw, rf"(?i)/vasarlasok/vasarlasi-elozmenyek/({UUID})(?:[?/#\s]|$)")))
    bought = (r"(?i)megv(?:á|a)s(?:á|a)roltad\s+\d+\s+term(?:é|e)ket\s+(.{2,120}?)\s+elad(?:ó|o)t(?:ó|o)l", r"(?i)megv(?:á|a)s(?:á|a)roltad\s*:\s*.+?\s+(.{2,120}?)\s+elad(?:ó|o)t(?:ó|o)l\.?$")
    other = lambda x: F.when(~F.lower(F.trim(x)).isin("", "allegro"), F.trim(x))
    line = F.regexp_replace(found(raw, r"(?i)(?:^|\n)\s*t(?:ő|o)le\s*:\s*([^\n]{2,240})"), r"(?i)\s*\[URL:\s*https?://[^\]]+\]\s*$", "")
    seller = F.coalesce(*[other(found(x, p)) for x in (raw, raw_subject) for p in bought], other(line))
    window = F.lower(F.substring(F.regexp_extract(body, r"(?is)\bfizetesi mod\b(.{0,180})", 1), 1, 180))
    method = F.coalesce(*[F.when(window.rlike(rf"\b{k}\b"), F.lit(v)) for k, v in METHODS.items()])
    total = rf"(?i)\bOSSZESEN\b\s*{PRICE}"
    by = F.regexp_extract(body, r"(?is)\bFutar\b.{0,260}", 0)
    sent = r"(?i)(?:^|\s)([0-9]{1,3}(?:[\s.][0-9]{3})*(?:,[0-9]{2})?|[0-9]+(?:[.,][0-9]{2})?)\s*(?:Ft|HUF|EUR|USD|GBP|€|\$|£)\b"
    plain = lambda x: local_money(F.regexp_replace(x, r"\s", ""), F.lit("EUR"))
    read = F.struct(
        number.alias("number"), seller.alias("seller"), method.alias("method"), plain(found(body, total)).alias("total"), currency_of(found(body, total, 2)).alias("currency"), plain(found(by, sent)).alias("shipping"),
        F.when(body.rlike(r"(?i)\bDPD\b"), "DPD").when(body.rlike(r"(?i)\bGLS\b"), "GLS").when(body.rlike(r"(?i)\bPACKETA\b"), "Packeta").alias("carrier"), body.rlike(r"(?i)\bFutar\s+utanvet\b").alias("collects"),
    )

    def decided(r: Column) -> Column:
        cod = r["method"] == "utánvét"
        courier = F.concat(F.lit("Futár"), F.when(r["collects"], " utánvét").otherwise(""))
        made = order(
            parser=F.lit("allegro"), event=F.lit("order_created"), merchant=r["seller"], order_number=r["number"], shipping=r["shipping"], total=r["total"], currency=r["currency"], payment_status=F.when(cod, "cash_on_delivery").otherwise("pending"), payment_method=r["method"],
            shipping_method=F.when(r["carrier"].isNotNull(), F.concat(courier, F.lit(", "), r["carrier"])).when(r["collects"], courier), carrier=r["carrier"], cod_amount=F.when(cod, r["total"]), confidence=F.lit(0.995), products=offer_products(raw, r["currency"]),
        )
        given = _all(r["number"].isNotNull(), r["seller"].isNotNull(), r["total"].isNotNull(), r["currency"].isNotNull(), r["method"].isNotNull())
        return F.when(given, let(made, lambda m: F.when(F.size(m["products"]) > 0, m)))

    gate = _all(sender.isin(*MARKETPLACE), F.trim(subject).rlike(r"(?i)^megvasaroltad\s*:"), body.rlike(r"(?i)\bmegvasaroltad\s+\d+\s+termeket\b"))
    return F.when(gate, let(read, decided))


def received_order(sender: Column, subject: Column, body: Column) -> Column:
    """A shop's word that an offer to buy has come in, which it says is no acceptance; accepted only if the sums reconcile.

    ``subject`` and ``body`` are folded.
    """
    amount = lambda label: whole(F.replace(found(body, rf"(?:^|\n)\s*{label}\s*:\s*-?([0-9][0-9 .]*)\s*ft\b"), F.lit("."), F.lit("")))
    number = found(subject, r"^\s*megrendelesi szam\s*:\s*#?(\d{6,12})\s*$")
    read = F.struct(
        number.alias("number"), amount("termekek osszesen").alias("subtotal"), amount(r"futarszolgalat\s+dpd").alias("shipping"), amount(r"engedmeny(?:\s*\([^\n)]*\))?").alias("discount"), amount("osszesen").alias("total"), labelled_line(body, PAYMENTS).alias("payment"), labelled_line(body, SHIPPINGS).alias("by")
    )

    def decided(r: Column) -> Column:
        text = F.concat_ws("\n", r["payment"], body)
        status = F.when(r["payment"].rlike(r"\bklarna\b"), "pending").when(text.rlike(ON_DELIVERY), "cash_on_delivery").when(text.rlike(PAID), "paid").otherwise("unknown")
        made = order(
            parser=F.lit("jatekbolt"), event=F.lit("order_created"), merchant=F.lit("JatekBolt.hu"), order_number=r["number"], subtotal=r["subtotal"], shipping=r["shipping"], discount=r["discount"], total=r["total"], currency=F.lit("HUF"), payment_status=status,
            payment_method=r["payment"], shipping_method=r["by"], carrier=F.lit("DPD"), confidence=F.lit(0.995),
        )
        agrees = found(body, r"(?:^|\n)\s*rendelesi szam\s*:\s*#?(\d{6,12})\b") == r["number"]
        return F.when(_all(agrees, r["payment"].isNotNull(), r["by"].rlike(r"\bdpd\b"), r["subtotal"] + r["shipping"] - r["discount"] == r["total"]), made)

    said = (r"\bkoszonjuk rendelesed\b", r"\bez az e-mail nem minosul a megrendeles visszaigazolasanak\b", r"\bveteli ajanlat megerkezeserol ertesitunk\b", r"\bmegrendelesed reszletei\b")
    return F.when(_all(in_domain(sender, "jatekbolt.hu"), *[body.rlike(p) for p in said]), let(read, decided))


def whole_orders(messages: DataFrame) -> DataFrame:
    """``messages`` (sender, subject, body) with ``order``: the order that the first parser reads whole; messages that none does are left out.

    Null subjects and bodies count as empty.  Parsers look at their own
    sender's messages only.
    """
    subject, body = F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))
    texts = messages.withColumn("__subject", unaccented(subject)).withColumn("__body", unaccented(body)).withColumn("__lower_subject", F.lower("__subject")).withColumn("__lower_body", F.lower("__body"))
    sender, plain_subject, plain_body = F.col("sender"), F.col("__subject"), F.col("__body")
    read = F.coalesce(webshop_order(sender, plain_subject, plain_body), marketplace_order(sender, plain_subject, plain_body, subject, body), processed_order(sender, plain_subject, plain_body, body), received_order(sender, F.col("__lower_subject"), F.col("__lower_body")))
    # exploded, so that an order is read once, however many of its fields are asked for
    return texts.withColumn("order", F.explode(F.filter(F.array(read), lambda o: o.isNotNull()))).drop("__subject", "__body", "__lower_subject", "__lower_body")
