"""Messages of commerce made from the documents, and inbound notifications made from those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: The text of a document is the body of a message; its id picks sender, subject, last lines and markup, so that all of them meet.
SENDERS = (
    "orders@shop.example.com", "noreply@mail.shop.example.com", "info@gls-hungary.com", "news@shop.example.com.attacker.net", "someone@gmail.com", "ertesites@expressone.hu",
    "billing@www.books.example.org.", "track@dpd.hu", "hello@foxpost.hu", "a@b@payments.example.co.uk", "pdf@szamlazz.hu",
)
SUBJECTS = (
    "Order confirmation", "Rendelés visszaigazolás", "Your parcel is delivered", "Exkluzív ajánlat: akciós kollekció", "Árufelvétel státusza", "Számla 2024/117", "Out for delivery: csomag",
    "Newsletter", "Buy again", "Order #AB-1234 confirmed", "Sikeres fizetés", "Kézbesítve", "Re: hello",
)
TAILS = (
    "Thank you for your order. Order number: AB-1234\nTotal: 1.234,50 EUR\nPayment method: card\nShipping method: courier", "Order number: CD/777. We will notify you when it ships. It was shipped today!",
    "Tracking number: GLS12345678 label created", "Tracking number: DPD99887766 out for delivery", "shop now, exclusive offer, limited time", "A kosarad tartalma ez volt", "rögzített árufelvétel, request_curier",
    "Invoice number: INV-2024-55\nOrder number: EF-91\nszamla", "Blue kettle | qty: 2 | 12 990 Ft\nTea cup | quantity: 1 | 4.50 EUR\nTotal | qty: 1 | 30 EUR", "On Monday Ann wrote:\n> old text\nmore",
    "From: a@b.c\nTo: d@e.f\nSubject: old\nquoted", "> quoted only\nfresh line\n\n\n\nend", "---- Original Message ----\nold",
    "We have received your order\nOrder no. XY77\norder summary\nPayment method\ncash on delivery\nTotal: 12 500 Ft", "SimplePay tranzakció azonosító: 55501\nKereskedő: www.shop.example.com\nFizetett összeg: 12990 Ft\nsikeres fizetés megtörténését igazolja\nOnline rendelés adatai:",
    "Fizetés Barion azonosítója: B-77\nSikeresen fizettél 4500 Ft\nElfogadóhely neve: Tea Bolt\nEmail: hello@teabolt.example.hu", "nothing here",
    # every label, in the languages of the shops, and rows of products in either form
    "Thank you for your order\nOrder number: A-1001\nGrand total: EUR 1,234.50\nPayment: PayPal\nDelivery method: courier", "Vielen Dank für Ihre Bestellung\nBestellnummer: DE-77120\nGesamtbetrag: 49,90 €\nZahlungsart: Rechnung\nVersandart: DHL\nBestellübersicht", "Bestellbestätigung\nAuftragsnummer 556677\nGesamtsumme 12,00 EUR\nTeekanne x 2 12,00 EUR",
    "Merci pour votre commande\nNuméro de commande : FR-9081\nTotal TTC : 89,00 €\nMode de paiement : carte\nMode de livraison : point relais\nDétails de la commande", "Confirmation de commande\nCommande n° 7781\nTotal de la commande 15,50 EUR\nMéthode de paiement\ncarte", "Gracias por tu pedido\nPedido n° ES-4410\nTotal del pedido: 35.00 EUR\nMétodo de pago: tarjeta\nMétodo de envío: mensajero\nResumen del pedido",
    "Köszönjük a rendelésedet\nMegrendelés: #HU-3312\nVégösszeg: 12.990 Ft\nFizetési mód: utánvét\nSzállítási mód: futár\nRendelés részletei", "Rendelés visszaigazolás\nRendelésazonosító? rendelés azonosító: none, rendelés azonosító: 88123\nFizetendő\n4 500 Ft\nÖsszesen fizetendő: 4 500 Ft", "We've received your order\norder # 55-12\nAmount due: $ 20.00\nOrder total: GBP 18.00\nTea cup x 3 9.00 GBP\nDiscount x 1 2 GBP",
    # said not to be an acceptance, each in its own way
    "Köszönjük a rendelésed\nRendelésszám: NA-0101\nEz az e-mail nem minősül a megrendelés visszaigazolásának\norder details\npayment: x y", "Thank you for your order. Order number: NA-0102\nEz az üzenet nem minősül megrendelés visszaigazolásának\norder details\npayment: card", "Thank you for your order. Order number: NA-0103\ncsupán a vételi ajánlat beérkezéséről értesítünk\norder details\npayment: card",
    "Thank you for your order. Order number: NA-0104\nA rendelés rögzítése nem jelenti a rendelés elfogadását\norder details\npayment: card", "Thank you for your order. Order number: NA-0105\nEz az automatikus e-mail nem jelent automatikus szerződéskötést\norder details\npayment: card", "Thank you for your order. Order number: NA-0106\nEz a visszaigazolás nem jelenti a szerződés létrejöttét\norder details\npayment: card",
    "Thank you for your order. Order number: NA-0107\nEz az értesítés nem jelenti a vételi ajánlat elfogadását\norder details\npayment: card", "Thank you for your order. Order number: NA-0108\ncsak azt igazolja, hogy a rendelést megkaptuk\norder details\npayment: card", "Thank you for your order. Order number: NA-0109\nThis email does not constitute acceptance of your order\norder details\npayment: card",
    "Thank you for your order. Order number: NA-0110\nThis message is not an order confirmation\norder details\npayment: card", "Thank you for your order. Order number: NA-0111\nThis acknowledgement does not mean that a contract has been concluded\norder details\npayment: card", "We have received your order. Order number: NA-0112\nYour order has not yet been accepted\norder details\npayment: card",
    "We have received your order, but it has not been accepted. Order number: NA-0113\norder details\npayment: card", "Thank you for your order. Order number: NA-0114\nIt merely acknowledges receipt of your order request\norder details\npayment: card",
    # later news of orders and parcels, by phase; some only promised, some only quoted
    "A rendelésed sikeresen kézbesítve\nRendelésszám: LC-2201", "Csomagod már átvehető a csomagautomatában\nCsomagszám: HU12345678", "LC2203 - megrendelésed a kézbesítőnél van\nout for delivery", "Csomagodat ma átadtuk a GLS futárnak\nrendelés #LC-2204\nNyomkövetési szám: GL99887766", "Your order is on its way with our courier. Order no. LC-2205",
    "Számlád elkészült. #LC-2206 számú rendeléshez\nSzámla SZ-2024/9\nYour order has been shipped", "We will notify you when your order has been shipped. Order number: LC-2207\n> Your order was delivered", "Your order is in transit. Order id LC-2208",
)
MARKUP = (
    '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Order","acceptedOffer":{"@type":["Offer","https://schema.org/Product"],"name":"x"},"orderDelivery":[{"@type":"ParcelDelivery"}]}</script>',
    '<div itemscope itemtype="https://schema.org/Invoice http://schema.org/Thing">', '<script type=application/ld+json>{broken "@type":"Order"}</script>', '<script type="application/ld+json"><!-- {&quot;@type&quot;:&quot;http://schema.org/TrackAction&quot;} --></script>', "",
    '<p>a &amp; b &#233; &#x1F600; &quot;q&quot; &amp;#65; &unknown;</p><br>x<hr/>y<style>p{}</style><script>var a="<b>";</script><!-- c -->', "<span itemtype=http://schema.org/Offer>",
)
AUTHENTICATION = (
    "mx.example.net; dkim=pass header.i=@shop.example.com header.d=shop.example.com; spf=pass", "mx; dkim=fail header.d=evil.example; dkim=pass header.i=news@mail.example.org", "mx; dkim=none", "mx;dkim = pass (ok) header.d=WWW.Books.example.org; dmarc=pass", "dkim=pass header.b=abc",
)
FILES = ("invoice.pdf", "photo.jpg", "szamla-117.PDF", "terms", "")
FOLDERS = ("INBOX", "category_purchases", "SPAM")


def picked(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, address, subject, body, html, folders, attachments, headers: one message for each document."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    body = F.concat_ws("\n", F.coalesce("text", F.lit("")), picked(TAILS, i))
    subject = picked(SUBJECTS, i)
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.array(
        header("Authentication-Results", picked(AUTHENTICATION, i)), header("ARC-Authentication-Results", picked(AUTHENTICATION, i + 1)), header("Return-Path", F.concat(F.lit("<"), picked(SENDERS, i), F.lit(">"))),
        header("Received", F.concat(F.lit("from Mail"), (i % 3).cast("string"), F.lit(".Example.net by mx"))), header("received", F.lit("by local")),
    )
    return d.select(i.alias("id"), (i % 40).alias("user_id"), picked(SENDERS, i).alias("address"), subject.alias("subject"), body.alias("body"), F.concat(F.lit("<h1>"), subject, F.lit("</h1><p>"), body, F.lit("</p>"), picked(MARKUP, i)).alias("html"), F.array(picked(FOLDERS, i)).alias("folders"), F.array(picked(FILES, i)).alias("attachments"), headers.alias("headers"))


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def _pick(values: tuple[str, ...], by: str = "doc_id") -> str:
    return f"({listed(values)})[({by}) % {len(values)} + 1]"


#: The same rows in DuckDB.
MESSAGES_SQL = f"""
    msg AS (SELECT id, user_id, address, subject, body, '<h1>' || subject || '</h1><p>' || body || '</p>' || markup AS html, folders, attachments, auth, auth_2 FROM
        (SELECT doc_id AS id, doc_id % 40 AS user_id, {_pick(SENDERS)} AS address, {_pick(SUBJECTS)} AS subject, coalesce(text, '') || chr(10) || {_pick(TAILS)} AS body, {_pick(MARKUP)} AS markup,
                [{_pick(FOLDERS)}] AS folders, [{_pick(FILES)}] AS attachments, {_pick(AUTHENTICATION)} AS auth, {_pick(AUTHENTICATION, "doc_id + 1")} AS auth_2 FROM documents))"""

NOTIFICATION = "notificationType string, mail struct<messageId:string,timestamp:timestamp,destination:array<string>,commonHeaders:struct<subject:string,from:array<string>>>, receipt struct<recipients:array<string>,spamVerdict:struct<status:string>,virusVerdict:struct<status:string>>"
#: The longest subject that is kept, and the most attachments and recipients.
SUBJECT_CHARACTERS, MOST_PARTS = 998, 50


def verdict(value: Column) -> Column:
    """PASS, FAIL, GRAY or PROCESSING_FAILED; anything else is unknown."""
    up = F.upper(value)
    return F.when(up.isin("PASS", "FAIL", "GRAY", "PROCESSING_FAILED"), up).otherwise("UNKNOWN")


def inbound(raw: DataFrame, own_domain: str, column: str = "value") -> DataFrame:
    """message_id, subject, sender, recipients, spam, virus of the gateway's notifications that have an id and a recipient of ``own_domain``.

    Recipients are those of the receipt and the destinations, lower-cased,
    each once.  Subjects and lists are clipped; what is no JSON is left out.
    """
    n = raw.select(F.from_json(column, NOTIFICATION).alias("n")).where("n.mail.messageId is not null").select("n.*")
    empty = F.array().cast("array<string>")
    named = F.transform(F.concat(F.coalesce("receipt.recipients", empty), F.coalesce("mail.destination", empty)), lambda r: F.lower(F.trim(r)))
    own = F.slice(F.array_distinct(F.filter(named, lambda r: r.endswith(f"@{own_domain}"))), 1, MOST_PARTS)
    return n.select(F.col("mail.messageId").alias("message_id"), F.left(F.trim("mail.commonHeaders.subject"), F.lit(SUBJECT_CHARACTERS)).alias("subject"), F.try_element_at("mail.commonHeaders.from", F.lit(1)).alias("sender"), own.alias("recipients"), verdict(F.col("receipt.spamVerdict.status")).alias("spam"), verdict(F.col("receipt.virusVerdict.status")).alias("virus")).where(F.size("recipients") > 0)


#: Notices of single senders, each in a form that its program takes and some in one that it must not; {n} is a number.
NOTICES = (
    ("csomag@posta.hu", "Csomagot adtak fel neked", "Értesítünk, hogy csomagot adtak fel Neked.\nFeladó: Tea Bolt Kft\nCsomagazonosító: [ PNTM{n}0"), ("csomag@posta.hu", "Csomagod a kézbesítőnél van", "A csomagod a kézbesítőnél van\nFeladó: X Bt\nCsomagazonosító: PNTM{n}1"), ("csomag@posta.hu", "Csomagod a postán átvehető", "Csomagod mostantól\nátvehető az alábbi postán\nFeladó: Y\nCsomagazonosító: PNTM{n}2"),
    ("other@posta.hu", "Csomagot adtak fel neked", "Értesítünk, hogy csomagot adtak fel Neked.\nFeladó: Z Z\nCsomagazonosító: PNTM{n}3"), ("info@foxpost.hu", "Előértesítés csomagról", "még nem adták át a Foxpost részére\nFeladó: Bolt\nCsomagszám: CLFOX{n}"), ("info@mail.foxpost.hu", "Csomagod megérkezett", "megérkezett, amely átvehető. Csomagátvétel határideje: holnap\nFeladó: Bolt\nCsomagszám: CLFOX{n}"), ("info@foxpost.hu", "Csomagod megérkezett", "megérkezett\nFeladó: Bolt\nCsomagszám: CLFOX{n}"),
    ("hello@gyerekjatekbolt.hu", "Fizetés", "Sikertelen bankkártyás fizetés. Rendelésszám: #{n}"), ("hello@gyerekjatekbolt.hu", "Állapot", "Jelenlegi állapot: törölve\nRendelésszám: {n}"), ("x@gymbeam.hu", "Ellenőrizzük a kézbesítést", "A 10{n} rendelése késik."), ("x@gymbeam.hu", "Megrendelésed úton van", "Becsomagoltuk! Hamarosan a futárszolgálat kezébe kerül. A 10{n} számú rendelésed. A TRK-{n}-77 számmal követheted a csomagot"),
    ("rendeles@marketa.hu", "{n} rendelésed: elkezdtük rendelésed összekészítését", "raktárunk már elkezdte becsomagolni és 1-2 munkanapon belül átadja azt a futárszolgálatnak"), ("a@dorko.hu", "Dorko: Rendelés elküldve", "Megrendelése feladásra került a megadott címre. Rendelés azonosító: DK{n}"), ("a@fakedorko.hu", "Dorko: Rendelés elküldve", "Megrendelése feladásra került a megadott címre. Rendelés azonosító: DK{n}"), ("b@aboutyou.hu", "Szállítási információk: AYHU-123-{n}", "Szállítás megerősítése\nA csomag úton van"),
    ("c@alza.hu", "Vedd át 123{n} sz. megrendelésed", "Megrendelésed megérkezett az AlzaBoxba. 123{n} sz. megrendelésed"), ("c@alza.hu", "Vedd át 123{n} sz. megrendelésed", "Megrendelésed megérkezett az AlzaBoxba. 999{n} sz. megrendelésed"), ("szidibox@gmail.com", "SO-2024-{n} Megrendelését összekészítettük", "kartonshop.hu: összekészítettük és hamarosan átadjuk a futárszolgálat részére. Rendelésszám: SO-2024-{n}"), ("slip@expressone.hu", "Fizetési bizonylat", "Status: success\nTransaction type: Vásárlás\nTotal HUF: 12 990"), ("slip@expressone.hu", "Fizetési bizonylat", "Status: declined\nTransaction type: Vásárlás\nTotal HUF: 12 990"),
)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, address, subject, body: one notice for each event."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    n = F.concat(F.lit("1"), F.lpad(i.cast("string"), 6, "0"))
    part = lambda k: F.replace(picked(tuple(x[k] for x in NOTICES), i), F.lit("{n}"), n)
    return e.select(i.alias("id"), part(0).alias("address"), part(1).alias("subject"), part(2).alias("body"))


_PARTS = ", ".join(f"replace({_pick(tuple(x[k] for x in NOTICES), 'event_id')}, '{{n}}', '1' || lpad(CAST(event_id AS VARCHAR), 6, '0')) AS {name}" for k, name in enumerate(("address", "subject", "body")))
NOTICES_SQL = f"nt AS (SELECT event_id AS id, {_PARTS} FROM events)"
