"""Messages of four shops about whole orders, one for each order, written from its items.

Which shop an order is from and in which form it is written follow from its
key; some forms must not be accepted: a wrong sum, a stranger's domain,
numbers that differ, a missing disclaimer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

SHOPS = ("limone", "gymbeam", "allegro", "jatekbolt")
#: Forms of a message, by number.
PLAIN, PAID_BY_CARD, WRONG_SUM, BROKEN_PRODUCT, STRANGER, OTHER_NUMBER, ON_DELIVERY, SPECIAL = range(8)
SHIPPING, FEE, DISCOUNT = 990, 490, 1500


def spaced(x: Column) -> Column:
    """A whole number with its thousands apart."""
    return F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))


def _if(form: int, yes: Column | str, no: Column | str = "") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(F.col("form") == form, as_column(yes)).otherwise(as_column(no))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, form, items: of each order its items (name, sku, quantity, unit, total) in order; an item costs whole forints."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    quantity = F.col("l_quantity").cast("int")
    unit = F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long")
    each = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", unit.alias("unit"), quantity.alias("quantity"), F.concat(F.col("p_name"), F.lit(" no "), F.col("l_linenumber")).alias("name"), F.lpad(F.col("l_partkey").cast("string"), 7, "0").alias("sku"), (unit * quantity).alias("total")).alias("item")
    )
    by_order = each.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.join(by_order, "id").withColumn("form", F.floor(F.col("id") / 4) % 8)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, address, subject, body."""
    o = items(spark, sf_dir).withColumn("number", F.lpad(F.col("id").cast("string"), 8, "0")).withColumn("sum", F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + i["total"]))
    number = F.col("number")
    wrong = _if(WRONG_SUM, F.lit(1), F.lit(0))
    lines = lambda f: F.array_join(F.transform("items", f), "")
    first = lambda i, yes, no: F.when((F.col("form") == BROKEN_PRODUCT) & (i == 0), yes).otherwise(no)
    ft = lambda x: F.concat(spaced(x), F.lit(" Ft\n"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    uuid = F.regexp_replace(F.md5(F.col("id").cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    pay = _if(ON_DELIVERY, "Utánvét", "Bankkártya")
    limone = text(
        "Webáruházunkban rendelést adott le.\nEz egy automata visszaigazolás a megrendelés leadásáról.\nAzonosító\n2024-", _if(OTHER_NUMBER, text("9", number), number), "\n",
        lines(lambda x, i: text(x["name"], _if(SPECIAL, text(" [URL: https://limone.hu/p/", x["sku"], "]")), " (SKU-", x["sku"], ")\n", first(i, F.lit("egyedi ár\n"), ft(x["unit"])), x["quantity"].cast("string"), " db\n\n", ft(x["total"]))),
        "Kedvezmény akció\n-", ft(F.lit(DISCOUNT)), "Összesen\n", ft(F.col("sum")), "Szállítási költség\n", ft(F.lit(SHIPPING)), "Végösszeg\n", ft(F.col("sum") + SHIPPING - DISCOUNT + wrong), "Fizetési mód\n", pay, "\nSzállítási mód\nExpress One futárszolgálat\n",
    )
    total = F.col("sum") + SHIPPING + wrong + _if(ON_DELIVERY, F.lit(FEE), F.lit(0))
    gymbeam = text(
        "Szia!\nMegkaptuk a rendelésedet!\nA ", number, " számú rendelésed már készül.\nRendelési összesítő:\n", lines(lambda x, i: text(x["quantity"].cast("string"), "x ", x["name"], "\nÍzesítés: csokoládé\n", first(i, F.lit(""), ft(x["total"])))),
        "Szállítás: ", ft(F.lit(SHIPPING)), _if(ON_DELIVERY, text("Utánvét: ", ft(F.lit(FEE)))), "Szállítási mód: Express One\nFizetési mód: ", pay, "\nBruttó összeg: ", ft(total), "Szállítási cím: Budapest",
    )
    gymbeam = _if(SPECIAL, F.replace(gymbeam, F.lit("\n"), F.lit(" ")), gymbeam)
    offer = lambda x: text(x["name"], " [URL: https://allegro.hu/ajanlat/", F.replace(x["name"], F.lit(" "), F.lit("-")), "-", x["sku"], "?q=1]\n", ft(x["total"]))
    allegro = text(
        "Megvásároltad ", F.size("items").cast("string"), " terméket Bolt ", number, " eladótól\n", lines(lambda x, i: first(i, text(x["name"], " [URL: https://allegro.hu/kategoria/", x["sku"], "]\n", ft(x["total"])), text(offer(x), _if(SPECIAL, offer(x))))),
        "ÖSSZESEN ", ft(F.col("sum") + SHIPPING), "Fizetési mód\n", pay, "\nFutár ", _if(ON_DELIVERY, "utánvét "), "DPD ", ft(F.lit(SHIPPING)), "Megrendelés száma ", uuid, "\n",
    )
    jatekbolt = text(
        "Kedves Vásárló!\nKöszönjük rendelésed.\n", _if(SPECIAL, "", "Ez az e-mail nem minősül a megrendelés visszaigazolásának, csupán a vételi ajánlat megérkezéséről értesítünk.\n"), "Megrendelésed részletei:\nRendelési szám: ", _if(OTHER_NUMBER, text("9", number), number), "\nTermékek összesen:\n", ft(F.col("sum")),
        "Futárszolgálat DPD:\n", ft(F.lit(SHIPPING)), "Engedmény (27% ÁFA):\n-", ft(F.lit(DISCOUNT)), "Összesen:\n", ft(F.col("sum") + SHIPPING - DISCOUNT + wrong), "Szállítási mód\nFutárszolgálat DPD\nFizetési mód:\n", _if(ON_DELIVERY, "Utánvét", _if(PAID_BY_CARD, "Klarna", "Bankkártya")), "\n",
    )
    shop = F.col("id") % 4

    def by_shop(*each: Column) -> Column:
        # a choice, not a list's element, so that only the own shop's text is written
        return F.when(shop == 0, each[0]).when(shop == 1, each[1]).when(shop == 2, each[2]).when(shop == 3, each[3])

    subject = by_shop(
        text("Automata megrendelés visszaigazolás - 2024-", number), F.when(F.col("form") == OTHER_NUMBER, "Rendelésed úton van").otherwise("Rendelésed feldolgozás alatt van"), text(_if(OTHER_NUMBER, "Értékeld: ", "Megvásároltad: "), F.col("items")[0]["name"]), text("Megrendelési szám: ", number),
    )
    address = text(by_shop(*[F.lit(x) for x in ("rendeles@limone.hu", "info@service.gymbeam.hu", "noreply@allegro.hu", "info@jatekbolt.hu")]), _if(STRANGER, ".attacker.net"))
    return o.select("id", address.alias("address"), subject.alias("subject"), by_shop(limone, gymbeam, allegro, jatekbolt).alias("body"))
