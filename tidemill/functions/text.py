"""Text functions, all built from Spark's own."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bases() -> dict[str, str]:
    """Letters of the Latin blocks that Unicode decomposes into one character and marks, and that character."""
    found = {}
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            found[c] = base
    return found


_FOLDED = _bases()
#: Marks that stand by themselves are deleted.
ACCENTED, PLAIN = "".join(_FOLDED) + "".join(map(chr, range(0x300, 0x370))), "".join(_FOLDED.values())

# fixed values: carriers and the domains that they send from
CARRIERS = {
    "Express One": ("expressone.hu",),
    "GLS": ("gls-hungary.com", "gls-group.com", "gls.hu"),
    "DPD": ("dpd.com", "dpd.hu"),
    "Foxpost": ("foxpost.hu",),
    "Packeta": ("packeta.hu", "packeta.com"),
    "DHL": ("dhl.com", "dhl.hu"),
    "UPS": ("ups.com",),
    "MPL": ("posta.hu",),
    "XLS Futár": ("xlsfutar.hu",),
}
# fixed values: public mailboxes, matched whole
PUBLIC_MAILBOXES = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "yahoo.co.uk", "yahoo.de", "yahoo.fr", "ymail.com", "icloud.com",
    "me.com", "mac.com", "proton.me", "protonmail.com", "gmx.com", "gmx.net", "mail.com", "aol.com", "freemail.hu", "citromail.hu", "indamail.hu", "vipmail.hu",
)
# fixed values: types of structured markup that belong to commerce
COMMERCE_TYPES = ("Order", "ParcelDelivery", "Invoice", "Product", "Offer", "OrderAction", "TrackAction", "DeliveryEvent", "ReceiveAction", "ReturnAction", "CancelAction")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value made once a row, however often the body asks for it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without accents; a translate, so it stays in generated code.  ASCII alone needs none."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.lower(F.translate(text, ACCENTED, PLAIN)))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text matches one of the patterns, in one pass: those that begin at the edge of a word look for it together."""
    edge = r"\b"
    inner = [f"(?:{p[len(edge):]})" for p in patterns if p.startswith(edge)]
    others = [f"(?:{p})" for p in patterns if not p.startswith(edge)]
    return text.rlike("|".join([edge + f"(?:{'|'.join(inner)})"] * bool(inner) + others))


def text_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def identifier(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^a-zA-Z0-9]", ""))


def domain(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^www\.", ""), r"\.$", "")


def url_domain(url: Column) -> Column:
    return domain(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def address_domain(address: Column, last: bool = True) -> Column:
    """After the last @, or after the first up to the next."""
    return F.lower(F.substring_index(address, "@", -1) if last else F.split_part(address, F.lit("@"), F.lit(2)))


def in_domain(name: Column, trusted: Column | str) -> Column:
    """Equal, or a subdomain; look-alikes that only end alike don't count."""
    trusted = F.lit(trusted) if isinstance(trusted, str) else trusted
    return (name == trusted) | name.endswith(F.concat(F.lit("."), trusted))


def sender_role(name: Column) -> Column:
    carrier = None
    for trusted in CARRIERS.values():
        for d in trusted:
            carrier = in_domain(name, d) if carrier is None else carrier | in_domain(name, d)
    return F.when(carrier, "carrier").when(name.isin(*PUBLIC_MAILBOXES), "public").otherwise("unknown")


def carrier_slug(name: Column) -> Column:
    low = F.lower(name)
    slug = F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = F.when(low.contains("express"), "express-one")
    for known in ("dpd", "gls", "foxpost", "packeta"):
        out = out.when(low.contains(known), known)
    return out.when(low.rlike(r"(^|[^a-z0-9_])mpl([^a-z0-9_]|$)") | low.contains("magyar posta logisztika"), "mpl").otherwise(F.nullif(slug, F.lit("")))


def compact_party(name: Column) -> Column:
    """A company's name without legal form and separators."""
    return F.regexp_replace(F.regexp_replace(fold(name), r"(^|[^a-z])(kft|zrt|nyrt|bt|ltd|gmbh|inc|llc)([^a-z]|$)", " "), "[^a-z0-9]+", "")


# fixed values: legal forms at the end of a company's name
LEGAL_FORMS = ("kft", "zrt", "nyrt", "bt", "rt", "gmbh", "ltd", "llc", "inc", "ag", "sro", "as", "oy", "ab")


def one_edit(a: Column, b: Column) -> Column:
    """Equal, or one edit apart where both have four letters or more."""
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= 1) & (F.least(F.length(a), F.length(b)) >= 4) & (F.levenshtein(a, b) <= 1))


def same_party(a: Column, b: Column) -> Column:
    """Whether two text keys name one party.

    Equal; one in the other where both have five letters; or, without legal
    forms, as many words (two at least) of which one is one edit apart and
    the others are equal.
    """
    long = (F.length(a) >= 5) & (F.length(b) >= 5)
    forms = rf"^(.+?)(?: (?:{'|'.join(LEGAL_FORMS)}))*$"
    x, y = (F.split(F.regexp_extract(k, forms, 1), " ") for k in (a, b))
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    alike = (F.size(x) >= 2) & (F.size(x) == F.size(y)) & F.forall(pairs, lambda p: one_edit(p["x"], p["y"])) & (F.size(F.filter(pairs, lambda p: p["x"] != p["y"])) == 1)
    return (a != "") & (b != "") & ((a == b) | (long & (a.contains(b) | b.contains(a))) | alike)


def html_text(html: Column) -> Column:
    """Text of a page: no comments, scripts, styles and tags; blocks end lines, white space collapses."""
    for pattern, by in ((r"(?s)<!--.*?-->", " "), (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n"), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"[ \t]+", " "), (r" ?\n[ \n]*", "\n")):
        html = F.regexp_replace(html, pattern, by)
    return F.trim(html)


def plain_text(html: Column) -> Column:
    """Roughly the text of a page, for filters: no scripts, styles and tags."""
    for pattern, by in ((r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), (r"<[^>]+>", " "), (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&")):
        html = F.regexp_replace(html, pattern, by)
    return html


#: Entities that are decoded; others stay.
ENTITY = r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[aA][mM][pP]|[aA][pP][oO][sS]|[gG][tT]|[lL][tT]|[nN][bB][sS][pP]|[qQ][uU][oO][tT]);"


def decode_entities(text: Column) -> Column:
    """Named and numeric entities as characters, each once."""
    named = F.create_map(*[F.lit(x) for pair in {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}.items() for x in pair])

    def char(e: Column) -> Column:
        code = F.when(F.lower(F.substring(e, 2, 1)) == "x", F.conv(F.substring(e, 3, 9), 16, 10)).otherwise(F.substring(e, 2, 9)).cast("int")
        return F.when(e.startswith("#"), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(named[F.lower(e)])

    parts = F.split(text, ENTITY, -1)
    chars = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)), char)
    return F.array_join(F.flatten(F.zip_with(parts, chars, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), "")


def protocol_text(html: Column) -> Column:
    """Text of a page, lines kept: no comments, styles, scripts and tags, entities decoded."""
    for pattern, by in ((r"(?s)<!--.*?-->", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?is)<script\b.*?</script>", " "), (r"(?i)<(?:br|hr)\b[^>]*>", "\n"), (r"(?i)</(?:p|div|li|tr|h[1-6])>", "\n"), (r"<[^>]+>", " ")):
        html = F.regexp_replace(html, pattern, by)
    return F.trim(F.regexp_replace(F.regexp_replace(decode_entities(html), r"[\t\r ]+", " "), r" *\n+ *", "\n"))


JSON_LD = r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
TYPE_KEY, STRING = r'"@type"\s*:\s*("[^"\\]*"|\[[^\[\]{}]*\])', r'"([^"\\]+)"'


def json_ld(html: Column) -> Column:
    """The blocks of JSON-LD, entities decoded, those left out that are no JSON."""
    blocks = F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))
    decoded = F.transform(blocks, lambda b: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(b), "(?i)&quot;|&#34;", '"'), "(?i)&apos;|&#39;", "'"), "(?i)&amp;", "&"), r"^<!--\s*|\s*-->$", "")))
    return F.filter(decoded, lambda b: F.try_parse_json(b).isNotNull())


def type_names(urls: Column) -> Column:
    return F.transform(urls, lambda t: F.regexp_extract(t, r"([^/#]+)[/#]*$", 1))


def json_ld_types(html: Column) -> Column:
    """Every ``@type`` at any depth of the JSON-LD blocks, single or in a list, sorted."""
    keys = F.flatten(F.transform(json_ld(html), lambda b: F.regexp_extract_all(b, F.lit(TYPE_KEY), F.lit(1))))
    names = F.flatten(F.transform(keys, lambda k: F.regexp_extract_all(k, F.lit(STRING), F.lit(1))))
    return F.array_sort(F.array_distinct(type_names(names)))


def item_types(html: Column) -> Column:
    """Types of microdata of the common vocabulary, sorted."""
    values = F.regexp_extract_all(html, F.lit(r"(?i)\bitemtype\s*=\s*[\"']?([^\"'>]+)"), F.lit(1))
    urls = F.filter(F.flatten(F.transform(values, lambda v: F.split(v, r"\s+"))), lambda u: F.lower(u).contains("schema.org"))
    return F.array_sort(F.array_distinct(type_names(urls)))


def markup_types(html: Column) -> Column:
    """Commerce types named in structured markup, sorted."""
    return F.array_sort(F.array_intersect(F.array_union(json_ld_types(html), item_types(html)), F.array(*[F.lit(t) for t in COMMERCE_TYPES])))


# fixed values: lines that begin what a reply quotes
HISTORY = (r"(?i)^\s*-{2,}\s*(?:original message|eredeti uzenet|forwarded message|tovabbitott uzenet)\s*-{2,}\s*$", r"(?i)^\s*begin forwarded message\s*:\s*$", r"(?i)^\s*on\s+.{1,300}\s+wrote\s*:\s*$", r"(?i)^\s*.{1,300}\bezt\s+irta\s*:\s*$")


def without_history(text: Column) -> Column:
    """A folded reply without what it quotes.

    That is what follows a separator or a quoted head (a sender, and within
    eight lines a recipient and a subject), and lines that begin with >.
    """
    low = F.lower(text)
    # no line begins a quotation without these; most texts lack them
    marked = (low.contains("--") & has_any(low, ("message", "uzenet"))) | has_any(low, ("begin", "wrote", "irta")) | (has_any(low, ("from", "felado")) & has_any(low, ("to", "cimzett")) & has_any(low, ("subject", "targy")))
    own = lambda lines: F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^\s*>")), "\n")
    lines = F.split(text, "\r?\n")
    fresh = F.when(marked, let(lines, lambda ls: own(_before_history(ls)))).when(text.contains(">"), own(lines)).otherwise(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    return F.trim(F.regexp_replace(fresh, r"\n{3,}", "\n\n"))


def _before_history(lines: Column) -> Column:
    separator = F.transform(lines, lambda x: any_of(x, HISTORY))
    ahead = lambda i, p: F.exists(F.slice(lines, i + 1, 8), lambda x: x.rlike(p))
    head = F.transform(lines, lambda x, i: x.rlike(r"^\s*(?:from|felado)\s*:") & ahead(i, r"^\s*(?:to|cimzett)\s*:") & ahead(i, r"^\s*(?:subject|targy)\s*:"))
    stops = F.zip_with(separator, head, lambda a, b: a | b)
    stop = F.coalesce(F.nullif(F.array_position(stops, True), F.lit(0)) - 1, F.size(lines))
    return F.slice(lines, F.lit(1), stop.cast("int"))


def labelled_line(text: Column, labels: tuple[str, ...]) -> Column:
    """What stands after the first label and its sign, or else on the line after it."""
    found = []
    for label in labels:
        for pattern in (rf"(?:^|\n)\s*{label}\s*[:#-]\s*([^\n]{{2,120}})", rf"(?:^|\n)\s*{label}\s*\n\s*([^\n]{{2,120}})"):
            found.append(F.when(text.contains(label), F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))))  # most texts lack the label
    return F.coalesce(*found)


# fixed values: second-level names that belong to a country's suffix
SECOND_LEVEL = ("co", "com", "net", "org", "gov", "edu")


def merchant_name(host: Column, countries: bool = True) -> Column:
    """A merchant's name from its domain: short words are initials, longer ones begin with a capital."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    last, second, third = (F.try_element_at(labels, F.lit(-k)) for k in (1, 2, 3))
    plain = F.coalesce(second, last, host)
    root = F.when((F.length(last) == 2) & second.isin(*SECOND_LEVEL) & third.isNotNull(), third).otherwise(plain) if countries else plain
    words = F.transform(F.filter(F.split(root, "[-_]+"), lambda w: w != ""), lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1000))))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), host)


def header_domains(headers: Column) -> Column:
    """dkim, return_path and transport of a message's headers (name, value): domains that passed, of the return path, and hosts it came from."""
    values = lambda *names: F.transform(F.filter(headers, lambda h: F.lower(h["name"]).isin(*names)), lambda h: h["value"])
    passed = F.flatten(F.transform(values("authentication-results", "arc-authentication-results"), lambda v: F.regexp_extract_all(v, F.lit(r"(?i)(?:^|;)\s*dkim\s*=\s*pass\b([^;]*)"), F.lit(1))))
    found = F.flatten(F.transform(passed, lambda v: F.concat(F.regexp_extract_all(v, F.lit(r"(?i)\bheader\.d\s*=\s*([^\s;]+)"), F.lit(1)), F.regexp_extract_all(v, F.lit(r"(?i)\bheader\.i\s*=\s*@?([^\s;]+)"), F.lit(1)))))
    after_at = lambda x: domain(F.regexp_replace(F.substring_index(x, "@", -1), "[<>]", ""))
    hosts = F.transform(values("received"), lambda v: F.nullif(F.lower(F.regexp_extract(v, r"(?i)\bfrom\s+([a-z0-9._-]+\.[a-z0-9._-]+)\b", 1)), F.lit("")))
    paths = F.transform(F.filter(values("return-path"), lambda v: v.contains("@")), after_at)
    return F.struct(F.array_distinct(F.transform(found, after_at)).alias("dkim"), F.array_distinct(paths).alias("return_path"), F.array_distinct(F.array_compact(hosts)).alias("transport"))


def money(text: Column) -> Column:
    """An amount with either separator: the last of comma and point is decimal if one or two digits follow."""
    digits = F.regexp_replace(text, r"[^0-9.,]", "")
    decimal = digits.rlike(r"[.,][0-9]{1,2}$")
    whole = F.regexp_replace(F.regexp_replace(digits, r"[.,][0-9]{1,2}$", ""), r"[.,]", "")
    part = F.when(decimal, F.regexp_extract(digits, r"[.,]([0-9]{1,2})$", 1)).otherwise("0")
    return F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), part).try_cast("decimal(14,2)")


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches and has a digit in it."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*[F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"[.,;:]+$", "")) for x in found])


def reasons(*pairs: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))


def dedupe_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC-SHA256 of a text in lower-case hex, by two hashes: it stays in generated code."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def file_kind(name: Column) -> Column:
    """The letters and digits after a file name's last point, none without."""
    clean = F.regexp_replace(F.lower(F.trim(name)), "[?#].*$", "")
    ending = F.left(F.regexp_replace(F.substring_index(clean, ".", -1), "[^a-z0-9]", ""), F.lit(12))
    return F.when(~clean.contains(".") | clean.endswith("."), "none").otherwise(F.coalesce(F.nullif(ending, F.lit("")), F.lit("other")))


#: A link with an absolute address of 500 characters at most, what goes beyond them dropped; and one without a label.
LINK = r"""(?is)<a\b[^>]*href\s*=\s*["'](http:[^"']{1,495}|https:[^"']{1,494})[^"']*["'][^>]*>(.*?)</a>"""
BARE_LINK = r"""(?is)<a\b[^>]*href\s*=\s*["'](http:[^"']{1,495}|https:[^"']{1,494})[^"']*["'][^>]*>(?:\s|&nbsp;|<[^>]*>)*</a>"""
# fixed values: what is replaced after links, in order
COMPACT = (
    (r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<br\s*/?\s*>", "\n"), (r"(?i)</p\s*>", "\n"), (r"(?i)</tr\s*>", "\n"), (r"(?i)</li\s*>", "\n"), (r"<[^>]+>", " "),
    (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&quot;", '"'), ("&#39;", "'"), (r"[ \t]+", " "), (r"\n\s*\n+", "\n"),
)


def compact_text(html: Column, most: int | None = None) -> Column:
    """Text of a page with the addresses of its links, ``most`` characters of it if asked."""
    html = F.regexp_replace(html, BARE_LINK, "link [URL: $1]")
    html = F.regexp_replace(html, LINK, "$2 [URL: $1]")
    for pattern, by in COMPACT:
        html = F.regexp_replace(html, pattern, by)
    return F.trim(html) if most is None else F.left(F.trim(html), F.lit(most))
