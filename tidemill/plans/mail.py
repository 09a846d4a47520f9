"""Queries over messages: filters, rules, parsers, guard rails and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commerce as C
from ..functions import text as T
from ..operators import programs as P
from ..operators import rules as R
from ..operators import validate as V
from ..sources.mail import MESSAGES_SQL, NOTICES_SQL, inbound, listed, lit, messages, notices
from ..sources.messages import disposition
from ..sources.tables import table
from .registry import query

M = f"WITH {MESSAGES_SQL}"


#: A secret of the tests, and its two pads in hex, by which DuckDB makes the same HMAC.
SECRET = b"a shared secret"
SQL_PADS = {k: "'" + bytes(b ^ v for b in SECRET.ljust(64, b"\0")).hex() + "'" for k, v in {"i": 0x36, "o": 0x5C}.items()}


# how the functions read in DuckDB


def _fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def _any(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {lit(p)})" for p in patterns) + ")"


def _chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, {lit(pattern)}, {by}, 'g')"
    return x


_DOMAIN = r"regexp_replace(regexp_replace(lower(trim(string_split(address, '@')[-1])), '^www\.', ''), '\.$', '')"


def _in_domain(x: str, d: str) -> str:
    return f"({x} = {lit(d)} OR ends_with({x}, {lit('.' + d)}))"


def sql_role(x: str) -> str:
    carriers = " OR ".join(_in_domain(x, d) for own in T.CARRIERS.values() for d in own)
    return f"CASE WHEN {carriers} THEN 'carrier' WHEN {x} IN ({', '.join(map(lit, T.PUBLIC_MAILBOXES))}) THEN 'public' ELSE 'unknown' END"


def _identity(x: str, patterns, every: bool = False) -> str:
    if every:
        clean = r"regexp_replace(v, '[.,;:)]+$', '')"
        return "coalesce(" + ", ".join(f"list_filter(list_transform(regexp_extract_all({x}, {lit(p)}, 1), lambda v: {clean}), lambda v: regexp_matches(v, '[0-9]'))[1]" for p in patterns) + ")"
    each = [rf"regexp_replace(nullif(regexp_extract({x}, {lit(p)}, 1), ''), '[.,;:)]+$', '')" for p in patterns]
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({e}, '[0-9]') THEN {e} END" for e in each) + ")"


def _line(x: str, labels) -> str:
    each = []
    for label in labels:
        for p in (rf"(?:^|\n)\s*{label}\s*[:#-]\s*([^\n]{{2,120}})", rf"(?:^|\n)\s*{label}\s*\n\s*([^\n]{{2,120}})"):
            each.append(f"nullif(trim(regexp_extract({x}, {lit(p)}, 1)), '')")
    return "coalesce(" + ", ".join(each) + ")"


def _currency(x: str) -> str:
    return f"CASE WHEN contains(upper({x}), 'HUF') OR contains(upper({x}), 'FT') THEN 'HUF' WHEN contains(upper({x}), 'EUR') OR contains({x}, '€') THEN 'EUR' WHEN contains(upper({x}), 'USD') OR contains({x}, '$') THEN 'USD' WHEN contains(upper({x}), 'GBP') OR contains({x}, '£') THEN 'GBP' END"


def _amount(x: str, currency: str) -> str:
    v = f"regexp_replace({x}, '[^0-9,.-]', '', 'g')"
    comma, dot = f"instr(reverse({v}), ',')", f"instr(reverse({v}), '.')"
    return f"""CAST(TRY_CAST(nullif(CASE WHEN {comma} > 0 AND {dot} > 0 AND {comma} < {dot} THEN replace(replace({v}, '.', ''), ',', '.') WHEN {comma} > 0 AND {dot} > 0 THEN replace({v}, ',', '')
        WHEN {comma} = 3 THEN replace({v}, ',', '.') WHEN {comma} > 0 THEN replace({v}, ',', '') WHEN {dot} > 0 AND {dot} <> 3 AND {currency} = 'HUF' THEN replace({v}, '.', '') ELSE {v} END, '') AS DECIMAL(14, 2)) AS DOUBLE)"""


def _money(x: str, label: str) -> tuple[str, str]:
    p = lit(rf"(?:^|\n|\b){label}\s*[:#-]?\s*(?:([a-z]{{3}}|€|\$|£)\s*)?{C.AMOUNT}(?:\s*{C.CURRENCY})?")
    part = lambda k: f"regexp_extract({x}, {p}, {k})"
    currency = f"({_currency(f'CASE WHEN regexp_matches({part(1)}, {lit(f"^{C.CURRENCY}$")}) THEN {part(1)} ELSE {part(3)} END')})"
    return _amount(part(2), currency), currency


_PLAIN = _chain("html", (r"(?is)<script\b[^>]*>.*?</script>", "' '"), (r"(?is)<style\b[^>]*>.*?</style>", "' '"), (r"<[^>]+>", "' '"), (r"(?i)&nbsp;", "' '"), (r"(?i)&amp;", "'&'"))
_DECODED = _chain("trim(b)", ("(?i)&quot;|&#34;", "chr(34)"), ("(?i)&apos;|&#39;", "chr(39)"), ("(?i)&amp;", "'&'"), (r"^<!--\s*|\s*-->$", "''"))
_BLOCKS = f"list_filter(list_transform(regexp_extract_all(html, {lit(T.JSON_LD)}, 1), lambda b: trim({_DECODED})), lambda b: json_valid(b))"
_TYPES = "list_transform({}, lambda t: regexp_extract(t, '([^/#]+)[/#]*$', 1))"
#: Every value of a key ``@type`` by a walk over the parsed blocks.
_WALK = f"""
    b AS (SELECT id, unnest({_BLOCKS}) AS block FROM msg),
    w AS (SELECT b.id, unnest(CASE WHEN t.type = 'ARRAY' THEN t.value ->> '$[*]' ELSE [t.value ->> '$'] END) AS url FROM b, json_tree(b.block) t WHERE t.key = '@type' AND t.type IN ('ARRAY', 'VARCHAR')),
    ld AS (SELECT id, list_sort(list(DISTINCT regexp_extract(url, '([^/#]+)[/#]*$', 1))) AS types FROM w GROUP BY 1),
    item AS (SELECT id, list_sort(list_distinct({_TYPES.format("list_filter(flatten(list_transform(regexp_extract_all(html, " + lit(r"(?i)\bitemtype\s*=\s*[" + chr(34) + "']?([^" + chr(34) + "'>]+)") + ", 1), lambda v: regexp_split_to_array(v, '\\s+'))), lambda u: contains(lower(u), 'schema.org'))")})) AS types FROM msg),
    mk AS (SELECT msg.id, coalesce(ld.types, []) AS ld_types, item.types AS item_types, list_sort(list_filter(list_distinct(list_concat(coalesce(ld.types, []), item.types)), lambda t: list_contains({listed(T.COMMERCE_TYPES)}, t))) AS types FROM msg LEFT JOIN ld USING (id) JOIN item USING (id))"""


def _message_texts(m):
    """Messages with their sender's domain and folded texts, each computed once."""
    return m.withColumn("sender", C.sender_domain(F.col("address"))).withColumn("folded_subject", T.fold(F.col("subject"))).withColumn("folded_body", T.fold(F.col("body")))


_TEXTS = f"tx AS (SELECT *, {_DOMAIN} AS sender, {_fold('subject')} AS folded_subject, {_fold('body')} AS folded_body FROM msg)"

_SPOKEN = f"trim(regexp_replace({_fold('subject || chr(10) || ' + _PLAIN)}, '\\s+', ' ', 'g'))"
_RAW = _fold("subject || chr(10) || html")
_SIGNALS = f"""list_filter([CASE WHEN list_contains(list_transform(folders, lambda f: upper(f)), 'CATEGORY_PURCHASES') THEN 'gmail_category_purchases' END, CASE WHEN len(mk.types) > 0 THEN 'structured_commerce_markup' END,
    CASE WHEN {sql_role("sender")} = 'carrier' THEN 'known_carrier_sender' END, CASE WHEN {" OR ".join(f"contains(lower(subject || ' ' || array_to_string(attachments, ' ')), {lit(k)})" for k in C.KEYWORDS)} THEN 'commerce_keyword' END], lambda x: x IS NOT NULL)"""


@query(f"""{M}, {_TEXTS}, {_WALK}, f AS (SELECT tx.id, {_in_domain("sender", C.PICKUP_DOMAIN)} AND regexp_matches({_RAW}, {lit(C.PICKUP_TERM)}) AND ({_any(_RAW, C.PICKUP_URLS)} OR {_any(_RAW, C.PICKUP_WORDS)}) AS pickup,
        NOT {_any(_SPOKEN, C.ANCHORS)} AND ({_any(_SPOKEN, C.REPURCHASE)} OR {" + ".join(f"regexp_matches({_SPOKEN}, {lit(p)})::INT" for p in C.CAMPAIGN)} >= 2) AS promo, {_SIGNALS} AS signals FROM tx JOIN mk USING (id))
    SELECT id, array_to_string(CASE WHEN pickup THEN ['excluded_pickup_service'] WHEN promo THEN ['excluded_promotional_marketing'] ELSE signals END, ',') AS reasons, NOT pickup AND NOT promo AND len(signals) > 0 AS relevant FROM f""")
def noise_filter_reasons(spark, d):
    """Which messages are of commerce, and why; bookings of pickups and advertisements are left out."""
    m = C.commerce_reasons(messages(spark, d)).select("id", "why")
    relevant = F.coalesce((F.size("why") > 0) & ~F.get("why", F.lit(0)).startswith("excluded"), F.lit(False))
    return m.select("id", F.array_join("why", ",").alias("reasons"), relevant.alias("relevant"))


PROFILES = [
    R.Profile(
        "shop", "production", domains=("shop.example.com",), order_ids=(r"order\s*(?:number|no\.?)\s*:?\s*([a-z0-9/-]{4,20})",), negative=(R.Rule("spam_folder_words", "body", "unsubscribe", sources=("notes",)),),
        provenance={"letters": "observed_real_email", "docs": "official_documentation", "notes": "synthetic"},
        events=(
            R.Event("order_created", 0.6, (R.Rule("subject", "subject", "order confirmation|confirmed", 0.2, sources=("letters",)), R.Rule("thanks", "body", "thank you for your order", 0.1, False, ("notes",)), R.Rule("signed", "dkim", r"^shop\.example\.com$", 0.1, False, ("docs",))), prohibitions=("never_creates_shipment",)),
            R.Event("shipment", 0.7, (R.Rule("shipped", "body", r"\bshipped\b", 0.15, sources=("notes",)), R.Rule("tracking", "body", "tracking number", 0.1, False, ("letters",))), (R.Rule("future", "body", "we will notify", sources=("letters",)),)),
        ),
    ),
    R.Profile("billing", "test", addresses=("pdf@szamlazz.hu", "billing@www.books.example.org."), provenance={"a": "verified_template"}, events=(R.Event("invoice", 0.8, (R.Rule("file", "attachments", r"\.pdf$", 0.15, sources=("a",)), R.Rule("number", "body", r"invoice number: *[a-z0-9-]+", 0.1, False, ("a",)))),)),
    R.Profile("any_carrier", "test", provenance={"t": "verified_template"}, events=(R.Event("in_transit", 0.5, (R.Rule("words", "subject", "csomag|parcel", 0.1, sources=("t",)), R.Rule("host", "transport", r"^mail[01]\.", 0.2, False, ("t",)))), R.Event("OTHER", 0.3, (R.Rule("newsletter", "subject", "newsletter", sources=()),)))),
]


def _rule_sql() -> str:
    """What the rules find, one SELECT for each event; the lists that the headers give are columns of ``hd``."""

    def hit(r: R.Rule) -> str:
        p = lit(f"(?i){r.pattern}")
        return f"len(list_filter({r.field}, lambda x: regexp_matches(x, {p}))) > 0" if r.field in ("attachments", "dkim", "return_path", "transport") else f"regexp_matches({r.field}, {p})"

    out = []
    for p in PROFILES:
        gates = [f"({' OR '.join(_in_domain('sender', x) for x in p.domains)})"] * bool(p.domains) + [f"lower(trim(address)) IN ({', '.join(map(lit, p.addresses))})"] * bool(p.addresses)
        text = "subject || chr(10) || body || chr(10) || html || chr(10) || array_to_string(attachments, chr(10))"
        order = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({text}, {lit('(?i)' + x)}, 1)), '')" for x in p.order_ids) + ")" if p.order_ids else "NULL"
        for e in p.events:
            negative = (*p.negative, *e.negative)
            blocked = " OR ".join(f"({hit(r)})" for r in negative) or "false"
            delta = " + ".join(f"CASE WHEN {hit(r)} THEN {r.delta} ELSE 0 END" for r in e.rules)
            levels = ", ".join(f"CASE WHEN {hit(r)} THEN {lit(p.provenance[s])} END" for r in (*e.rules, *negative) for s in r.sources if s in p.provenance)
            named = lambda own: f"array_to_string(list_filter([{', '.join(f'CASE WHEN {hit(r)} THEN {lit(r.name)} END' for r in own)}], lambda x: x IS NOT NULL), ',')" if own else "''"
            where = " AND ".join([*gates, *(f"({hit(r)})" for r in e.rules if r.required), f"({' OR '.join(f'({hit(r)})' for r in e.rules)})"])
            out.append(f"SELECT id, {lit(p.name)} AS profile, {lit(e.name)} AS event, {lit(p.status)} AS status, round(least(1.0, greatest(0.0, CAST({e.base} + {delta} AS DOUBLE))), 4) AS confidence, ({blocked}) AS blocked, list_sort(list_distinct(list_filter([{levels or 'NULL'}]::VARCHAR[], lambda x: x IS NOT NULL))) AS levels, {order} AS order_id, {named(e.rules)} AS rules, {named(negative)} AS negatives FROM hd WHERE {where}")
    return " UNION ALL ".join(out)


_DKIM = r"""list_distinct(list_transform(flatten(list_transform(flatten(list_transform([auth, auth_2], lambda v: regexp_extract_all(v, '(?i)(?:^|;)\s*dkim\s*=\s*pass\b([^;]*)', 1))), lambda v: list_concat(regexp_extract_all(v, '(?i)\bheader\.d\s*=\s*([^\s;]+)', 1), regexp_extract_all(v, '(?i)\bheader\.i\s*=\s*@?([^\s;]+)', 1)))),
    lambda x: regexp_replace(regexp_replace(lower(trim(string_split(x, '@')[-1])), '^www\.', ''), '\.$', '')))"""
_HEADERS = f"hd AS (SELECT *, {_DOMAIN} AS sender, {_DKIM} AS dkim, [{_DOMAIN}] AS return_path, ['mail' || (id % 3) || '.example.net'] AS transport FROM msg)"
_CARRIES = f"list_has_any(levels, {listed(R.CARRYING)})"


def _with_headers(spark, d):
    m = messages(spark, d).withColumn("sender", C.sender_domain(F.col("address"))).withColumn("h", T.header_domains(F.col("headers")))
    return m.select("*", "h.dkim", "h.return_path", "h.transport")


@query(f"{M}, {_HEADERS} SELECT id, array_to_string(list_sort(dkim), ',') AS dkim, array_to_string(return_path, ',') AS return_path, array_to_string(transport, ',') AS transport FROM hd")
def header_parse(spark, d):
    return _with_headers(spark, d).select("id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("dkim", "return_path", "transport")])


@query(f"{M}, {_HEADERS}, ev AS ({_rule_sql()}) SELECT id, profile, event, confidence, blocked, array_to_string(levels, ',') AS provenance, order_id, status = 'production' AND NOT blocked AND confidence >= 0.85 AND {_CARRIES} AS eligible FROM ev")
def rule_engine_eval(spark, d):
    """What the profiles find, behind their sender gates, and what may enter a decision."""
    found = R.evaluate(_with_headers(spark, d), PROFILES)
    return found.select("id", "profile", "event", "confidence", "blocked", F.array_join("provenance", ",").alias("provenance"), "order_id", "eligible")


@query(f"{M}, {_HEADERS}, ev AS ({_rule_sql()}) SELECT id, profile, event, confidence, blocked, order_id IS NOT NULL AS has_order_id, rules, negatives, false AS would_write FROM ev WHERE status = 'test'")
def shadow_diagnostics(spark, d):
    """What profiles under test would have found, without texts and identities; nothing of it is ever written."""
    return R.diagnostics(R.evaluate(_with_headers(spark, d), R.registered(PROFILES, "test")))


@query(f"""{M}, {_HEADERS}, ev AS ({_rule_sql()}), m AS (SELECT id, count(*) AS n, bool_or(event <> 'OTHER') AS positive, bool_or(blocked) AS any_blocked, count(*) FILTER (WHERE blocked) AS blocked FROM ev GROUP BY 1)
    SELECT count(*) AS messages, count(m.id) AS matched, coalesce(sum(m.n), 0)::BIGINT AS evidence, count(*) FILTER (WHERE m.n > 1) AS multi, count(*) FILTER (WHERE m.positive) AS positive, count(*) FILTER (WHERE NOT m.positive) AS other_only, coalesce(sum(m.blocked), 0)::BIGINT AS blocked, count(*) FILTER (WHERE len(dkim) > 0) AS with_dkim, count(*) FILTER (WHERE len(return_path) > 0) AS with_return_path FROM hd LEFT JOIN m USING (id)""")
def profile_audit(spark, d):
    """Counts over all messages: matched ones, those with several or only other evidence, blocked evidence, and headers."""
    rows = _with_headers(spark, d)
    found = R.evaluate(rows, PROFILES).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event") != "OTHER").alias("positive"), F.count_if("blocked").alias("blocked"))
    j = rows.select("id", "dkim", "return_path").join(found, "id", "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.agg(
        F.count(F.lit(1)).alias("messages"), F.count("n").alias("matched"), n("n").alias("evidence"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("other_only"),
        n("blocked").alias("blocked"), F.count_if(F.size("dkim") > 0).alias("with_dkim"), F.count_if(F.size("return_path") > 0).alias("with_return_path"),
    )


#: What a message's sender is to its facts, and which kind of fact its event is.
_SOURCE = f"CASE WHEN {sql_role('sender')} = 'carrier' THEN 'carrier_direct' WHEN sender = 'szamlazz.hu' THEN 'invoice_provider_direct' WHEN {sql_role('sender')} = 'public' THEN 'generic_email' WHEN len(list_filter(attachments, lambda f: regexp_matches(lower(f), '[.]pdf$'))) > 0 THEN 'invoice_pdf' ELSE 'merchant' END"
_FACT = "CASE WHEN regexp_matches(folded_subject, 'order|rendeles') THEN 'commerce_identity' WHEN regexp_matches(folded_subject, 'parcel|deliver|csomag|kezbesit') THEN 'logistics_state' WHEN regexp_matches(folded_subject, 'fizetes') THEN 'payment_state' WHEN regexp_matches(folded_subject, 'szamla') THEN 'invoice_state' END"


@query(f"""{M}, {_TEXTS}, f AS (SELECT id, user_id, {_FACT} AS domain, {_SOURCE} AS source FROM tx), a(domain, source, n) AS (VALUES {", ".join(f"({lit(x)}, {lit(s)}, {n})" for x, own in R.AUTHORITY.items() for s, n in own.items())}),
    w AS (SELECT f.*, coalesce(a.n, 0) AS authority, coalesce(g.n, 0) AS of_none FROM f LEFT JOIN a ON a.domain = f.domain AND a.source = f.source LEFT JOIN a g ON g.domain = f.domain AND g.source = 'generic_email' WHERE f.domain IS NOT NULL)
    SELECT user_id, domain, arg_min(id, {{'l': -authority, 'i': id}}) AS best_id, max(authority)::INT AS authority, (max(authority) - min(of_none))::INT AS over_generic, count(*) AS n FROM w GROUP BY 1, 2""")
def authority_matrix(spark, d):
    """Of each user and kind of fact the message whose sender counts most, and by how much over one of no known kind."""
    m = _message_texts(messages(spark, d))
    role, subject = T.sender_role(F.col("sender")), F.col("folded_subject")
    pdf = F.exists("attachments", lambda f: F.lower(f).rlike("[.]pdf$"))
    source = F.when(role == "carrier", "carrier_direct").when(F.col("sender") == "szamlazz.hu", "invoice_provider_direct").when(role == "public", "generic_email").when(pdf, "invoice_pdf").otherwise("merchant")
    fact = F.when(subject.rlike("order|rendeles"), "commerce_identity").when(subject.rlike("parcel|deliver|csomag|kezbesit"), "logistics_state").when(subject.rlike("fizetes"), "payment_state").when(subject.rlike("szamla"), "invoice_state")
    m = m.select("id", "user_id", fact.alias("domain"), source.alias("source")).where("domain is not null")
    w = m.withColumn("own", R.authority(F.col("domain"), F.col("source"))).withColumn("none", R.authority(F.col("domain"), F.lit("generic_email")))
    g = w.groupBy("user_id", "domain").agg(F.min(F.struct((-F.col("own")).alias("less"), "id")).alias("best"), F.min("none").alias("none"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "domain", F.col("best.id").alias("best_id"), (-F.col("best.less")).alias("authority"), (-F.col("best.less") - F.col("none")).alias("over_generic"), "n")


@query(f"""{M}, {_HEADERS}, ev AS ({_rule_sql()}), r(profile, status, events, gated) AS (VALUES {", ".join(f"({lit(p.name)}, {lit(p.status)}, {len(p.events)}, {str(bool(p.domains or p.addresses)).lower()})" for p in PROFILES)})
    SELECT r.*, count(DISTINCT ev.id) AS messages, count(ev.id) AS found, count(*) FILTER (WHERE ev.blocked) AS blocked FROM r LEFT JOIN ev USING (profile) GROUP BY ALL""")
def rule_registry(spark, d):
    """The profiles in force and under test, and what each finds in the messages."""
    rows = spark.createDataFrame([(p.name, p.status, len(p.events), bool(p.domains or p.addresses)) for p in PROFILES], "profile string, status string, events int, gated boolean")
    found = R.evaluate(_with_headers(spark, d), PROFILES).groupBy("profile").agg(F.count_distinct("id").alias("messages"), F.count(F.lit(1)).alias("found"), F.count_if("blocked").alias("blocked"))
    return rows.join(found, "profile", "left").fillna(0, ["messages", "found", "blocked"])


_PROTOCOL = _chain("html", (r"(?s)<!--.*?-->", "' '"), (r"(?is)<style\b.*?</style>", "' '"), (r"(?is)<script\b.*?</script>", "' '"), (r"(?i)<(?:br|hr)\b[^>]*>", "chr(10)"), (r"(?i)</(?:p|div|li|tr|h[1-6])>", "chr(10)"), (r"<[^>]+>", "' '"))
_CHAR = "CASE WHEN starts_with(lower(e), '#x') THEN chr(CAST('0x' || substring(e, 3) AS INTEGER)) WHEN starts_with(e, '#') THEN chr(CAST(substring(e, 2) AS INTEGER)) ELSE CASE lower(e) WHEN 'amp' THEN '&' WHEN 'apos' THEN '''' WHEN 'gt' THEN '>' WHEN 'lt' THEN '<' WHEN 'nbsp' THEN ' ' ELSE '\"' END END"


@query(f"""{M}, p AS (SELECT id, {_PROTOCOL} AS h FROM msg), x AS (SELECT id, string_split_regex(h, {lit(T.ENTITY)}) AS parts, list_transform(regexp_extract_all(h, {lit(T.ENTITY)}, 1), lambda e: {_CHAR}) AS chars FROM p),
    j AS (SELECT id, array_to_string(flatten(list_transform(list_zip(parts, chars), lambda z: [coalesce(z[1], ''), coalesce(z[2], '')])), '') AS h FROM x)
    SELECT id, sha256(trim(regexp_replace(regexp_replace(h, '[\\t\\r ]+', ' ', 'g'), ' *\\n+ *', chr(10), 'g'), ' ')) AS text_sha FROM j""")
def protocol_text(spark, d):
    return messages(spark, d).select("id", F.sha2(T.protocol_text(F.col("html")), 256).alias("text_sha"))


@query(f"{M}, {_WALK} SELECT id, array_to_string(ld_types, ',') AS ld_types, array_to_string(item_types, ',') AS item_types, array_to_string(types, ',') AS commerce_types FROM mk")
def jsonld_types(spark, d):
    h = F.col("html")
    return messages(spark, d).select("id", F.array_join(T.json_ld_types(h), ",").alias("ld_types"), F.array_join(T.item_types(h), ",").alias("item_types"), F.array_join(T.markup_types(h), ",").alias("commerce_types"))


@query(f"{M}, {_WALK} SELECT count(*) AS messages, count(*) FILTER (WHERE regexp_matches(html, {lit(T.JSON_LD)})) AS with_blocks, count(*) FILTER (WHERE len(ld_types) > 0) AS with_json_ld, count(*) FILTER (WHERE len(item_types) > 0) AS with_items, count(*) FILTER (WHERE len(types) > 0) AS with_commerce, count(*) FILTER (WHERE regexp_matches(html, {lit(T.JSON_LD)}) AND len({_BLOCKS}) = 0) AS broken, count(*) FILTER (WHERE regexp_matches(html, '(?i)https?://schema\\.org/')) AS with_reference FROM msg JOIN mk USING (id)")
def markup_audit(spark, d):
    h, n = F.col("html"), lambda c: F.count_if(c)
    m = messages(spark, d).select("html", T.json_ld_types(h).alias("ld"), T.item_types(h).alias("items"), T.markup_types(h).alias("types"), F.size(T.json_ld(h)).alias("blocks"), h.rlike(T.JSON_LD).alias("some"))
    return m.agg(F.count(F.lit(1)).alias("messages"), n("some").alias("with_blocks"), n(F.size("ld") > 0).alias("with_json_ld"), n(F.size("items") > 0).alias("with_items"), n(F.size("types") > 0).alias("with_commerce"), n(F.col("some") & (F.col("blocks") == 0)).alias("broken"), n(h.rlike(r"(?i)https?://schema\.org/")).alias("with_reference"))


def _ahead(pattern: str) -> str:
    return f"len(list_filter(lines[i:i + 7], lambda y: regexp_matches(y, {lit(pattern)}))) > 0"


_HEAD = r"regexp_matches(lines[i], '^\s*(?:from|felado)\s*:') AND " + _ahead(r"^\s*(?:to|cimzett)\s*:") + " AND " + _ahead(r"^\s*(?:subject|targy)\s*:")


@query(f"""{M}, l AS (SELECT id, regexp_split_to_array({_fold("body")}, '\\r?\\n') AS lines FROM msg), n AS (SELECT id, lines, i FROM l, unnest(range(1, len(lines) + 1)) r(i)),
    s AS (SELECT id, min(i) AS stop FROM n WHERE {_any("lines[i]", T.HISTORY)} OR ({_HEAD}) GROUP BY 1)
    SELECT id, sha256(trim(regexp_replace(array_to_string(list_filter(lines[1:coalesce(stop - 1, len(lines))], lambda x: NOT regexp_matches(x, '^\\s*>')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')) AS kept_sha, coalesce(stop, 0) AS stop FROM l LEFT JOIN s USING (id)""")
def quoted_history_strip(spark, d):
    """Whole bodies without what they quote, and the line where that begins."""
    m = messages(spark, d).select("id", T.fold(F.col("body")).alias("body")).withColumn("kept", T.without_history(F.col("body")))
    lines = F.split("body", "\r?\n")
    ahead = lambda i, p: F.exists(F.slice(lines, i + 1, 8), lambda x: x.rlike(p))
    stops = F.transform(lines, lambda x, i: C.any_of(x, T.HISTORY) | (x.rlike(r"^\s*(?:from|felado)\s*:") & ahead(i, r"^\s*(?:to|cimzett)\s*:") & ahead(i, r"^\s*(?:subject|targy)\s*:")))
    return m.select("id", F.sha2("kept", 256).alias("kept_sha"), F.array_position(stops, True).cast("long").alias("stop"))


@query(f"""{M}, s AS (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace({_fold("body")}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM msg)
    SELECT id, len(s) - len(list_filter(s, lambda x: NOT {_any("x", C.PROMISES)})) AS dropped, sha256(array_to_string(list_filter(s, lambda x: NOT {_any("x", C.PROMISES)}), chr(10))) AS kept_sha FROM s""")
def future_sentence_filter(spark, d):
    """Sentences that promise a later message don't speak of the present."""
    m = messages(spark, d).select("id", T.fold(F.col("body")).alias("body")).withColumn("kept", C.without_promises(F.col("body")))
    n = lambda c: F.size(F.filter(F.split(c, r"\n+"), lambda s: F.trim(s) != ""))
    return m.select("id", (n(F.regexp_replace("body", r"([.!?])\s+", "$1\n")) - n("kept")).cast("long").alias("dropped"), F.sha2("kept", 256).alias("kept_sha"))


def _rows_of(texts: str, body: str) -> str:
    """All rows of products of the texts, in either form."""
    each = [f"SELECT id, {n} AS form, " + ", ".join(f"unnest(regexp_extract_all({body}, {lit(p)}, {k})) AS {name}" for k, name in enumerate(("name", "q", "a", "c"), 1)) + f" FROM {texts}" for n, p in enumerate(C.ROWS)]
    return f"""r AS ({" UNION ALL ".join(each)}), p AS (SELECT id, trim(name) AS name, TRY_CAST(q AS INT) AS quantity, {_amount("a", f"({_currency('c')})")} AS total, {_currency("c")} AS currency FROM r),
    pr_rows AS (SELECT * FROM p WHERE quantity > 0 AND total IS NOT NULL AND NOT regexp_matches(name, {lit(C.SUMS)}))"""


@query(f"{M}, {_TEXTS}, {_rows_of('tx', 'folded_body')} SELECT * FROM pr_rows")
def product_rows(spark, d):
    m = _message_texts(messages(spark, d)).select("id", F.explode(C.product_rows(F.col("folded_body"))).alias("p"))
    return m.select("id", "p.name", "p.quantity", F.col("p.total").cast("double").alias("total"), "p.currency")


_TOTAL = [_money("folded_body", label) for label in C.TOTALS]
_FIRST_TOTAL = "CASE " + " ".join(f"WHEN {a} IS NOT NULL AND {c} IS NOT NULL THEN {k}" for k, (a, c) in enumerate(_TOTAL)) + " END"
_PICKED = [f"CASE ({_FIRST_TOTAL}) " + " ".join(f"WHEN {k} THEN {x[n]}" for k, x in enumerate(_TOTAL)) + " END" for n in (0, 1)]


@query(f"{M}, {_TEXTS} SELECT id, {_PICKED[0]} AS total, {_PICKED[1]} AS currency, {_line('folded_body', C.PAYMENTS)} AS payment, {_line('folded_body', C.SHIPPINGS)} AS shipping FROM tx")
def labelled_values(spark, d):
    body = F.col("folded_body")
    m = _message_texts(messages(spark, d)).withColumn("m", C.labelled_money(body, C.TOTALS))
    return m.select("id", F.col("m.amount").cast("double").alias("total"), "m.currency", T.labelled_line(body, C.PAYMENTS).alias("payment"), T.labelled_line(body, C.SHIPPINGS).alias("shipping"))


_LABELS = "list_filter(string_split(sender, '.'), lambda x: x <> '')"
_ROOT = f"CASE WHEN len({_LABELS}[-1]) = 2 AND {_LABELS}[-2] IN ({', '.join(map(lit, T.SECOND_LEVEL))}) AND {_LABELS}[-3] IS NOT NULL THEN {_LABELS}[-3] ELSE coalesce({_LABELS}[-2], {_LABELS}[-1], sender) END"


@query(f"""{M}, {_TEXTS} SELECT sender, coalesce(nullif(array_to_string(list_transform(list_filter(regexp_split_to_array({_ROOT}, '[-_]+'), lambda w: w <> ''), lambda w: CASE WHEN len(w) <= 3 THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' '), ''), sender) AS merchant,
    bool_or(lower(address) ILIKE '%@foxpost.hu') AS foxpost, {sql_role("sender")} AS role, count(*) AS n FROM tx GROUP BY sender""")
def merchant_names(spark, d):
    """Merchants named by their domains, the role of each sender, and a suffix of addresses in either case."""
    m = messages(spark, d).select("address", C.sender_domain(F.col("address")).alias("sender")).groupBy("sender").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("address").ilike("%@foxpost.hu")).alias("foxpost"))
    return m.select("sender", T.merchant_name(F.col("sender")).alias("merchant"), "foxpost", T.sender_role(F.col("sender")).alias("role"), "n")


_CONTEXT, _NOW = "folded_subject || chr(10) || folded_body", "folded_subject || chr(10) || fresh"
#: The messages with what their bodies say themselves, without what they quote.
_FRESH = f"""ll AS (SELECT id, regexp_split_to_array(folded_body, '\\r?\\n') AS lines FROM tx), ln AS (SELECT id, lines, i FROM ll, unnest(range(1, len(lines) + 1)) u(i)), st AS (SELECT id, min(i) AS stop FROM ln WHERE {_any("lines[i]", T.HISTORY)} OR ({_HEAD}) GROUP BY 1),
    fr AS (SELECT tx.*, trim(regexp_replace(array_to_string(list_filter(lines[1:coalesce(stop - 1, len(lines))], lambda x: NOT regexp_matches(x, '^\\s*>')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ') AS fresh FROM tx JOIN ll USING (id) LEFT JOIN st USING (id))"""
_FRESH_TOTAL = "coalesce(" + ", ".join(f"CASE WHEN {a} IS NOT NULL AND {c} IS NOT NULL THEN {k} END" for k, (a, c) in enumerate(_money("fresh", label) for label in C.TOTALS)) + ")"
_SIGNS = f"({_FRESH_TOTAL} IS NOT NULL)::INT + ({_line('fresh', C.PAYMENTS)} IS NOT NULL)::INT + ({_line('fresh', C.SHIPPINGS)} IS NOT NULL)::INT + (fr.id IN (SELECT id FROM pr_rows))::INT + regexp_matches({_NOW}, {lit(C.DETAILS)})::INT + {_any('folded_subject', C.CONFIRMING_SUBJECTS)}::INT"
_PHASE = "CASE WHEN contains({0}, 'delivered') OR contains({0}, 'kezbesitve') THEN 'delivered' WHEN contains({0}, 'out for delivery') OR contains({0}, 'kiszallitas alatt') THEN 'out_for_delivery' WHEN contains({0}, 'shipped') OR contains({0}, 'feladva') THEN 'shipped' WHEN contains({0}, 'label created') OR contains({0}, 'rogzitve') THEN 'created' END"
_SHARED = " OR ".join(_in_domain("sender", x) for x in C.SHARED_SENDERS)
_PARSED = f"""{_FRESH}, {_rows_of('fr', 'fresh')}, pr AS (SELECT *, {sql_role("sender")} AS role, {_identity(_NOW, C.ORDER_IDS, every=True)} AS o, {_identity(_CONTEXT, C.TRACKING_IDS)} AS t, {_identity(_CONTEXT, C.INVOICE_IDS)} AS i, {_SIGNS} AS signs, {_FRESH_TOTAL} IS NOT NULL AS has_total, {_any(_NOW, C.CONFIRMATIONS)} AND NOT {_any(_NOW, C.DISCLAIMERS)} AND NOT ({_SHARED}) AS confirms, {_PHASE.format(_CONTEXT)} AS phase FROM fr)"""


@query(f"""{M}, {_TEXTS}, {_PARSED} SELECT id, CASE WHEN role = 'carrier' AND t IS NOT NULL THEN 'carrier' WHEN role = 'unknown' AND o IS NOT NULL AND confirms AND signs >= 2 THEN 'generic_order' WHEN role = 'unknown' AND i IS NOT NULL THEN 'invoice' ELSE 'fallback' END AS parser,
    CASE WHEN role = 'carrier' AND t IS NOT NULL THEN CASE phase WHEN 'delivered' THEN 'delivery' ELSE 'shipment' END WHEN role = 'unknown' AND o IS NOT NULL AND confirms AND signs >= 2 THEN 'order_created' WHEN role = 'unknown' AND i IS NOT NULL THEN 'invoice_or_receipt' ELSE 'other' END AS event,
    CASE WHEN role = 'carrier' AND t IS NOT NULL THEN t WHEN role = 'unknown' AND o IS NOT NULL AND confirms AND signs >= 2 THEN o WHEN role = 'unknown' AND i IS NOT NULL THEN i END AS identity,
    CASE WHEN role = 'carrier' AND t IS NOT NULL THEN 0.96 WHEN role = 'unknown' AND o IS NOT NULL AND confirms AND signs >= 2 THEN CASE WHEN signs >= 4 THEN 0.97 WHEN signs = 3 THEN 0.95 ELSE 0.92 END WHEN role = 'unknown' AND i IS NOT NULL THEN 0.93 ELSE 0.0 END::DOUBLE AS confidence FROM pr""")
def parser_chain(spark, d):
    """The first parser that recognises a message speaks for it; what none does is left for review."""
    m = _message_texts(messages(spark, d))
    sender, subject, body = F.col("sender"), F.col("folded_subject"), F.col("folded_body")
    m, context = m.withColumn("context", F.concat_ws("\n", subject, body)), F.col("context")
    # each parser in a projection of its own, so that what is asked of it several times is read once
    m = m.withColumn("carrier", C.carrier_message(sender, context)).withColumn("order", C.generic_order(sender, subject, body))
    m = m.withColumn("invoice", F.when(F.col("carrier").isNull() & F.col("order").isNull() & (T.sender_role(sender) == "unknown"), C.identity(context, C.INVOICE_IDS)))
    carrier, order, invoice = F.col("carrier"), F.col("order"), F.col("invoice")
    out = lambda parser, event, identity, confidence: F.struct(F.lit(parser).alias("parser"), event.alias("event"), identity.alias("identity"), confidence.cast("double").alias("confidence"))
    chain = F.coalesce(
        F.when(carrier.isNotNull(), out("carrier", carrier["event"], carrier["tracking"], F.lit(0.96))), F.when(order.isNotNull(), out("generic_order", F.lit("order_created"), order["order_id"], order["confidence"])),
        F.when((T.sender_role(sender) == "unknown") & invoice.isNotNull(), out("invoice", F.lit("invoice_or_receipt"), invoice, F.lit(0.93))), out("fallback", F.lit("other"), F.lit(None).cast("string"), F.lit(0.0)),
    )
    return m.select("id", chain.alias("c")).select("id", "c.*")


_OTHERS = " OR ".join(_in_domain("sender", x) for x in (*C.SHARED_SENDERS, *C.INFRASTRUCTURE)) + f" OR list_contains({listed(C.OWN_PARSERS)}, sender)"
_KEPT = f"array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(fresh, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '' AND NOT {_any('x', C.PROMISES)}), chr(10))"
_NOW_PHASE = "CASE " + " ".join(f"WHEN {_any('c', p)}" + (f" OR ({_any('c', C.ORDER_ON_ITS_WAY)} AND {_any('c', C.OF_PARCELS)})" if name == "in_transit" else "") + f" THEN {lit(name)}" for name, p in C.PHASES.items()) + " END"


@query(f"""{M}, {_TEXTS}, {_FRESH}, q AS (SELECT id, {_identity(f"trim({_NOW})", C.LATER_ORDER_IDS)} AS o, upper({_identity(f"trim({_NOW})", C.TRACKING_IDS)}) AS t, {_identity(f"trim({_NOW})", C.INVOICE_IDS)} AS i, folded_subject || chr(10) || {_KEPT} AS c FROM fr WHERE {sql_role("sender")} = 'unknown' AND sender <> '' AND NOT ({_OTHERS})),
    k AS (SELECT *, {_NOW_PHASE} AS now, {_any("c", C.INVOICING)} AS bills FROM q)
    SELECT id, 'invoice_or_receipt' AS event, NULL AS phase, o AS order_number, NULL AS tracking, i AS invoice, CASE WHEN i IS NOT NULL THEN 0.95 ELSE 0.93 END::DOUBLE AS confidence FROM k WHERE o IS NOT NULL AND bills
    UNION ALL SELECT id, CASE now WHEN 'delivered' THEN 'delivery' ELSE 'shipment' END, now, o, t, NULL, CASE WHEN o IS NOT NULL AND t IS NOT NULL THEN 0.96 ELSE 0.93 END::DOUBLE FROM k WHERE now IS NOT NULL AND (o IS NOT NULL OR t IS NOT NULL)""")
def multi_observation_explode(spark, d):
    """A message may tell of an order's invoice, of a shipment or delivery, of both or of neither; promises and quotations don't count."""
    m = _message_texts(messages(spark, d)).select("id", F.explode(C.observations(F.col("sender"), F.col("folded_subject"), F.col("folded_body"))).alias("o"))
    return m.select("id", "o.event", "o.phase", F.col("o.order").alias("order_number"), "o.tracking", "o.invoice", "o.confidence")


# fixed values: wordings of two payment providers' receipts
SIMPLE, BARION = (r"simplepay tranzakcio azonosito\s*:[ \t]*([^\n]+)", r"^kereskedo\s*:[ \t]*([^\n]+)", r"fizetett osszeg\s*:\s*([0-9]+)\s*(huf|ft|eur|usd)\b"), (r"fizetes barion azonositoja\s*:\s*([^\n]+)", r"elfogadohely neve\s*:\s*([^\n]+)", r"sikeresen fizettel\s+([0-9]+)\s*(huf|ft|eur|usd)\b")


def _paid(x: str, patterns, group: int = 1) -> str:
    return f"nullif(trim(regexp_extract({x}, {lit('(?m)' + patterns)}, {group})), '')"


@query(f"""{M}, {_TEXTS}, p AS (SELECT id, {_paid("folded_body", SIMPLE[0])} AS s, {_paid("folded_body", SIMPLE[1])} AS sm, {_paid("folded_body", SIMPLE[2])} AS sa, {_paid("folded_body", SIMPLE[2], 2)} AS sc, {_paid("folded_body", BARION[0])} AS b, {_paid("folded_body", BARION[1])} AS bm, {_paid("folded_body", BARION[2])} AS ba, {_paid("folded_body", BARION[2], 2)} AS bc, contains(folded_body, 'online rendeles adatai') AS bought FROM tx)
    SELECT id, CASE WHEN s IS NOT NULL AND sa IS NOT NULL THEN 'simplepay' ELSE 'barion' END AS provider, CASE WHEN s IS NOT NULL AND sa IS NOT NULL THEN s ELSE b END AS reference, CASE WHEN s IS NOT NULL AND sa IS NOT NULL THEN sm ELSE bm END AS merchant, CAST(CASE WHEN s IS NOT NULL AND sa IS NOT NULL THEN sa ELSE ba END AS DOUBLE) AS amount,
      CASE upper(CASE WHEN s IS NOT NULL AND sa IS NOT NULL THEN sc ELSE bc END) WHEN 'FT' THEN 'HUF' ELSE upper(CASE WHEN s IS NOT NULL AND sa IS NOT NULL THEN sc ELSE bc END) END AS currency, CASE WHEN s IS NOT NULL AND sa IS NOT NULL AND bought THEN 'purchase' ELSE 'unknown' END AS context
    FROM p WHERE (s IS NOT NULL AND sa IS NOT NULL) OR (b IS NOT NULL AND ba IS NOT NULL)""")
def provider_normalise(spark, d):
    """Receipts of two payment providers in one form; amounts in forints have no decimals."""
    body = F.col("folded_body")
    get = lambda p, k=1: F.nullif(F.trim(F.regexp_extract(body, "(?m)" + p, k)), F.lit(""))
    cur = lambda p: F.when(F.upper(get(p, 2)) == "FT", "HUF").otherwise(F.upper(get(p, 2)))

    def receipt(name, patterns, context):
        ref, merchant, money = patterns
        return F.when(get(ref).isNotNull() & get(money).isNotNull(), F.struct(F.lit(name).alias("provider"), get(ref).alias("reference"), get(merchant).alias("merchant"), get(money).cast("double").alias("amount"), cur(money).alias("currency"), context.alias("context")))

    simple = receipt("simplepay", SIMPLE, F.when(body.contains("online rendeles adatai"), "purchase").otherwise("unknown"))
    m = _message_texts(messages(spark, d)).select("id", F.coalesce(simple, receipt("barion", BARION, F.lit("unknown"))).alias("p"))
    return m.where("p is not null").select("id", "p.*")


@query(f"""{M}, {_TEXTS}, i AS (SELECT id, attachments[1] AS file, {_identity("folded_body", C.INVOICE_IDS)} AS invoice, upper({_identity("folded_body", C.ORDER_IDS)}) AS order_id, regexp_matches(folded_body, '\\b(?:szamla|invoice)\\b') AS labelled FROM tx)
    SELECT id, invoice, order_id, CASE WHEN labelled THEN 0.98 ELSE 0.97 END::DOUBLE AS confidence FROM i WHERE invoice IS NOT NULL AND order_id IS NOT NULL AND regexp_matches(trim(file), '(?i)\\.pdf$')""")
def invoice_text(spark, d):
    """Invoices attached as PDF whose text names both an invoice and an order."""
    body = F.col("folded_body")
    m = _message_texts(messages(spark, d)).where(F.exists("attachments", lambda f: F.trim(f).rlike(r"(?i)\.pdf$")))
    m = m.select("id", C.identity(body, C.INVOICE_IDS).alias("invoice"), F.upper(C.identity(body, C.ORDER_IDS)).alias("order_id"), F.when(body.rlike(r"\b(?:szamla|invoice)\b"), 0.98).otherwise(0.97).alias("confidence"))
    return m.where("invoice is not null and order_id is not null")


@query(f"""{M}, x AS (SELECT id, CASE id % 4 WHEN 0 THEN 'delivery' WHEN 1 THEN 'shipment' WHEN 2 THEN 'delivery' ELSE 'order_created' END AS event, trim(regexp_replace({_fold("subject")}, '[^a-z0-9]+', ' ', 'g')) AS s FROM msg)
    SELECT id, CASE WHEN event = 'delivery' AND NOT ({" OR ".join(f"contains(s, {lit(w)})" for w in C.DELIVERED)}) THEN 'shipment' ELSE event END AS event FROM x""")
def delivery_wording(spark, d):
    event = F.element_at(F.array(*map(F.lit, ("delivery", "shipment", "delivery", "order_created"))), (F.col("id") % 4 + 1).cast("int"))
    return messages(spark, d).select("id", C.delivery_kind(F.col("subject"), event).alias("event"))


def _extractions(m):
    """Extractions with every kind of flaw, by id."""
    i = F.col("id")
    nth = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v) + 1).cast("int"))
    return m.select(
        "id", nth("order_created", "order_updated", "payment_completed", "shipment", "invoice_or_receipt", "other").alias("event"), (F.lit(0.74) + (i % 9) * 0.03).alias("confidence"), (T.sender_role(C.sender_domain(F.col("address"))) == "carrier").alias("carrier"),
        F.concat_ws("\n", "subject", "body").alias("context"), F.when(i % 5 > 0, "Shop").alias("merchant"), F.when(i % 7 > 0, F.concat(F.lit("O-"), i)).alias("order_number"), F.when(i % 4 > 0, (i % 90 - 5).cast("double")).alias("total"), nth("HUF", "eur", None, "XYZ", "GBP").alias("currency"),
        nth("paid", "pending", None).alias("payment_status"), F.when(i % 11 < 4, (i % 13).cast("double")).alias("paid_amount"), nth(None, "EUR", "HUF").alias("paid_currency"), F.when(i % 17 < 3, (i % 3 - 1).cast("double")).alias("cod_amount"), F.when(i % 34 < 3, "HUF").alias("cod_currency"), (i % 3).alias("n_products"),
    )


_EXTRACTIONS = f"""ex AS (SELECT id, (['order_created', 'order_updated', 'payment_completed', 'shipment', 'invoice_or_receipt', 'other'])[id % 6 + 1] AS event, 0.74::DOUBLE + (id % 9) * 0.03::DOUBLE AS confidence, {sql_role(_DOMAIN)} = 'carrier' AS carrier, lower(subject || chr(10) || body) AS context,
    CASE WHEN id % 5 > 0 THEN 'Shop' END AS merchant, CASE WHEN id % 7 > 0 THEN 'O-' || id END AS order_number, CASE WHEN id % 4 > 0 THEN (id % 90 - 5)::DOUBLE END AS total, (['HUF', 'eur', NULL, 'XYZ', 'GBP'])[id % 5 + 1] AS currency, (['paid', 'pending', NULL])[id % 3 + 1] AS payment_status,
    CASE WHEN id % 11 < 4 THEN (id % 13)::DOUBLE END AS paid_amount, ([NULL, 'EUR', 'HUF'])[id % 3 + 1] AS paid_currency, CASE WHEN id % 17 < 3 THEN (id % 3 - 1)::DOUBLE END AS cod_amount, CASE WHEN id % 34 < 3 THEN 'HUF' END AS cod_currency, id % 3 AS n_products FROM msg)"""
_SPEAKS = "(" + " OR ".join(f"contains(context, {lit(w)})" for w in C.MONEY_WORDS) + ")"


def _names(c: str) -> str:
    return rf"CASE lower(trim({c})) WHEN 'huf' THEN regexp_matches(context, '(?:^|[^a-z])(?:huf|ft|forint)\b') WHEN 'eur' THEN regexp_matches(context, '(?:^|[^a-z])eur\b|€|(?:^|[^a-z])euro\b') WHEN 'usd' THEN regexp_matches(context, '(?:^|[^a-z])usd\b|\$|(?:^|[^a-z])dollar\b') WHEN 'gbp' THEN regexp_matches(context, '(?:^|[^a-z])gbp\b|£|(?:^|[^a-z])pound\b') ELSE contains(context, lower(trim({c}))) END"


def _flaw(a: str, c: str, waived: str) -> str:
    return f"CASE WHEN carrier OR {a} IS NULL THEN NULL WHEN {a} < 0 OR NOT {_SPEAKS} THEN '{a}_lacks_monetary_evidence' WHEN {c} IS NULL THEN CASE WHEN NOT ({waived}) THEN '{a}_missing_currency' END WHEN NOT ({_names(c)}) THEN '{a}_currency_lacks_evidence' END"


_GUARDED = f"""{_EXTRACTIONS},
    a AS (SELECT *, carrier AND event IN ('order_created', 'order_updated', 'payment_completed') AS down, {_flaw("total", "currency", "false")} AS f1, {_flaw("paid_amount", "paid_currency", "event = 'payment_completed' AND coalesce(payment_status, '') = 'paid'")} AS f2, coalesce(cod_amount < 0, false) AS bad FROM ex),
    b AS (SELECT *, CASE WHEN down THEN 'shipment' ELSE event END AS e, CASE WHEN down THEN least(confidence, 0.85) ELSE confidence END AS c FROM a),
    g AS (SELECT *, e = 'payment_completed' AND coalesce(payment_status, '') <> 'paid' AS unpaid, NOT carrier AND e = 'order_created' AND merchant IS NOT NULL AND order_number IS NOT NULL AS ident FROM b),
    v AS (SELECT *, list_filter([CASE WHEN carrier THEN 'carrier_sender_blocks_purchase_creation' END, CASE WHEN down THEN 'carrier_sender_event_downgraded_to_shipment' END,
        CASE WHEN carrier AND (coalesce(merchant, order_number, currency, payment_status, paid_currency) IS NOT NULL OR total IS NOT NULL OR paid_amount IS NOT NULL OR n_products > 0) THEN 'carrier_sender_cleared_purchase_fields' END, f1, f2, CASE WHEN bad THEN 'negative_cod_amount_blocked' END, CASE WHEN unpaid THEN 'payment_completed_without_explicit_paid_status' END], lambda x: x IS NOT NULL) AS r FROM g)"""
_BLOCKED = """array_to_string(list_filter([CASE WHEN carrier AND merchant IS NOT NULL THEN 'merchant' END, CASE WHEN carrier AND order_number IS NOT NULL THEN 'order_number' END, CASE WHEN carrier AND total IS NOT NULL THEN 'total' END, CASE WHEN carrier AND currency IS NOT NULL THEN 'currency' END, CASE WHEN carrier AND payment_status IS NOT NULL THEN 'payment_status' END,
    CASE WHEN carrier AND paid_amount IS NOT NULL THEN 'paid_amount' END, CASE WHEN carrier AND paid_currency IS NOT NULL THEN 'paid_currency' END, CASE WHEN carrier AND n_products > 0 THEN 'products' END, CASE WHEN f1 IS NOT NULL THEN 'total' END, CASE WHEN f1 IS NOT NULL AND currency IS NOT NULL THEN 'currency' END,
    CASE WHEN f2 IS NOT NULL THEN 'paid_amount' END, CASE WHEN f2 IS NOT NULL AND paid_currency IS NOT NULL THEN 'paid_currency' END, CASE WHEN bad THEN 'cod_amount' END, CASE WHEN bad AND cod_currency IS NOT NULL THEN 'cod_currency' END], lambda x: x IS NOT NULL), ',')"""
_STATUS = "CASE WHEN unpaid THEN 'review' WHEN ident AND c >= 0.8 AND c < 0.9 THEN 'guardrailed' WHEN len(r) > 0 THEN 'guardrailed' WHEN e = 'order_created' AND NOT (ident AND c >= 0.9) THEN 'review' ELSE 'validated' END"


@query(f"""{M}, {_GUARDED} SELECT id, {_STATUS} AS status, e AS event, c AS confidence, ident AND c >= 0.9 AS eligible, {_BLOCKED} AS blocked,
    array_to_string(list_concat(r, CASE WHEN unpaid THEN [] WHEN ident AND c >= 0.8 AND c < 0.9 THEN ['order_created_requires_corroboration'] WHEN len(r) = 0 AND e = 'order_created' AND NOT (ident AND c >= 0.9) THEN ['order_created_not_auto_eligible'] ELSE [] END), ',') AS reasons FROM v""")
def validator_status(spark, d):
    return V.validated(_extractions(messages(spark, d)))


_PARSERS = "(['generic-order-confirmation-v1.4', 'generic-lifecycle-v13', 'deterministic-lifecycle-v1', NULL])[id % 4 + 1]"


@query(f"""{M}, {_GUARDED}, s AS (SELECT id, {_STATUS} AS status, CASE WHEN id % 6 = 0 THEN 'review' WHEN id % 6 = 1 THEN 'validated' END AS nested, {_PARSERS} AS parser FROM v)
    SELECT id, NOT coalesce(regexp_matches(parser, '^generic-(?:order-confirmation|lifecycle)-v[0-9]+(?:\\.[0-9]+)*$'), false) AND coalesce(nested, status) IN ('validated', 'guardrailed') AS trusted FROM s""")
def trusted_evidence(spark, d):
    """The nested verdict counts before the column's, and parsers under observation never count."""
    i = F.col("id")
    nested = F.when(i % 6 == 0, "review").when(i % 6 == 1, "validated")
    parser = F.element_at(F.array(*[F.lit(x) for x in ("generic-order-confirmation-v1.4", "generic-lifecycle-v13", "deterministic-lifecycle-v1", None)]), (i % 4 + 1).cast("int"))
    return V.validated(_extractions(messages(spark, d))).select("id", V.trusted(F.col("status"), nested, parser).alias("trusted"))


@query(f"""{M}, {_GUARDED}, s AS (SELECT id, event AS first_event, e, c, {_STATUS} AS status, CASE WHEN id % 9 = 0 THEN 'timeout' END AS error, CASE WHEN id % 5 = 0 THEN 'other' ELSE e END AS audited, CASE WHEN id % 8 = 0 THEN 1 ELSE 2 END AS version FROM v)
    SELECT id, coalesce(e, 'other') AS classification, CASE e WHEN 'other' THEN 'ignored' ELSE CASE status WHEN 'review' THEN 'review' ELSE 'pending' END END AS initial_status FROM s WHERE error IS NULL AND version = 2 AND audited = e
    UNION ALL SELECT id, 'other', 'review' FROM s WHERE error IS NOT NULL OR version <> 2 OR audited <> e""")
def fallback_and_materialise(spark, d):
    """Audited results that agree with their columns become rows; what doesn't falls back to a row for review."""
    i = F.col("id")
    v = V.validated(_extractions(messages(spark, d)))
    ok = (i % 9 != 0) & (i % 8 != 0) & (F.when(i % 5 == 0, "other").otherwise(F.col("event")) == F.col("event"))
    return v.select("id", F.when(ok, F.col("event")).otherwise("other").alias("classification"), F.when(~ok, "review").when(F.col("event") == "other", "ignored").when(F.col("status") == "review", "review").otherwise("pending").alias("initial_status"))


@query(f"""{M}, n AS (SELECT id, subject, address, CASE id % 4 WHEN 0 THEN 'user' || user_id || '@in.example.org' WHEN 1 THEN 'USER' || user_id || '@IN.example.org' WHEN 2 THEN 'other@example.com' ELSE 'user' || user_id || '@in.example.org' END AS to_1, (['PASS', 'FAIL', 'gray', 'odd'])[id % 4 + 1] AS spam, (['PASS', 'PASS', 'FAIL'])[id % 3 + 1] AS virus FROM msg WHERE id % 10 <> 9)
    SELECT 'm' || id AS message_id, left(subject, 998) AS subject, address AS sender, lower(to_1) AS recipients, CASE upper(spam) WHEN 'ODD' THEN 'UNKNOWN' ELSE upper(spam) END AS spam, CASE WHEN virus = 'FAIL' THEN 'reject' WHEN spam = 'FAIL' THEN 'quarantine' ELSE 'accept' END AS disposition FROM n WHERE lower(to_1) LIKE '%@in.example.org'""")
def gateway_messages(spark, d):
    """Notifications of an inbound gateway, decoded: own recipients, verdicts, and what becomes of each message."""
    i, m = F.col("id"), messages(spark, d)
    own = F.concat(F.lit("user"), F.col("user_id"), F.lit("@in.example.org"))
    to = F.when(i % 4 == 1, F.concat(F.lit("USER"), F.col("user_id"), F.lit("@IN.example.org"))).when(i % 4 == 2, "other@example.com").otherwise(own)
    nth = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    status = lambda c: F.struct(c.alias("status"))
    mail = F.struct(F.concat(F.lit("m"), i).alias("messageId"), F.array(to).alias("destination"), F.struct(F.col("subject"), F.array("address").alias("from")).alias("commonHeaders"))
    receipt = F.struct(F.array(to).alias("recipients"), status(nth("PASS", "FAIL", "gray", "odd")).alias("spamVerdict"), status(nth("PASS", "PASS", "FAIL")).alias("virusVerdict"))
    raw = m.select(F.when(i % 10 == 9, F.lit("{broken")).otherwise(F.to_json(F.struct(F.lit("Received").alias("notificationType"), mail.alias("mail"), receipt.alias("receipt")))).alias("value"))
    return inbound(raw, "in.example.org").select("message_id", "subject", "sender", F.array_join("recipients", ",").alias("recipients"), "spam", disposition(F.col("virus"), F.col("spam")).alias("disposition"))


@query(f"{M}, {_GUARDED}, s AS (SELECT id, e, {_STATUS} AS status FROM v) SELECT id FROM s WHERE status IN ('validated', 'guardrailed') AND e IN ('other', 'subscription') AND NOT EXISTS (SELECT 1 FROM msg l WHERE l.id = s.id AND l.id % 4 = 0)")
def unlinked_noise(spark, d):
    """Trusted messages that are of no kind of commerce and linked to nothing."""
    m = messages(spark, d)
    linked = m.where("id % 4 = 0").select("id")
    v = V.validated(_extractions(m)).where(F.col("event").isin("other", "subscription") & V.trusted(F.col("status"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return v.select("id").join(linked, "id", "left_anti")


def _program_sql() -> str:
    cases = {c: [] for c in ("name", "event", "phase", "confidence", "identity", "extra")}
    for p in P.PROGRAMS:
        gate = " OR ".join([*[_in_domain("sender", x) for x in p.domains], *[f"lower(trim(address)) = {lit(a)}" for a in p.addresses]])
        fields = {"subject": "folded_subject", "body": "folded_body"}
        group = lambda where, fields=fields: f"upper(trim(regexp_extract({fields[where[0]]}, {lit(where[1])}, 1)))"
        hits = [f"regexp_matches(folded_subject, {lit(x)})" for x in p.subject] + [f"regexp_matches(folded_body, {lit(x)})" for x in p.body] + [f"{group(p.identity)} <> ''"] + ([f"{group(p.identity)} = {group(p.agrees)}"] if p.agrees else [])
        when = f"WHEN ({gate}) AND {' AND '.join(hits)} THEN "
        extra = " || ';' || ".join(f"{lit(k + '=')} || trim(regexp_extract(folded_body, {lit(v)}, 1))" for k, v in p.extracts.items()) or "''"
        for c, v in (("name", lit(p.name)), ("event", lit(p.event)), ("phase", lit(p.phase) if p.phase else "NULL"), ("confidence", f"{p.confidence}::DOUBLE"), ("identity", group(p.identity)), ("extra", extra)):
            cases[c].append(when + v)
    return ", ".join(f"CASE {' '.join(v)} END AS {c}" for c, v in cases.items())


@query(f"WITH {NOTICES_SQL}, tx AS (SELECT *, {_DOMAIN} AS sender, {_fold('subject')} AS folded_subject, {_fold('body')} AS folded_body FROM nt), r AS (SELECT id, {_program_sql()} FROM tx) SELECT * FROM r WHERE name IS NOT NULL")
def merchant_programs(spark, d):
    """Notices of single merchants and carriers, each read by the first program of its sender that takes it."""
    m = _message_texts(notices(spark, d))
    m = m.withColumn("p", P.parsed(F.col("sender"), F.col("address"), F.col("folded_subject"), F.col("folded_body"))).where("p is not null")
    extra = F.array_join(F.transform(F.map_entries("p.extracts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return m.select("id", "p.name", "p.event", "p.phase", "p.confidence", "p.identity", extra.alias("extra"))


_LINKED = """html || '<p>See <a class="x" href="https://x.example/track?id=' || page_id || '"><b>your</b> parcel</a> or <A HREF=''http://y.example/' || repeat('z', 600) || '''> <img></A></p>&lt;end&gt;'"""


def _compact_sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, {lit(T.BARE_LINK)}, 'link [URL: \\1]', 'g'), {lit(T.LINK)}, '\\2 [URL: \\1]', 'g')"
    return _chain(x, *[(p, "chr(10)" if by == "\n" else lit(by)) for p, by in T.COMPACT])


@query(f"WITH p AS (SELECT page_id, {_LINKED} AS html FROM pages) SELECT page_id, sha256(trim({_compact_sql('html')}, ' ')) AS text_sha, contains({_compact_sql('html')}, 'your parcel [URL: https://x.example/track?id=' || page_id || ']') AS linked FROM p")
def html_compact_text(spark, d):
    """Texts of pages with the addresses of their links."""
    i = F.col("page_id")
    html = F.concat("html", F.lit('<p>See <a class="x" href="https://x.example/track?id='), i, F.lit("\"><b>your</b> parcel</a> or <A HREF='http://y.example/"), F.repeat(F.lit("z"), F.lit(600)), F.lit("'> <img></A></p>&lt;end&gt;"))
    p = table(spark, d, "pages").select("page_id", T.compact_text(html).alias("text"))
    return p.select("page_id", F.sha2("text", 256).alias("text_sha"), F.col("text").contains(F.concat(F.lit("your parcel [URL: https://x.example/track?id="), i, F.lit("]"))).alias("linked"))


_ORDERS_FOUND = "role = 'unknown' AND o IS NOT NULL AND confirms AND signs >= 2"


@query(f"""{M}, {_TEXTS}, {_PARSED} SELECT id, CASE WHEN signs >= 4 THEN 0.97 WHEN signs = 3 THEN 0.95 ELSE 0.92 END::DOUBLE AS confidence, left(sha256(unhex({SQL_PADS['o']} || sha256(unhex({SQL_PADS['i']} || hex(encode(sender)))))), 24) AS sender_fingerprint, has_total, 'review' AS status, false AS would_write FROM pr WHERE {_ORDERS_FOUND}""")
def generic_shadow(spark, d):
    """What the generic order parser would have found, with a fingerprint in place of the sender; never written."""
    order = C.generic_order(F.col("sender"), F.col("folded_subject"), F.col("folded_body"))
    # exploded, not filtered: a filter moves below the projection, and each message would be read twice and folded for each pattern
    m = _message_texts(messages(spark, d)).select("id", "sender", F.explode(F.array_compact(F.array(order))).alias("order"))
    return m.select("id", F.col("order.confidence").cast("double").alias("confidence"), F.left(T.hmac_sha256(SECRET, F.col("sender")), F.lit(24)).alias("sender_fingerprint"), F.col("order.total").isNotNull().alias("has_total"), F.lit("review").alias("status"), F.lit(False).alias("would_write"))
