"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import CARRIERS, PUBLIC_MAILBOXES
from ..sources.mail import listed, lit, picked
from ..sources.tables import table
from .mail import sql_role
from .registry import query

SUFFIXES = ("example.com", "example.org")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang")
def frequency_table(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source", "lang")


@query("WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT count(*) AS threads, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n > 1) AS multi, max(n) AS longest FROM t")
def thread_stats(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.count(F.lit(1)).alias("threads"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("longest"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, max(doc_id) AS last_id FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_confusion(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.max("doc_id").alias("last_id"))


_HOST = "regexp_replace(regexp_replace(lower(trim(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))), '^www\\.', ''), '\\.$', '')"


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def domain_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_domain(F.col("url")).alias("host"))


@query(f"WITH p AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, s AS suffix FROM p JOIN (VALUES ('example.com'), ('example.org')) v(s) ON host = s OR ends_with(host, '.' || s)")
def domain_suffix_join(spark, d):
    """All suffixes of a host meet the trusted ones as equal keys."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    p = table(spark, d, "pages").select("page_id", T.url_domain(F.col("url")).alias("host")).select("page_id", F.explode(suffixes).alias("suffix"))
    return p.where(F.col("suffix").isin(*SUFFIXES))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def accent_fold_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.text_key(F.col("text")).alias("key"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages), b AS (SELECT page_id, regexp_replace(h, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM a),
    c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS h FROM b),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM c)
    SELECT page_id, sha256(trim(regexp_replace(regexp_replace(h, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ')) AS text_sha FROM e""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.html_text(F.col("html")), 256).alias("text_sha"))


_VERSIONS = ("Version ([0-9A-Za-z.]+)", "version ([0-9a-z.]+)", "(?:Licen[sc]ed?|licen[sc]ed?) ([A-Za-z0-9.-]+)")
_FOUND = [f"regexp_replace(nullif(regexp_extract(text, {lit(p)}, 1), ''), '[.,;:]+$', '')" for p in _VERSIONS]


@query(f"SELECT doc_id, coalesce({', '.join(f"CASE WHEN regexp_matches({x}, '[0-9]') THEN {x} END" for x in _FOUND)}) AS raw FROM documents")
def first_match_extract(spark, d):
    """The first of several patterns whose group has a digit, without what ends a sentence."""
    return table(spark, d, "documents").select("doc_id", T.first_match(F.col("text"), list(_VERSIONS)).alias("raw"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract(text, '([0-9][0-9.,]*[0-9])', 1) AS s FROM documents WHERE regexp_matches(text, '[0-9][0-9.,]*[0-9]')), x AS (SELECT doc_id, s, regexp_matches(s, '[.,][0-9]{1,2}$') AS dec FROM m)
    SELECT doc_id, CAST(TRY_CAST(regexp_replace(regexp_replace(s, '[.,][0-9]{1,2}$', ''), '[.,]', '', 'g') || '.' || CASE WHEN dec THEN regexp_extract(s, '[.,]([0-9]{1,2})$', 1) ELSE '0' END AS DECIMAL(14, 2)) AS DOUBLE) AS amount FROM x""")
def money_parse(spark, d):
    m = table(spark, d, "documents").where(F.col("text").rlike("[0-9][0-9.,]*[0-9]")).select("doc_id", F.regexp_extract("text", "([0-9][0-9.,]*[0-9])", 1).alias("s"))
    return m.select("doc_id", T.money(F.col("s")).cast("double").alias("amount"))


#: Hosts as mail would come from: the page's own, public mailboxes, carriers and look-alikes of both.
_SENT_FROM = (*PUBLIC_MAILBOXES, *(d for own in CARRIERS.values() for d in own), "mail.dpd.hu", "fakedpd.hu", "gmail.com.evil.org", "eu.gmail.com")
_SENT_SQL = f"CASE WHEN page_id % 4 = 0 THEN {_HOST} ELSE ({listed(_SENT_FROM)})[page_id % {len(_SENT_FROM)} + 1] END"


@query(f"WITH p AS (SELECT {_SENT_SQL} AS host FROM pages) SELECT host, {sql_role('host')} AS role, count(*) AS n FROM p GROUP BY 1, 2")
def role_dimension(spark, d):
    host = F.when(F.col("page_id") % 4 == 0, T.url_domain(F.col("url"))).otherwise(picked(_SENT_FROM, F.col("page_id")))
    p = table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return p.select("host", T.sender_role(F.col("host")).alias("role"), "n")


@query("SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations) WHERE r = 1")
def first_link_lookup(spark, d):
    t = table(spark, d, "conversations")
    return t.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("x")).select("conv_id", "x.role", "x.text")


@query("SELECT page_id, lower(split_part(split_part(url, '?', 1), '/', -1)) AS last_part, left(coalesce(url, 'none'), 80) AS code, trim(regexp_replace(html, '[ \\t\\n]+', ' ', 'g'), ' ') AS term FROM pages")
def misc_strings(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.substring_index(F.substring_index("url", "?", 1), "/", -1)).alias("last_part"), F.left(F.coalesce("url", F.lit("none")), F.lit(80)).alias("code"), F.trim(F.regexp_replace("html", r"[ \t\n]+", " ")).alias("term"))
