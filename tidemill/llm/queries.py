"""The queries of the numbered operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_order

    return mix_order(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_components

    return near_components(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("ok").alias("verified"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exponion import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_ALL = (
    op1_pieces, op2_exact_dedup, op3_mix_sources, op4_secret_scan, op5_language_id, op6_lm_score, op7_nearest, op8_jaccard_join, op9_warc, op10_substring_dedup, op11_spelling_variants,
    op12_exponion_clusters, op13_suffix_dedup,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def _rounds(n: int) -> str:
    """Rounds of assigning all vectors and moving the centroids, then a last assignment."""
    assign = """,
        a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, min({{'d': list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS m
                              FROM v, c{r} k GROUP BY vec_id)"""
    move = """,
        c{s} AS MATERIALIZED (SELECT c, coalesce(n.x, k.x) AS x FROM c{r} k LEFT JOIN (SELECT c, list(y ORDER BY i) AS x FROM (
            SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS y FROM (
                SELECT m.c AS c, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2)) GROUP BY c) n USING (c))"""
    return "".join(assign.format(r=r) + (move.format(r=r, s=r + 1) if r < n else "") for r in range(n + 1))


#: Words of each document with their places, as DuckDB sees them.
_WORDS = """
    t AS (SELECT * FROM (SELECT doc_id, unnest(string_split_regex(coalesce({text}, ''), '[ \\t\\n\\x0B\\f\\r]+')) AS word,
                                generate_subscripts(string_split_regex(coalesce({text}, ''), '[ \\t\\n\\x0B\\f\\r]+'), 1) AS pos FROM documents) WHERE word <> '')"""

ORACLE: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to, true AS verified FROM f""",
    "op8_jaccard_join": "WITH RECURSIVE" + _WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """,
        n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
        g AS (SELECT doc_id, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS k FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
        s AS (SELECT DISTINCT g.doc_id, g.s FROM g JOIN n USING (doc_id) WHERE k = 4
              UNION SELECT doc_id, string_agg(word, ' ' ORDER BY pos) FROM t JOIN n USING (doc_id) WHERE n < 4 GROUP BY 1),
        c AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT b.a, b.b FROM b JOIN c x ON x.doc_id = b.a JOIN c y ON y.doc_id = b.b WHERE 100 * b.n >= 85 * (x.c + y.c - b.n)),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(c.c, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) m USING (doc_id)""",
    "op10_substring_dedup": "WITH" + _WORDS.format(text="text") + """,
        g AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS k FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
        f AS (SELECT doc_id, pos, word, k = 13 AND min(doc_id) OVER (PARTITION BY s, k) < doc_id AS again FROM g),
        c AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f)
        SELECT d.doc_id, count(c.pos) AS n_words, count(*) FILTER (WHERE c.gone) AS n_removed,
               sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.pos) FILTER (WHERE NOT c.gone), '')) AS kept_sha256
        FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1""",
    "op11_spelling_variants": """
        WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 7),
        occ AS (SELECT doc_id, run, count(*) AS k FROM low GROUP BY 1, 2),
        step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
        bytes AS (SELECT doc_id, run, k, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM occ),
        crc AS (SELECT doc_id, run, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, step),
        cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM crc),
        w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
        p AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM w, range(0, 100000) r(i) WHERE i < length(word)),
        near AS (SELECT a.word, b.word AS other, b.n AS m FROM p a JOIN p b ON a.less = b.less AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
                 UNION SELECT p.word, w.word, w.n FROM p JOIN w ON p.less = w.word UNION SELECT w.word, p.word, p.n FROM p JOIN w ON p.less = w.word),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, {'n': -m, 'w': encode(other)}) AS other, max(m) AS m FROM near GROUP BY 1),
        f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
        r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.root WHERE e.form IS NULL""",
    "op12_exponion_clusters": """
        WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1)::INTEGER AS c, x FROM v ORDER BY sha256('3:' || vec_id::VARCHAR) LIMIT 8)""" + _rounds(10) + """
        SELECT vec_id, m.c AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(k.x, ',')) AS centroid_sha256
        FROM a10 JOIN c10 k ON k.c = m.c""",
    "op13_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        p AS (SELECT doc_id, n, j, substr(h, 2 * j + 1, 1000) AS h FROM (SELECT *, unnest(range(0, n, 400)) AS j FROM d)),
        b AS (SELECT doc_id, j + k AS i, substr(h, 2 * k + 1, 2) AS x, CASE WHEN j + k + 100 <= n THEN md5(substr(h, 2 * k + 1, 200)) END AS w FROM (SELECT *, unnest(range(least(400, n - j))) AS k FROM p)),
        f AS (SELECT doc_id, i, x, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM b),
        c AS (SELECT doc_id, i, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
        s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS start FROM c)
        SELECT d.doc_id, any_value(n)::BIGINT AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE start) AS n_spans,
               sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256
        FROM d LEFT JOIN s USING (doc_id) GROUP BY 1""",
}
