"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import WORD, table, whole
from .conversations_sql import SQL as REPAIR

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op1_pii")
def _(spark, folder):
    from .pii import personal_data_digest

    return personal_data_digest(table(spark, folder, "documents"))


@query("op2_mixing")
def _(spark, folder):
    from ..session import write_through
    from .mixing import mix, seeded_order

    docs = table(spark, folder, "documents")
    sizes = docs.select(
        "doc_id", "source", F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("words"), seeded_order(1, "doc_id", "text").alias("seeded")
    )
    mixed = mix(write_through(sizes, "words"), size_col="words", order_col="seeded")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "mix_shard")


@query(
    "op4_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def _(spark, folder):
    from .exact import exact_duplicates

    return exact_duplicates(table(spark, folder, "documents"))


@query("op8_sharding")
def _(spark, folder):
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, folder, "documents"))


@query("op7_language_id")
def _(spark, folder):
    from .language import predict

    return predict(table(spark, folder, "documents"))


@query("op3_sentencepiece")
def _(spark, folder):
    from .pieces import encoded_digest

    return encoded_digest(table(spark, folder, "documents"))


@query(
    "op6_jaccard_join",
    """
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
    members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
    SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON doc_id = x
    """,
)
def _(spark, folder):
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query(
    "op5_suffix_dedup",
    """
    WITH bytes AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
    starts AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS INTEGER), 200) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS p FROM bytes WHERE length(h) >= 200) q),
    later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM starts) q WHERE k > 1),
    runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
               SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
                 SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM later) f) g
             GROUP BY doc_id, run),
    cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM runs),
    kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail_from,
                    string_agg(substr(h, CAST(2 * kept_from + 1 AS INTEGER), CAST(2 * (a - kept_from) AS INTEGER)), '' ORDER BY a) AS heads
             FROM cut JOIN bytes USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
           sha256(from_hex(coalesce(heads, '') || substr(h, CAST(2 * coalesce(tail_from, 0) + 1 AS INTEGER)))) AS kept_sha256
    FROM bytes LEFT JOIN kept USING (doc_id)
    """,
)
def _(spark, folder):
    from .suffixes import repeats_digest

    return repeats_digest(table(spark, folder, "documents"))


@query("op9_html_extraction")
def _(spark, folder):
    from .pages import extract

    return extract(table(spark, folder, "pages"))


@query(
    "op10_topk",
    """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
      SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
        SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
        FROM e JOIN e q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) scored) ranked
    WHERE place <= 10
    """,
)
def _(spark, folder):
    from .vectors import top_k

    return top_k(table(spark, folder, "embeddings"))


@query("op11_simhash")
def _(spark, folder):
    from .simhash import near_duplicate_components

    return near_duplicate_components(table(spark, folder, "documents"))


@query("op13_conversation_repair", REPAIR)
def _(spark, folder):
    from .conversations import damage, repair_digest

    return repair_digest(damage(table(spark, folder, "conversations")))


@query("op12_token_alignment")
def _(spark, folder):
    from .alignment import link_digest

    return link_digest(table(spark, folder, "documents"))
