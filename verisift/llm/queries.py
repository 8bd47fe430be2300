"""The thin queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licenses, matroska, mixing, neardup, onebit, pages, substrings, token_store, unigram
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.store(table(spark, sf_dir, "documents")))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.k >= 85 * (na.n + nb.n - p.k)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN m USING (doc_id)
"""


def op3_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 10
"""


def op4_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


#: The tables' pages have one article of headings and paragraphs each; &amp; is decoded last.
OP5_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '</?(p|h[1-6])>', chr(10), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(10)),
        lambda y: trim(regexp_replace(replace(replace(replace(replace(replace(y, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a)
SELECT page_id, url, array_to_string(list_filter(blocks, lambda y: y <> ''), chr(10)) AS text, CAST(length(array_to_string(list_filter(blocks, lambda y: y <> ''), chr(10))) AS BIGINT) AS n_chars FROM b
"""


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT s.r, s.i, md5(array_to_string(list_slice(w.ws, s.i, s.i + 34), ' ')) AS h FROM s JOIN w USING (r)),
d AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT r, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM d GROUP BY r),
k AS (SELECT w.doc_id, w.ws, coalesce(g.gone, []) AS gone FROM w LEFT JOIN g USING (r))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(CASE WHEN len(gone) = 0 THEN array_to_string(ws, ' ') ELSE coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM k
"""


def learns() -> Column:
    """Rows that op7 may learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(docs, learns()))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~learns(), F.lit(False)).alias("held_out"), "text")
    return language.detect(marked, model, ["doc_id", "held_out"]).drop("proportions")


#: Target weights of the sources: the crawl is held down, two curated sources are raised, the rest shares what is left.
WEIGHTS = {"src0": 0.2, "src1": 0.08, "src2": 0.08, "src3": 0.04, "src4": 0.04, mixing.REST: 0.56}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.select("doc_id", "source", "replica", "shuffle_key", F.coalesce(F.length("text"), F.lit(0)).alias("n_text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP8_SQL = mixing.oracle_sql(WEIGHTS, "doc_id, source, replica, shuffle_key, CAST(coalesce(length(text), 0) AS INTEGER) AS n_text, sha256(coalesce(text, '')) AS text_sha256")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can state."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, list_filter(range(len(ws)), lambda i: ws[i + 1] = 'mit' AND coalesce(ws[i + 2], '') = 'license') AS mit, list_filter(range(len(ws)), lambda i: ws[i + 1] = 'apache' AND coalesce(ws[i + 2], '') = 'license') AS apache,
      list_filter(range(len(ws)), lambda i: ws[i + 1] = 'general' AND coalesce(ws[i + 2], '') = 'public' AND coalesce(ws[i + 3], '') = 'license') AS gpl FROM w),
a AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places FROM p)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM a
"""


def matroska_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL can state."""
    return op1_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOAD_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), p AS (SELECT doc_id, raw, octet_length(raw) AS n, greatest(64, (octet_length(raw) + 63) // 64 * 64) AS m FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(raw || unhex(repeat('00', CAST(m - n AS INTEGER)))) AS payload_sha256 FROM p
"""


def unigram_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that SQL can state."""
    return op4_unigram(spark, sf_dir).select("doc_id", "decoded_sha256", "round_trip")


DECODED_SQL = "SELECT doc_id, sha256(replace(coalesce(text, ''), '▁', ' ')) AS decoded_sha256, NOT contains(coalesce(text, ''), '▁') AS round_trip FROM documents"


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_matroska": op1_matroska,
        "op2_neardup": op2_neardup,
        "op3_onebit": op3_onebit,
        "op4_unigram": op4_unigram,
        "op5_pages": op5_pages,
        "op6_substrings": op6_substrings,
        "op7_language": op7_language,
        "op8_mixing": op8_mixing,
        "op9_licenses": op9_licenses,
        "op10_token_store": op10_token_store,
        "matroska_payload": matroska_payload,
        "unigram_decoded": unigram_decoded,
        "licenses_base": licenses_base,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_neardup": OP2_SQL,
        "op3_onebit": OP3_SQL,
        "op5_pages": OP5_SQL,
        "op6_substrings": OP6_SQL,
        "op8_mixing": OP8_SQL,
        "matroska_payload": PAYLOAD_SQL,
        "unigram_decoded": DECODED_SQL,
        "licenses_base": BASE_SQL,
    }
