"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table
from graphloom.llm.decontaminate import contaminated_words
from graphloom.llm.fixity import damaged, fixity_audit
from graphloom.llm.interpolation import document_folds, interpolated_scores
from graphloom.llm.packing import pack
from graphloom.llm.quality import quality_scores
from graphloom.llm.repeats import repeated_bytes
from graphloom.llm.secrets import secret_spans
from graphloom.llm.simhash import simhash_groups
from graphloom.llm.urlmodel import url_verdicts
from graphloom.llm.winnow import winnow_documents


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all pages, as WARC records in the order of their ids, against a replica with planted damage."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity_audit(pages, damaged(pages), "page_id", ["page_id", "url", "html"])


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(table(spark, sf_dir, "documents"), document_folds())


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op5_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow_documents(table(spark, sf_dir, "documents"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_merkle_fixity": op1_merkle_fixity,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_ownership": op4_secret_ownership,
    "op5_url_language_model": op5_url_language_model,
    "op6_repeated_bytes": op6_repeated_bytes,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_winnowing": op8_winnowing,
    "op9_pu_quality": op9_pu_quality,
    "op10_positional_decontamination": op10_positional_decontamination,
}

_DIGEST = "sha256(concat(octet_length(encode(page_id::varchar)), ':', page_id, coalesce(octet_length(encode({url}))::varchar, '-'), ':', coalesce({url}, ''), coalesce(octet_length(encode({html}))::varchar, '-'), ':', coalesce({html}, '')))"
_QUARTERS = ", '/', ".join(f"2 * ('0x' || substr(digest, {1 + 16 * i}, 15))::bigint::hugeint" for i in range(4))

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"

ORACLE_SQL: dict[str, str] = {
    "op10_positional_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} FROM benchmark), d AS (SELECT doc_id, {_WORDS} FROM documents),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_slice(w, i, i + least(len(w), 10) - 1))) AS win FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
m AS (SELECT doc_id, k, p, item_id FROM (SELECT doc_id, k, p, list_slice(w, p, p + k - 1) AS win FROM dw) JOIN bw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM m) GROUP BY 1),
t AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
f AS (SELECT t, count(*) AS f FROM t GROUP BY 1),
nw AS (SELECT row_number() OVER () AS id, win FROM (SELECT DISTINCT win FROM bw)),
nt AS (SELECT DISTINCT id, unnest(win) AS t FROM nw),
need AS (SELECT id, count(*) AS m, first(t ORDER BY coalesce(f, 0), t) AS t FROM nt LEFT JOIN f USING (t) GROUP BY 1),
c AS (SELECT id, m, doc_id, p FROM need JOIN t USING (t)),
ok AS (SELECT id, c.doc_id FROM c JOIN nt USING (id) JOIN t o ON o.doc_id = c.doc_id AND o.t = nt.t AND abs(o.p - c.p) <= 15 GROUP BY id, m, c.doc_id, c.p HAVING count(DISTINCT o.t) = m),
n AS (SELECT doc_id, count(DISTINCT item_id::varchar) AS n_near FROM (SELECT DISTINCT id, doc_id FROM ok) JOIN nw USING (id) JOIN bw USING (win) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::bigint AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN n USING (doc_id)""",
    # Positions are unique, so a record that stands twice is two equal ones.
    "op1_merkle_fixity": f"""
WITH a AS (
  SELECT page_id, url, html, ('0x' || substr(md5(page_id::varchar), 1, 8))::bigint AS c,
         {_DIGEST.format(url="url", html="html")} AS digest,
         octet_length(encode(page_id::varchar)) + coalesce(octet_length(encode(url)), 0) + coalesce(octet_length(encode(html)), 0) AS bytes
  FROM pages),
placed AS (SELECT *, sum(bytes) OVER (ORDER BY page_id) AS upto FROM a),
b AS (
  SELECT page_id, CASE WHEN c % 197 = 7 THEN url || '#' ELSE url END AS url2, CASE WHEN c % 199 = 5 THEN chr(0) || substr(html, 2) ELSE html END AS html2, c % 193 = 11 AS twice
  FROM a WHERE c % 211 <> 3),
d AS (SELECT page_id, {_DIGEST.format(url="url2", html="html2")} AS digest, twice FROM b),
r AS (SELECT page_id, CASE WHEN twice THEN sha256(concat('2/', {_QUARTERS})) ELSE digest END AS digest, CASE WHEN twice THEN 2 ELSE 1 END AS n FROM d)
SELECT p.page_id AS position, CASE WHEN r.page_id IS NULL THEN 'missing' WHEN r.n > 1 THEN 'repeated' ELSE 'changed' END AS kind,
       p.digest AS primary_digest, r.digest AS replica_digest, 1::bigint AS primary_records, coalesce(r.n, 0)::bigint AS replica_records,
       (p.upto - p.bytes)::bigint AS range_start, p.upto::bigint AS range_end
FROM placed p LEFT JOIN r ON r.page_id = p.page_id WHERE r.digest IS DISTINCT FROM p.digest""",
}
