"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exactdup, langid, licenses, mixing, neardup, pii, secrets, urls, warc
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, shingle=2, percent=80)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exactdup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["order"] < pii.BASE)
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS], F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"), F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.KINDS[: secrets.BASE]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.records(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "verified")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix_sources": op3_mix_sources,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_secrets": op9_secrets,
    "op10_warc_archive": op10_warc_archive,
}

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '{_WORDS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '{_WORDS}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.n, g.s, p.item_id FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op3_mix_sources": """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM c)::DOUBLE) * (SELECT sum(n) FROM c)::DOUBLE / n AS rate FROM c),
d AS (SELECT d.*, greatest(ceil(r.rate / 16), 1)::BIGINT AS parts, r.rate / greatest(ceil(r.rate / 16), 1) AS p
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, list_sum(list_transform(range(1, parts + 1), lambda part: len(list_filter(range(0, 72), lambda j:
        list_sum(list_transform(range(0, j + 1), lambda i: exp(-p + i * ln(p) - lgamma(i + 1))))
        <= ('0x' || substr(md5('17:' || part || ':' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)))) AS copies FROM d)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, substr(md5('order17:' || doc_id || ':' || copy), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(0, copies::BIGINT)) AS copy FROM k WHERE copies > 0)""",
    "op6_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_ABC}) AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)""",
    "op10_warc_archive": """
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to, target_uri, true AS verified FROM f""",
}
