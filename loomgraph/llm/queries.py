"""One query per operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import fingerprints, lm_scoring, media, mixing, near_dedup, packing, quality, token_counts, url_filter, warc

#: Rules of op5, the first fields (host, path) of which decide before the model.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_words(_table(spark, folder, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), words=3, percent=85)


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(_table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, folder, "pages"), RULES, url_filter.fit()).select("page_id", "host", "path", "rule", "verdict")


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(_table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_media(spark: SparkSession, folder: str) -> DataFrame:
    return media.text_audio(_table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.score_quality(docs, quality.learn(docs, _table(spark, folder, "labels")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_scoring, op2_minhash_near_dedup, op3_warc, op4_token_counts, op5_url_filter, op6_best_fit_packing, op7_fingerprints, op8_mixing, op9_media, op10_quality)}


_OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
     s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(v) - 1)), lambda k: array_to_string(list_slice(v, CAST(k AS BIGINT), CAST(k AS BIGINT) + 2), ' '))) AS shingle FROM w WHERE len(v) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
     l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
     r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
     m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = doc_id
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
     w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM w
"""


def _op5_sql() -> str:
    weights = url_filter.fit()
    at = f"CAST([{','.join(map(str, weights[:-1]))}] AS DOUBLE[])"
    sums = " + ".join(f"coalesce(list_sum(list_transform(range(1, length(t) - {n - 2}), lambda k: w[CAST(('0x' || substr(md5(substr(t, CAST(k AS BIGINT), {n})), 1, 4)) AS INTEGER) % {url_filter.BUCKETS} + 1])), 0)" for n in url_filter.GRAMS)
    count = " + ".join(f"greatest(length(t) - {n - 1}, 0)" for n in url_filter.GRAMS)
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = [(v, r, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for v, r in rules for h, p in [url_filter.split_rule(r)]]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits) + " END"
    told = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, _, c in fits) + " END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
     g AS (SELECT *, '^' || host || path || '$' AS t, {rule} AS rule, {told} AS told FROM h),
     s AS (SELECT g.*, round({weights[-1]} + ({sums}) / greatest({count}, 1) * 8, 6) AS score FROM g, (SELECT {at} AS w))
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN host <> '' AND score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s
"""


_OP8 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
     l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
           FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST)),
     o AS (SELECT *, max(CASE WHEN cap > weight * level THEN level END) OVER () AS open FROM l),
     t AS (SELECT source, source_size, CASE WHEN open IS NULL THEN cap ELSE least(cap, weight * open) END AS target FROM o),
     r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": _OP2, "op3_warc": _OP3, "op5_url_filter": _op5_sql(), "op8_mixing": _OP8}
