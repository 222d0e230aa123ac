"""The registered queries of this folder: name, function of (spark, folder), SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


import corpus_pipeline
from evidence.llm import align, exact_dedup, langid, mixing, neighbours, pieces, quality, repair, sanitise, secrets, simhash, token_counts, url_filters
from evidence.session import scratch_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


URL_RULES = "VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"


def op1_url_filters(spark, folder):
    rules = spark.sql(f"SELECT * FROM ({URL_RULES}) AS r(host, path, verdict)")
    return url_filters.judge_urls(table(spark, folder, "pages"), rules)


OP1_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT DISTINCT host, path FROM p),
f AS (SELECT k.host, k.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
 FROM k JOIN ({URL_RULES}) AS r(host, path, verdict) ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
 GROUP BY k.host, k.path)
SELECT p.*, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (host, path)"""


def crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_language(spark, folder):
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(crc_mod(5) != 0))
    return langid.predict(docs, model).withColumn("held_out", crc_mod(5) == 0)


def op3_sentencepiece(spark, folder):
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.round_trip(table(spark, folder, "documents"), model)


def op4_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("row.*", F.col("copy_no").cast("bigint").alias("copy_no"), F.col("n_copies").cast("bigint").alias("n_copies"), "shuffle_key")


OP4_SQL = """
WITH s AS (SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
w AS (SELECT source, size, sqrt(size) AS weight FROM s),
r AS (SELECT source, (SELECT sum(size) FROM w) * (weight / (SELECT sum(weight) FROM w)) / size AS rate FROM w),
p AS (SELECT source, greatest(1, ceil(rate / 32.0))::BIGINT AS parts, rate / greatest(1, ceil(rate / 32.0)) AS mean FROM r),
terms AS (SELECT source, k, exp(-mean) * pow(mean, k) / gamma(k + 1) AS term FROM p, range(150) AS x(k)),
cdf AS (SELECT source, list(total ORDER BY k) AS cdf FROM (SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS total FROM terms) GROUP BY source),
d AS (SELECT documents.*, coalesce(doc_id::VARCHAR, sha256(coalesce(text, ''))) AS own, parts, cdf
 FROM documents JOIN p ON documents.source IS NOT DISTINCT FROM p.source JOIN cdf ON documents.source IS NOT DISTINCT FROM cdf.source),
n AS (SELECT *, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda c: c <
 (('0x' || substr(md5('mix:' || own || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0))))::BIGINT AS n_copies FROM d)
SELECT doc_id, text, lang, source, n_chars, copy_no, n_copies,
 ('0x' || substr(md5('mix:copy:' || own || ':' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM n)"""


def op5_neighbours(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_personal_data(spark, folder):
    return sanitise.find_personal_data(table(spark, folder, "documents"))


def op7_exact_dedup(spark, folder):
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


OP7_SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""


def op9_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_token_counts(spark, folder):
    # A cache of its own: what other runs have counted does not shorten this one.
    return token_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_dir(spark, "token-cache"))


def op10_quality(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels.where(crc_mod(3) != 1))
    return quality.score(docs, model).withColumn("held_out", crc_mod(3) == 1)


def op11_secrets(spark, folder):
    return secrets.find_secrets(table(spark, folder, "documents"))


def op12_alignment(spark, folder):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return align.link_tokens(table(spark, folder, "documents"), definition, pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


def op13_repair(spark, folder):
    return repair.repair_damaged(table(spark, folder, "conversations"))


QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_url_filters": (op1_url_filters, OP1_SQL),
    "op2_language": (op2_language, None),
    "op3_sentencepiece": (op3_sentencepiece, None),
    "op4_mixing": (op4_mixing, OP4_SQL),
    "op5_neighbours": (op5_neighbours, None),
    "op6_personal_data": (op6_personal_data, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_token_counts": (op8_token_counts, None),
    "op9_simhash": (op9_simhash, None),
    "op10_quality": (op10_quality, None),
    "op11_secrets": (op11_secrets, None),
    "op12_alignment": (op12_alignment, None),
    "op13_repair": (op13_repair, None),
}
