"""The registered opN_ queries and the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, extraction, langid, mixing, packing, quality, simhash, tokencount, toxicity, warc
from .common import held_out, importable, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    """Where the public byte-level vocabulary lies, in its two forms, and the pattern that cuts texts for it."""
    import public_tokenizers

    return {"tokenizer_file": public_tokenizers.path("byte_bpe_50k.json"), "ranks_file": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, **tokenizer_files()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialize(simhash.fingerprints(docs), "fingerprints")
    return simhash.near_duplicates(prints).select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = materialize(quality.measure(docs, carry=["doc_id"]), "quality-measured")
    bands = quality.fit_measured(measured, table(spark, sf_dir, "labels"))
    return quality.judge(measured, bands).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "whole_ratio", "chunk_ratio_min", "chunk_ratio_max")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = tokencount.unigram_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.count_tokens(docs, vocabulary, carry=["doc_id"])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, manifest.warc_folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train_languages(docs)
    return langid.identify_languages(docs, model, carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat('mix-1|', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, (2 * source_size) / weight AS level FROM w),
c AS (SELECT *, sum(2 * source_size) OVER o - 2 * source_size AS full_before,
             sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left,
             sum(source_size) OVER () AS total
      FROM l WINDOW o AS (ORDER BY level, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - full_before::DOUBLE) / weight_left AS lam FROM c),
g AS (SELECT *, (SELECT arg_min(lam, level) FROM m WHERE lam <= level) AS common FROM m),
t AS (SELECT source, source_size,
             CASE WHEN common IS NULL OR common >= level THEN (2 * source_size)::DOUBLE ELSE common * weight END AS target FROM g),
b AS (SELECT *, least(round(target)::BIGINT, 2 * source_size) AS budget FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
             + least(greatest(budget - (budget // source_size) * source_size - start, 0), size) ELSE 0 END)::BIGINT AS taken
FROM p
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex,
             CAST(unhex(sha1(payload)) AS BIT)::VARCHAR AS bits FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS response_id, count(*) OVER (PARTITION BY hex, payload_bytes) AS n FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, 5 * i::INT + 1, 1)::INT + 8 * substr(bits, 5 * i::INT + 2, 1)::INT + 4 * substr(bits, 5 * i::INT + 3, 1)::INT
           + 2 * substr(bits, 5 * i::INT + 4, 1)::INT + substr(bits, 5 * i::INT + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN n = 1 OR page_id IS NOT DISTINCT FROM response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n = 1 OR page_id IS NOT DISTINCT FROM response_id THEN NULL ELSE response_id END AS refers_to
FROM m
"""

QUERIES = {
    "op1_pack_sequences": op1_pack_sequences,
    "op2_main_text": op2_main_text,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
}
ORACLES = {
    "op3_mix_sources": OP3_SQL,
    "op9_warc": OP9_SQL,
}
