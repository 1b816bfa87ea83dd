"""Registered queries of this package and, where SQL can express one, its
DuckDB statement. Each query applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.llm import (adsampling, bundles, crf, decontam, deobfuscate, laesa, minhash, negatives, ownership,
                            pseudonyms, raking, rans, repeats)
from ledgermesh.llm.common import load, tidied

#: Key of the registered query; a real run passes a secret of its own.
PSEUDONYM_KEY = "registered query"
ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_documents(load(spark, sf_dir, "documents"), tokenizer_path())


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied("op3", lambda: ownership.report(load(spark, sf_dir, "documents"), F.col("source"),
                                                  F.concat_ws("/", "source", "lang")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deobfuscate.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(load(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(load(spark, sf_dir, "documents")).drop("h")


def op7_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied("op7", lambda: adsampling.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0))


def op8_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied("op8", lambda: raking.sample(load(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"),
                        "contaminated")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), num=85, den=100, bands=24).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabelled)


def op12_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.archive(load(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.cluster(load(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_rans_tokens": op1_rans_tokens,
    "op2_line_quality": op2_line_quality,
    "op3_secret_owners": op3_secret_owners,
    "op4_toxicity": op4_toxicity,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_repeats": op6_repeats,
    "op7_adaptive_scan": op7_adaptive_scan,
    "op8_raked_mix": op8_raked_mix,
    "op9_decontaminate": op9_decontaminate,
    "op10_minhash": op10_minhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_warc_bundles": op12_warc_bundles,
    "op13_pivot_clusters": op13_pivot_clusters,
}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {ASCII}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = {
    "op11_hard_negatives": negatives.oracle(),
    "op12_warc_bundles": bundles.oracle(),
    "op13_pivot_clusters": laesa.oracle(),
    "op3_secret_owners": ownership.oracle(),
    "op8_raked_mix": raking.oracle(),
    "op9_decontaminate": f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS k, least(len(w), 13) AS n
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    hit AS MATERIALIZED (SELECT doc_id, item_id, i, n FROM pos JOIN win USING (n, k)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
    s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
}
