"""The registered corpus queries: thin selections over the operators of this subpackage, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_bpe, divergence_rules, exact_dedup, html_blocks, lexical_search, merkle, mixing, quality_rules, simhash, source_audit, substring_dedup, token_files, toxicity
from .common import prepare, shared_dir, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, usable=remainder(4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4()}"
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, BYTE_BPE)
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.summary(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = quality_rules.score(docs, quality_rules.train(docs, labels, usable=remainder(3) != 1))
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality_rules.THRESHOLD).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = exact_dedup.digests(table(spark, sf_dir, "documents").select("doc_id", "text")).checkpoint()
    return exact_dedup.exact_groups(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence_rules.divergence_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.drop("char_distance", "word_distance")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


_GAPS = r"[\x20\x09-\x0D]+"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_GAPS}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""

OP9_SQL = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_GAPS}'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM w, unnest(range(1, len(words) - 11)) AS q(i) WHERE len(words) >= 13),
m AS (SELECT win, min(doc_id) AS least FROM s GROUP BY win),
r AS (SELECT DISTINCT doc_id, i + k AS pos FROM s JOIN m USING (win), range(0, 13) AS q(k) WHERE least < doc_id),
g AS (SELECT doc_id, count(*) AS gone FROM r GROUP BY doc_id),
p AS (SELECT doc_id, pos, words[pos] AS word FROM w, unnest(range(1, len(words) + 1)) AS q(pos)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN k ON w.doc_id = k.doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_token_files, op3_simhash, op4_html_blocks, op5_chunk_bpe, op6_quality, op7_mixing, op8_exact_dedup, op9_substring_dedup, op10_merkle, op11_divergence, op12_lexical_search, op13_source_audit)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_mixing": mixing.ORACLE_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_substring_dedup": OP9_SQL,
        "op11_divergence": divergence_rules.ORACLE_SQL,
        "op12_lexical_search": lexical_search.ORACLE_SQL,
        "op13_source_audit": source_audit.ORACLE_SQL,
    }
