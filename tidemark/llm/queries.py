"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, embeddings, html_text, language, licenses, merkle, pieces, sharding, simhash
from tidemark.llm import token_files, toxicity, url_filter, variants
from tidemark.functions.staging import stage
from tidemark.llm.common import read, remainder

SHARDS = 24
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL, WORD_END = "word_bpe_49k.json", 1
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(spark, docs.filter(remainder("doc_id", 4) != 2), read(spark, folder, "labels"))
    rows = toxicity.score(spark, docs, model, keep=["doc_id"])
    return rows.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    rows = licenses.scan(read(spark, folder, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_max("matches.dice").alias("best_dice"),
    )


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.balanced_shards(sharding.sized(read(spark, folder, "documents")), SHARDS)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    marked = stage(simhash.fingerprints(read(spark, folder, "documents"), keep=["doc_id"]), "marked")
    groups = simhash.near_duplicate_groups(marked)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(spark, read(spark, folder, "documents"), read(spark, folder, "benchmark"), keep=["doc_id"])
    listed = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, span: total + span["length"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    profiles = language.learn_profiles(docs.filter(remainder("doc_id", 3) != 1))
    rows = language.identify(spark, docs, profiles, keep=["doc_id"])
    return rows.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(spark, read(spark, folder, "embeddings").select("vec_id", "embedding"))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = pieces.encode_and_decode(spark, read(spark, folder, "documents"), public_tokenizers.path(PIECE_MODEL), keep=["doc_id"])
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = html_text.extract(read(spark, folder, "pages"), keep=["page_id", "url"])
    return rows.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = url_filter.judge(read(spark, folder, "pages"), URL_RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Every second document, by its checksum, is seen again without its line feeds."""
    seen_text = F.when(remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = merkle.document_leaves(read(spark, folder, "documents"), LEAF_COLUMNS, {"text": seen_text})
    return merkle.audit(leaves)


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    manifest = token_files.write_token_files(spark, docs, public_tokenizers.path(WORD_MODEL), WORD_END)
    rows = token_files.read_token_files(manifest)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = variants.vocabulary(variants.spelled(read(spark, folder, "documents")))
    return variants.spelling_variants(words)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_language": op6_language,
    "op7_embeddings": op7_embeddings,
    "op8_pieces": op8_pieces,
    "op9_html_text": op9_html_text,
    "op10_url_filter": op10_url_filter,
    "op11_merkle": op11_merkle,
    "op12_token_files": op12_token_files,
    "op13_spelling": op13_spelling,
}
