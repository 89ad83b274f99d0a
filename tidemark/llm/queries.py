"""One query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe, conversations, forest, language_id, packing, phrases, sanitise, sharding, simhash, substring_dedup, templates, topk, warc,
)
from tidemark.llm.common import table
from tidemark.llm.sql import SQL as SQL
from tidemark.session import checkpoint, scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.deduplicate(docs, whole=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _count(spans: Column, kind: int) -> Column:
    # The lambda takes the span alone: Spark fills a second argument, default or not, with the place in the array.
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.spans(table(spark, sf_dir, "documents"))
    counts = [_count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(sanitise.KINDS)]
    base = F.sha2(sanitise.shown(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, sanitise.shown(F.col("spans")).alias("spans"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    records = checkpoint(warc.read(checkpoint(warc.index(spark, folder))))
    return warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(docs.filter("NOT held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return language_id.predict(docs, model, ("doc_id", "held_out"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    slim = docs.select("doc_id", "source", size.alias("size"), crc.alias("text_crc32"))
    dealt = sharding.deal(slim, carry=("size", "text_crc32"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return dealt.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii": op2_pii,
    "op3_exact_topk": op3_exact_topk,
    "op4_html": op4_html,
    "op5_ann_forest": op5_ann_forest,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_bpe": op9_bpe,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sharding": op12_sharding,
    "op13_phrases": op13_phrases,
}
