"""From raw documents to packed training sequences, stage by stage.

Every stage takes what the one before kept, as Parquet, and all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, packing, sanitise, simhash, substring_dedup
from tidemark.llm.common import lean, table
from tidemark.session import checkpoint

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: The score from which on a predicted language replaces a given one.
SURE = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop null texts and those without a letter; ``lang`` becomes the language of the text, by which the last stage packs.

    A label is what the model learns from, and stays where the prediction is not sure. Without labels ``lang`` stays null.
    """
    lean(spark)
    model = language_id.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    # Numbered names, so that no column can clash with those of the prediction.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    named = language_id.predict(numbered, model, tuple(numbered.columns), text)
    # Without labels every prediction is undetermined, so it does not decide what stays.
    kept = named.filter(F.col(text).rlike(r"\p{L}"))
    lang = f"c{docs.columns.index('lang')}"
    told = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col(lang).isNull() | (F.col("score") >= SURE))
    return kept.withColumn(lang, F.when(told, F.col("lang_pred")).otherwise(F.col(lang))).select(*numbered.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near-duplicates."""
    lean(spark)
    return simhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 20 words or more that an earlier document, or place, has already."""
    lean(spark)
    cleaned = substring_dedup.deduplicate(docs, report=False)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind and hide the terms that would give it away."""
    lean(spark)
    return sanitise.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, each with its place in a sequence of at most 4096 tokens of one language."""
    lean(spark)
    return packing.pack(docs, WORD_BPE, by="lang")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs


#: The stages hash, tokenise and search in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None
