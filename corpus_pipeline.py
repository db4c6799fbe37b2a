"""Corpus pipeline: toxicity, language, near duplicates, packing; every stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, packing, simhash, toxicity
from tessera.llm.registry import vocabulary
from tessera.session import checkpoint_dir, remove, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half; the model is learned from the labelled ones among them.

    Null and empty texts have no evidence and stay, unless most labelled documents are toxic; repeats are judged alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin that is not narrow for their length; their lang stays as it came.

    Null texts and texts without a letter go. Where no language could be learned, nothing can be judged and all stay.
    """
    model = langid.fit(docs)
    if not model.contents:
        return docs.select(*COLUMNS)
    return langid.predict(docs.select(*COLUMNS), model).filter("accepted").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more.

    Texts without a word are one group; rows with a null id stay; different texts under one id are told apart.
    """
    return simhash.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in windows of 2048 tokens; a null or empty text is its closing id alone."""
    out = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("language", keep_language), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: No stage but the last could be told in SQL: learned models, a 64-bit hash and a tokenizer decide. tests/llm hold it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Columns beyond those of the table are left out; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)  # nothing reads it any more
        before = f"{folder}/{name}"
    return docs
