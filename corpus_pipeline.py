"""A corpus pipeline of five stages: each takes all that its predecessor kept.

Language ID rejects, repeated line runs go, one document of each near-duplicate group stays,
repeated 50-byte passages go, and what is left is packed into training sequences. All stages but the
last return the columns of ``documents``; n_chars follows the text. A document that loses its text
is kept with an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import langid, line_dedup, ngram_join, packing, suffix_dedup
from quantloom.llm.common import materialize, quoted
from quantloom.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language scores under the limit, go."""
    return langid.accept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; the documents stay."""
    return line_dedup.delete_in_place(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays, with all its rows; a null doc_id is in no group."""
    found = ngram_join.near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller doc_id has go; so do the rest of cut characters."""
    return suffix_dedup.remove_in_place(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), special=True)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", passages),
    ("best_fit_packing", packed),
]

#: Kernel regression, substring de-duplication and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
