"""The training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

run(spark, sf_dir) applies the stages to `documents`. Each stage takes (spark, docs, sf_dir); all but the
last return the columns of documents. Documents that the quality rules reject go; repeated chunks
of lines, and repeated runs of lines of 50 words or more, go from the later documents; one document of each near-duplicate group stays; documents with
benchmark passages go; what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinelink.llm import decontaminate, line_chunks, packing, quality_lines, simhash, similar
from kinelink.llm.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_lines.filter_documents(docs, count_copies=False)  # copies are left to near-dedup


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_chunks.remove_chunks(docs, words=line_chunks.PASSAGE_WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs, similarity=similar.SIMILARITY)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", benchmark), ("packing", pack)]

#: SQL expresses neither content-defined chunks, XXH64 fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
