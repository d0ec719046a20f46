"""A corpus from raw documents to packed sequences: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; what it returns is written and
read again as the next one's docs. All but the last return the columns of documents, and any further ones, whatever they are called.

Defined cases: a null or blank text has a low quality score and goes in the first stage; repeated rows are near-duplicates, of which one stays;
a null doc_id is kept where its row is; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landlace.llm import decontam, packing, pii, quality, similar
from landlace.llm.common import shared_dir, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; the classifier learns from labelled documents among these."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), 0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group: SimHash links of five-word shingles, verified by a Jaccard
    similarity of 0.8 or more. A row without an id stays only where its group has no other; rows of one id with different texts are different documents."""
    return similar.dedup(docs, words=5, tenths=8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 token ids."""
    return packing.pack(docs, packing.with_end("word_bpe_49k.json", 1), length=2048)


STAGES = [("quality", keep_quality), ("near_dedup", drop_copies), ("decontaminate", drop_leaks), ("redact", mask_personal), ("pack", pack)]

#: The stages are models, hashes and a tokenizer, which SQL can't say; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
