"""The corpus pipeline: quality rules, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into the shared folder
and reads again for the next. All stages but the last return the columns of documents. No stage but the first reads
anything but its docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.bpe import default_path
from pathloom.llm.nearcopies import without_near_copies
from pathloom.llm.packing import pack_documents
from pathloom.llm.quality import document_stats, fit_quality, keep_good
from pathloom.llm.secrets import redact_documents
from pathloom.llm.store import drop_table, materialize, read_table, scratch
from pathloom.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the calibrated forest reject go, those of null and empty texts with them."""
    labels = read_table(spark, sf_dir, "labels")
    return keep_good(docs, fit_quality(document_stats(docs), labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies stays: a similarity of 0.8 or more on five-word
    shingles. Rows are told apart by doc_id and text: unlike texts of one doc_id are documents of their own, and so are
    those without doc_id, which come last."""
    return without_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of 20 words that an earlier document has go; documents without words left go."""
    return remove_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values become a marker; no document goes. Null and empty texts stay, repeated rows are each redacted."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids at most; null texts count as empty, repeated rows as documents."""
    return pack_documents(docs, default_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secrets), ("packing", packing)]

#: Fingerprints, windows of words and token ids have no SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; those of the stages before, and all that they made on the way, are deleted when the next is there."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs)
        if before is not None:
            drop_table(before)
        before = docs
    return docs
