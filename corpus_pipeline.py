"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

It counts as part of groundspan.llm and needs it; it stands at the top because that is where it is looked for. __spark_entry__.py
imports both behind one guard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundspan.llm import bpe, decontam, lines, simhash, toxicity
from groundspan.llm.common import delete_path, stored


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Rows with a null or empty text, or without letters and digits, stay; a null doc_id plays no part. Very long texts are read whole and judged by their highest window; a
    score at the threshold rejects. Repeated rows share a fate. Empty documents give no rows; without labels of both kinds all stay. Other columns, whatever their names, are kept.
    """
    return toxicity.drop_toxic(spark, docs, sf_dir)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in the corpus go but for their first place; all rows stay, and n_chars, if there, follows the text.

    A null or empty text stays as it is, and so does a row without doc_id. Very long texts are read whole. The first place is the least doc_id, then the least line; rows that repeat a
    doc_id keep the same line. An empty table gives no rows. Other columns, whatever their names, are kept.
    """
    return lines.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays.

    Rows with a null or empty text, without letters and digits, or without doc_id stay. Very long texts are read whole. A tied bit of a fingerprint is 0. Rows that repeat a doc_id are one
    document, and stay or go together. An empty table gives no rows. Other columns, whatever their names, are kept.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, but for a few edits, go.

    Rows with a null or empty text stay. Very long texts and items are read whole. A distance at the limit counts. Rows that repeat a doc_id, or have none, stay or go together. Without documents
    there are no rows, without items all stay. Other columns, whatever their names, are kept.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, n_tokens and round_trip; all rows stay.

    A null text has null results, an empty one no tokens. Very long texts are encoded whole. The merges leave no ties. Repeated rows have the same tokens. An empty table gives no rows. Columns that
    have the name of a result are replaced, others kept.
    """
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", repeated_lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level bpe", tokens),
]

#: The classifier, fingerprints, hashing of windows and tokens have no counterpart in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's table is deleted when the next one's is written, the last stays, as the result is read from it."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, following = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if path:
            delete_path(spark, path)
        path = following
    return docs
