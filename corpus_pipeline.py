"""From raw documents to token ids: five stages, each over all that the one before kept.

``run`` writes each stage as Parquet in the shared folder and reads it again for the next.  The last stage
gives doc_id, n_tokens, and hashes of the ids and of the text decoded from them, one row for each
document that the mix takes (repeats included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlight.llm import bpe, mixing, quality_rules, secret_scan, simhash
from wardlight.llm.text import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have no words and are rejected; very long ones are judged whole; a row without id is judged like any other; repeated rows
    stay or go together; an empty table stays empty; further columns, whatever their names, stay as they are.
    """
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    It is one of smallest id, rows without id coming last; of several rows of that id the one whose text has the least hash, and of repeated
    rows one.  All texts without words are one group.  An empty table stays empty; further columns stay as they are.
    """
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; every document stays.

    Null texts stay null and empty ones empty; n_chars, if there and not null, follows the text; repeated rows are changed alike; an empty
    table stays empty; further columns stay as they are.
    """
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, up to twice.

    A null source is one of its own; texts without words have size 0 and sources of such alone give nothing; of rows equal in id, source and
    text, copies are dealt out over the rows; ties of size go by id, then by the text's hash; an empty table stays empty; further columns stay.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding.

    Null texts count as empty and have no ids; very long ones are encoded whole; repeated rows each give a row; an empty table gives none;
    only doc_id is carried on.
    """
    return bpe.round_trip(docs)


STAGES = [("quality_rules", quality), ("simhash_dedup", near_duplicates), ("secret_scan", secrets), ("mixing", mix), ("bpe", tokens)]

#: XXH64, trained trees and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
