"""The corpus pipeline: language ID, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept and returns a DataFrame; it is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.

Null and empty texts have no letter, so the first stage drops them. Rows without
a lang or a source form groups of their own in the second. Equal rows are near
duplicates of each other, rows without a doc_id included. Long texts pass whole.
Extra columns are kept up to the last stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorant.llm import langid, packing, quality, secrets, simhash
from quorant.llm.common import discard, documents, materialise, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language the model can't tell."""
    return langid.accepted(docs, langid.train(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or their group's adaptive thresholds."""
    return quality.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near-duplicates."""
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [SECRET] in the place of every secret."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("rules", rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("pack", pack)]

#: A trained network, XXH64 fingerprints and a tokenizer are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        # Its rows are written: nothing reads the stage before any more, nor what the operator wrote meanwhile.
        discard(spark, *last, *(p for p in made if p != docs.written_to))
        last = [docs.written_to]
    return STAGES[-1][1](spark, docs, sf_dir)
