"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, PII, byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, decontam, files, jaccard, langid, pii
from quadrille.shared import fresh_path

STAGES = [
    ("language_id", langid.stage),
    ("ngram_jaccard", jaccard.stage),
    ("decontaminate", decontam.stage),
    ("pii", pii.stage),
    ("bpe", bpe.stage),
]

#: The stages train classifiers and tokenise, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's result written to the shared folder and read again; what a stage wrote
    goes when the next one is done with it.

    Result: doc_id, tokens, n_tokens and round_trip of each document that stays, its personal spans replaced. Null, empty
    and blank texts, and texts without a letter, have no language and go in the first stage, whatever their other columns
    hold. A document with a null doc_id has no near duplicate and stays, with a null doc_id. Repeated rows are one
    document to the second stage: they all stay, or all go, as their doc_id is or isn't the smallest of its class; so do
    the texts of one doc_id. Ties of languages go to the first in alphabetical order, ties at the personal threshold
    count as personal. Texts of any length go through whole, in parts. Columns beside doc_id, text, lang, source and
    n_chars pass the first four stages as they are, whatever they are named, and are not in the result. An empty table
    gives no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            files.remove(before)
        before = out
    return docs
