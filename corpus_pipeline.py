"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm.common import made, materialize, release, table
from voxloom.llm.decontam import drop_contaminated
from voxloom.llm.mixing import mixed_documents
from voxloom.llm.quality import keep_good
from voxloom.llm.queries import END_ID, tokenizer_path
from voxloom.llm.simhash import keep_one
from voxloom.llm.token_store import token_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that the rules or the forest reject.

    Null, empty and short texts fail the rules and go; repeated rows are judged alike; without
    labels the forest rejects nothing. An empty table stays empty.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, a row without one only where no other has one.

    Null and blank texts have one fingerprint, so one row of them stays; so does one of repeated rows.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item.

    Null texts hold none and stay; null items have no window; repeated rows go or stay alike.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, with the words taken then.

    Texts without words give no row; a null source is a source of its own, the last; repeated
    rows are taken each on its own.
    """
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents' ids, read back from the files.

    Null texts hold the end id alone; rows without doc_id come first; repeated rows are written each. An empty
    table gives no rows.
    """
    return token_digest(docs, tokenizer_path(), END_ID)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: The forest's verdicts, XXH64 and the tokenizer have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table documents; what each stage but the last keeps is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = len(made())
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, before, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
