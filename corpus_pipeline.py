"""A training corpus in five stages, each written as Parquet and read again as the next one's documents.

toxicity: documents graded as toxic go. near_duplicates: one document of each group stays. decontamination: documents that hold
benchmark passages go. mixing: all documents, sorted by their turn in the source mixture (their row order is the decision).
token_files: the tokens of the mixture, in that order, as wavelet-matrix files; a digest row per document.

Every stage but the last returns the columns it is given, values and all, whatever their names. Rows without an id pass the near-duplicate stage; rows that share an id
count as one document there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlane.llm.common import read_table, scratch
from rosterlane.llm.decontaminate import uncontaminated
from rosterlane.llm.mixing import WEIGHTS, in_mixed_order
from rosterlane.llm.near_dup import deduplicate
from rosterlane.llm.token_files import read_tokens, write_tokens
from rosterlane.llm.tokens import tokenizer_file
from rosterlane.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(docs, WEIGHTS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage before wrote the rows in their order, so files and places in them give it; other inputs go by id."""
    path = scratch(spark)
    try:
        docs.select("_metadata.row_index")
        order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    except AnalysisException:
        order = [F.col("doc_id")]
    write_tokens(docs, path, tokenizer_file("byte_bpe_50k.json"), order)
    return read_tokens(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Training, components and tokenizing are beyond SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
