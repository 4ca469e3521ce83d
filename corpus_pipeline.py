"""From documents to token-id files: quality, near-duplicates, benchmark leaks, mixing, output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm.common import table, written
from emberline.llm.decontamination import decontaminate
from emberline.llm.minhash import one_of_each
from emberline.llm.mixing import file_order, in_order, mix
from emberline.llm.quality import fit_quality, keep_good
from emberline.llm.queries import tokenizer_path
from emberline.llm.token_files import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on labels.quality, scores below 0.5."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in 0.8 or more of its shingles of five words."""
    return one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that leak a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: sources at shares in proportion to the square root of their documents."""
    return in_order(mix(docs, power=0.5, block_rows=8))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the order of the mix, written and read back: doc_id, start, n_tokens, ids_crc32, n_bytes."""
    placed = file_order(docs)
    return read_token_files(write_token_files(placed, tokenizer_path(), order=placed.columns[-1]))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
