"""Cleaning of a training corpus in five stages, each an operator of ``stratafold.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is
written as Parquet in the shared folder and read again as the next one's docs. All
but the last return the columns of documents: doc_id, text, lang, source, n_chars;
further columns, whatever their names, are dropped. Every stage takes null columns,
empty and very long texts, repeated rows and empty tables; what it does with them
its own lines say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratafold.llm import decontamination, near_dedup, piece_codec, quality_rules, secrets
from stratafold.llm.kernels import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line field is trained on the documents given.

    Null and empty texts have no word and go; rows with a null id, and repeated rows, are judged each on its own; ties of
    the decoding count as content; a very long text is decoded whole; without labels the prior weights decide.
    """
    field = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs.select(*COLUMNS), field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least doc_id, of equal ids the first row.

    Null texts count as empty, and all texts without a word that are equal are one class; rows with a null id stay only if
    no row of their class has an id; a very long text is compared whole.
    """
    return near_dedup.keep(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; null and empty items match nothing; repeated rows and null ids are searched
    each on its own; a very long text is searched whole.
    """
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars of those recounted.

    Null texts stay null; rows with a null id and repeated rows are masked each on its own; spans that overlap are one
    mask; a very long text is scanned whole.
    """
    return secrets.redact(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip of every document.

    Null and empty texts have no token; null ids pass through, repeated rows give a row each; of pieces with equal rank
    the leftmost is joined first; a very long text is encoded whole.
    """
    return piece_codec.encode(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("pieces", encoded),
]

#: Training of a field, signatures, edit distances and segmentation are no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; a stage's folder is removed as soon as the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(path(f"{folder}/{k - 1}"), True)
    return docs
