"""Stages that turn raw documents into packed sequences. Every stage but the last returns the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R
from gnomon.llm.exact import keep_exact
from gnomon.llm.near import keep_near
from gnomon.llm.packing import packed_documents
from gnomon.llm.secrets import redact
from gnomon.llm.toxicity import keep_clean

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on the labels, scores below one half.

    A null or empty text scores as one without terms; rows with a null id and repeated rows are judged like any other;
    without labels of both kinds all stay. Columns other than those of documents are left out; none gives none."""
    R.prepare(spark)
    return keep_clean(spark, docs.select(*COLUMNS), R.load(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id; one row of it where rows repeat it.

    Null and empty texts are one text; a null id stays only where no copy has an id. Columns other than those of
    documents are left out; none gives none."""
    R.prepare(spark)
    return keep_exact(spark, docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of documents whose five-word shingles have a similarity
    of 0.8 or more.

    Texts without words, and rows with a null id, are linked with nothing and stay; rows that repeat an id stay or go
    together. Columns other than those of documents are left out; none gives none."""
    R.prepare(spark)
    return keep_near(spark, docs.select(*COLUMNS), k=5, num=80, den=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars is the length of the new text, null for a null text.

    Texts without secrets, null and empty ones among them, stay as they are, and so does every row, repeated or without an
    id. Columns other than those of documents are left out; none gives none."""
    R.prepare(spark)
    out = redact(spark, docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of at most 1024 ids: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null or empty text is the end id alone; rows with a null id and repeated rows are packed like any other; none gives
    none."""
    R.prepare(spark)
    return packed_documents(spark, docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: The machine of the first stage is trained, and byte-pair ids of the last come from a library: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    R.prepare(spark)
    docs = R.load(spark, sf_dir, "documents")
    root = f"{R.scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        R.settle(spark)
    return docs
