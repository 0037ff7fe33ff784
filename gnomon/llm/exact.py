"""Exact duplicates by progressive refinement: length, then a prefix hash, then a full hash of what is left.

Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Everything runs as DataFrame
expressions. Each pass scans the texts, but hashes only those that the pass before left in doubt: a sieve of the lengths
held by several rows, then one of (length, prefix hash). Only (id, hash) rows are shuffled; whole rows are shuffled by
`keep_exact` alone, and of them those whose hash a second row has. No group is ever collected: counts and the largest id
are combined map-side, and a group's rows are dealt over many tasks when they look their group up.

Defined results: empty tables give empty results; null and empty texts are one text; a null id is never the largest
unless all ids of its group are null, and then stands for itself; rows repeated with the kept id are all marked as
kept, and `keep_exact` leaves one of them. Input columns other than id and text are not read by `exact_groups` and pass
through `keep_exact` untouched, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R

#: Characters covered by the prefix hash.
PREFIX_CHARS = 256


def folded(text: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() does just that where all characters are ASCII, and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _hashed(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, digest: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (in0 and so on: the input's columns, id, h: full hash, null where the refinement told the text apart), a table of their
    ids and hashes, and one of groups of several equal texts (h, size, keep, copies: rows with the kept id)."""
    rows, names = R.apart(docs)
    at = docs.columns.index
    rows = rows.select("*", F.col(names[at(id_col)]).alias("id"), F.coalesce(F.col(names[at(text_col)]), F.lit("")).alias("text"))
    rows = R.bound(rows, "n", F.octet_length("text"))
    lengths = rows.groupBy("n").count().where("count > 1")
    length_met = R.sieve(spark, lengths, "n")
    # The prefix hash of texts whose length others have; null stands for "told apart".
    prefix = F.xxhash64(folded(F.substring("text", 1, PREFIX_CHARS)))
    rows = R.bound(rows, "p", F.when(length_met("n"), prefix))
    prefixes = rows.where("p is not null").groupBy("n", "p").count().where("count > 1")
    prefix_met = R.sieve(spark, prefixes, "n", "p")
    alike = F.col("p").isNotNull() & prefix_met("n", "p")
    rows = R.bound(rows, "h", F.when(F.lit(digest) | alike, F.unhex(F.sha2(folded(F.col("text")), 256))))
    hashes = R.table(spark, rows.select("id", "h", alike.alias("alike")), "hashes")
    by_id = hashes.where("alike").groupBy("h", "id").agg(F.count("*").alias("c"))  # copies of one text seldom share an id
    best = F.max(F.struct("id", "c"))  # a null id is the least of all
    groups = by_id.groupBy("h").agg(F.sum("c").alias("size"), best.alias("best")).where("size > 1")
    groups = R.table(spark, groups.select("h", "size", F.col("best.id").alias("keep"), F.col("best.c").alias("copies")), "groups")
    return rows.select(*names, "id", "h"), hashes, groups


def exact_groups(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, full_hash (null for texts that the refinement told apart
    before it came to the full hash; with `digest`, the hash of every text)."""
    _, hashes, groups = _hashed(spark, docs.select(id_col, text_col), id_col, text_col, digest)
    met = R.attach(hashes, groups, ["h"], ["id"])
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return met.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("h")).alias("full_hash"),
    )


def keep_exact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, one row with the largest id."""
    rows, hashes, groups = _hashed(spark, docs, id_col, text_col)
    copied = F.coalesce(R.sieve(spark, groups, "h")("h"), F.lit(False)) & F.col("h").isNotNull()
    met = R.attach(rows.where(copied), groups, ["h"], ["id"], hashes.where("h is not null"))
    best = met.where(F.col("size").isNull() | F.col("id").eqNullSafe(F.col("keep")))
    names = rows.columns[:-2]
    once = best.where("size is null or copies = 1").select(*names)
    several = best.where("copies > 1").groupBy("h").agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return R.restored(rows.where(~copied).select(*names).unionByName(once).unionByName(several), docs)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.prepare(spark)
    return exact_groups(spark, R.load(spark, sf_dir, "documents"), digest=True).withColumnRenamed("full_hash", "text_sha256")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
