"""Exact deduplication by 128-bit content hash, with a byte comparison inside every hash group.

Built-in functions only. The rows that are shuffled with their text are pre-aggregated map-side,
so a group of copies that holds a third of all rows reaches the shuffle as one row per task.

Defined cases: a null text is an empty text; all empty texts form one group. Rows with the same id
share one decision. A null id takes part in the group (size, hash) but is kept only if no row of its
group has an id. An empty table gives an empty result. Extra columns, whatever their names, are not
read; :func:`drop_copies` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, without


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), F.lit(SPACE), F.lit(" "))


def classes(docs: DataFrame, content_hash=F.md5) -> DataFrame:
    """One row per distinct text: hash, sha256, smallest id and size.

    Grouping by (hash, text) compares bytes only where the 128-bit hashes agree, so texts whose
    hashes collide stay apart.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), normalised().alias("_norm"))
    return (
        rows.groupBy(content_hash(F.col("_norm")).alias("_hash"), "_norm")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def decide(docs: DataFrame, content_hash=F.md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    The rows meet their class by (hash, sha256) without their text: the 128-bit hash alone may
    collide, and then the second digest tells the byte-compared classes apart.
    """
    rows = docs.select("doc_id", normalised().alias("_norm")).select(
        "doc_id", content_hash(F.col("_norm")).alias("_hash"), F.sha2("_norm", 256).alias("text_sha256")
    )
    found = rows.join(classes(docs, content_hash), ["_hash", "text_sha256"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return without(docs, decide(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()), "copies")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
