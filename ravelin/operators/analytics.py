"""Descriptive analytics: counts, top-k, averages through a join, word frequencies, partition sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def containing(df: DataFrame, column: str, part: object) -> DataFrame:
    """Rows whose text form of ``column`` contains ``part`` anywhere."""
    return df.where(F.col(column).cast("string").contains(str(part)))


def count_distinct(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def top_counts(df: DataFrame, key: str, k: int, name: str = "n") -> DataFrame:
    """The k most frequent keys, ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key).limit(k)


def frequent_keys(df: DataFrame, key: str, above: int, name: str = "n") -> DataFrame:
    """Keys with strictly more than ``above`` rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > above)


def top_averages(df: DataFrame, key: str, value: str, k: int | None, name: str = "avg_value") -> DataFrame:
    """Keys by average, highest first, ties by key."""
    found = df.groupBy(key).agg(F.avg(value).alias(name))
    return found if k is None else found.orderBy(F.desc(name), key).limit(k)


def category_averages(ratings: DataFrame, categories: DataFrame, key: str, text: str, value: str, separator: str = ",") -> DataFrame:
    """Average value per category of ratings joined to ``categories``; null category texts are left out."""
    each = categories.where(F.col(text).isNotNull()).select(key, F.explode(tx.categories(F.col(text), separator)).alias("category"))
    return ratings.select(key, value).join(each, key).groupBy("category").agg(F.avg(value).alias("avg_value"), F.count(F.lit(1)).alias("n"))


def word_counts(df: DataFrame, column: str, stopwords=tx.STOPWORDS, keep_empty: bool = True) -> DataFrame:
    words = tx.clean_words(F.coalesce(F.col(column), F.lit("")), stopwords, keep_empty)
    return df.select(F.explode(words).alias("word"))


def dealt(df: DataFrame, n: int, by: Column) -> DataFrame:
    """``df`` in n partitions, each row where the integer ``by`` modulo n says."""
    return df.repartitionById(n, F.coalesce(F.pmod(by, F.lit(n)), F.lit(0)).cast("int"))


def partition_sizes(df: DataFrame, n: int, by: Column) -> DataFrame:
    """Rows of each of n partitions that a partitioner of the caller's deals to; empty partitions count 0."""
    sizes = dealt(df, n, by).groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("part"))
    return every.join(sizes, "part", "left").select("part", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def keep_matching(df: DataFrame, other: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows of ``df`` whose key is among the rows of ``other`` that satisfy the condition; duplicates stay."""
    return df.join(other.where(condition).select(key), key, "left_semi")


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """key and its 0-based place among the sorted distinct keys.

    Counts per range partition give each partition's start, so no sort runs in a single task.
    """
    from pyspark.sql import Window

    from ..sources.storage import materialize

    ranked = materialize(
        df.select(key).distinct().orderBy(key).select(key, F.spark_partition_id().alias("_p")).withColumn(
            "_r", F.row_number().over(Window.partitionBy("_p").orderBy(key))
        ), "ranked",
    )
    sizes = ranked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return ranked.join(F.broadcast(starts), "_p").select(key, (F.col("_s") + F.col("_r") - 1).alias("idx"))
