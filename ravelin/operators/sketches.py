"""Sketches: Bloom filter, distinct counting by trailing zeros, top frequencies, reservoir sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing


def _number(text: Column) -> Column:
    """The number that all hashes of a text start from; callers keep it as a column, so that it is computed once a row."""
    return hashing.text_number(text, 2_147_483_647).alias("_number")


def _hashes(number: Column, k: int, m: int) -> list[Column]:
    return [hashing.affine(number, a, b, p, m) for _, a, b, p in hashing.family(k)]


def bloom_bits(df: DataFrame, column: str, m: int = 10_000, k: int = 5) -> DataFrame:
    """bit: the distinct set bits of all non-null, non-empty values; at most m rows."""
    text = F.col(column).cast("string")
    values = df.where(F.coalesce(text, F.lit("")) != "")
    return values.select(_number(text)).select(F.explode(F.array(*_hashes(F.col("_number"), k, m))).alias("bit")).distinct()


def bloom_probe(df: DataFrame, column: str, bits: DataFrame, m: int = 10_000, k: int = 5) -> DataFrame:
    """All columns and ``hit``: 1 if all k bits are set, 0 for null and empty values.

    The bits come to every row as one array of m / 64 numbers of 64 bits, of which each hash reads one.
    """
    text = F.col(column).cast("string")
    words = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v"))
    every = df.sparkSession.range(-(-m // 64)).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    whole = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("_bits"))
    known = lambda x: F.getbit(F.get("_bits", F.shiftright(x, 6).cast("int")), (x % 64).cast("int")) == 1
    hit = F.lit(True)
    for x in _hashes(F.col("_number"), k, m):
        hit = hit & known(x)
    numbered = df.select("*", _number(text)).join(F.broadcast(whole), F.lit(True))
    return numbered.withColumn("hit", F.when((F.coalesce(text, F.lit("")) != "") & hit, 1).otherwise(0)).drop("_bits", "_number")


def distinct_estimate(df: DataFrame, column: str, groups: int = 5, size: int = 10, bits: int = 9) -> DataFrame:
    """One row ``estimate``: hashes modulo 2**bits, the most trailing zeros r of each, the mean of 2**r in
    each group of ``size`` hashes, and the median over groups. Nulls are left out.

    The range caps the estimate: with 9 bits it is of use below about 200 distinct values. approx_count_distinct
    is the production alternative.
    """
    n = groups * size
    text = F.col(column).cast("string")
    zeros = [F.max(hashing.trailing_zeros(h)).alias(f"r{i}") for i, h in enumerate(_hashes(F.col("_number"), n, 1 << bits))]
    row = df.where(F.col(column).isNotNull()).select(F.col(column)).distinct().select(_number(text)).agg(*zeros)
    means = [sum(F.pow(F.lit(2.0), F.col(f"r{g * size + j}")) for j in range(size)) / size for g in range(groups)]
    each = row.select(F.explode(F.array(*means)).alias("x"))
    return each.agg(F.coalesce(F.percentile("x", F.lit(0.5)), F.lit(0.0)).alias("estimate"))


def top_frequencies(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """value, n of the values with the k highest distinct frequencies, all ties kept."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.select("n").distinct().orderBy(F.desc("n")).limit(k)  # k numbers
    return counts.join(F.broadcast(levels), "n", "left_semi").select("value", "n")


def drawn(key: str, seed: int) -> Column:
    """What a seeded draw goes by: the digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def reservoir(df: DataFrame, key: str, size: int = 100, seed: int = 3) -> DataFrame:
    """A uniform sample of ``size`` rows: the smallest seeded digests of the key (bottom-k)."""
    return df.orderBy(drawn(key, seed), key).limit(size)
