"""Sources: JSON lines, headered CSV, word lists, chunked directories, models, streams, driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an input, by the optimizer's estimate, up to which it may be dealt again.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input in fewer partitions than there are cores, dealt evenly among them; any other input as it is.

    One small file is one task, which costly work on each row would keep a single core busy with. Larger
    inputs have partitions enough, so they are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def json_lines(spark: SparkSession, path: str, schema: str, bad_rows: str | None = None) -> DataFrame:
    """JSON lines with a known schema; malformed lines become nulls, kept in column ``bad_rows`` if asked for."""
    read = spark.read.option("mode", "PERMISSIVE")
    if bad_rows:
        return read.option("columnNameOfCorruptRecord", bad_rows).schema(f"{schema}, {bad_rows} string").json(path)
    return read.schema(schema).json(path)


def csv_with_header(spark: SparkSession, path: str, schema: str = schemas.PAIR) -> DataFrame:
    """Headered CSV; only the header line goes, not rows that equal it."""
    return spark.read.option("header", True).schema(schema).csv(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word a line: column ``word``, without empty lines."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def chunked_points(spark: SparkSession, path: str) -> DataFrame:
    """A directory of CSV files ``id,f1,...,fd``: id, vec, and chunk (the file's name, which orders the rounds)."""
    parts = F.split("value", ",")
    return spark.read.text(path).where("trim(value) <> ''").select(
        F.get(parts, F.lit(0)).alias("id"),
        F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"),
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("chunk"),
    )


def cf_model(spark: SparkSession, path: str, left: str = "b1", right: str = "b2") -> DataFrame:
    """A similarity model written by :func:`ravelin.sources.sinks.json_lines`: a, b, sim."""
    found = spark.read.schema(f"{left} string, {right} string, sim double").json(path)
    return found.select(F.col(left).alias("a"), F.col(right).alias("b"), "sim")


def profile_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Item and user profiles as written by :func:`ravelin.sources.sinks.profile_model`."""
    return spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/users")


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    """In-memory source."""
    return spark.createDataFrame(data, schema)


def socket_lines(spark: SparkSession, host: str = "localhost", port: int = 9999) -> DataFrame:
    """Streaming text lines from a socket: column ``value``."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_stream(spark: SparkSession, pattern: str, schema: str, form: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """Streaming files that match a glob, in arrival order."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(pattern)


def messages(stream: DataFrame, language: str | None = "en") -> DataFrame:
    """JSON messages (column ``value``) as tag and lang: the first tag of each; other languages are left out."""
    v = F.col("value")
    found = stream.select(
        v, F.get_json_object(v, "$.entities.hashtags[0].text").alias("tag"), F.get_json_object(v, "$.lang").alias("lang")
    )
    return found if language is None else found.where((F.col("lang") == language) | F.col("lang").isNull())
