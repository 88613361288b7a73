"""Sinks: JSON objects and lines, CSV, itemset and community reports, streaming appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_object(df: DataFrame, path: str) -> None:
    """One row as a single JSON object; a row ``value`` of :func:`answers` as it is."""
    value = F.col("value") if df.columns == ["value"] else F.to_json(F.struct(*df.columns)).alias("value")
    df.limit(1).select(value).coalesce(1).write.mode("overwrite").text(path)


def ranked_object(df: DataFrame, order: list[Column], key: str = "result") -> DataFrame:
    """Small ranked rows as one row: a JSON object {key: [[col, ...], ...]} in the given order."""
    rank = [F.row_number().over(_window(order)).alias("_r"), *[F.col(c) for c in df.columns]]
    body = F.concat(F.lit("["), F.concat_ws(",", *[F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", "") for c in df.columns]), F.lit("]"))
    lines = df.select(*rank).select("_r", body.alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_r", "_b"))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["_b"]), ",")
    return lines.select(F.concat(F.lit('{"' + key + '":['), joined, F.lit("]}")).alias("value"))


def ranked_list(df: DataFrame, order: list[Column], name: str, only: str | None = None) -> DataFrame:
    """Small ranked rows as one row: column ``name``, a JSON list of [col, ...], or of column ``only``, in the given order."""
    body = F.to_json(F.array(F.col(only))) if only else F.concat(F.lit("["), F.concat_ws(",", *[F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", "") for c in df.columns]), F.lit("]"))
    body = F.regexp_replace(body, r"^\[|\]$", "") if only else body
    lines = df.select(F.row_number().over(_window(order)).alias("_r"), body.alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_r", "_b"))).alias("_l"))
    return lines.select(F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["_b"]), ","), F.lit("]")).alias(name))


def answers(parts: list[DataFrame]) -> DataFrame:
    """One row ``value``: a JSON object of one-row results (number or :func:`ranked_list`), one key a column."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(part, F.lit(True))  # one row each
    pairs = [F.concat(F.lit(f'"{c}":'), F.col(c).cast("string")) for c in whole.columns]
    return whole.select(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("value"))


def numbered(lines: DataFrame, part: int) -> DataFrame:
    """Report lines with their place: 1000 * part + line."""
    return lines.withColumn("place", F.lit(1000 * part).cast("long") + F.monotonically_increasing_id())


def _window(order: list[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_with_header(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def profile_model(items: DataFrame, users: DataFrame, path: str) -> None:
    items.write.mode("overwrite").parquet(f"{path}/items")
    users.write.mode("overwrite").parquet(f"{path}/users")


def itemset_lines(itemsets: DataFrame, title: str) -> DataFrame:
    """Report lines of itemsets (size, items): the title, then one line a size, ``('a')`` or ``('a', 'b')``.

    Itemsets are sorted and joined to pieces of text by all tasks; one task puts the pieces in line. A line is
    one value, so it must stay below 2 GB.
    """
    quoted = F.concat(F.lit("('"), F.array_join("items", "', '"), F.lit("')"))
    ordered = itemsets.select(F.col("size").cast("int").alias("size"), "items", quoted.alias("q")).repartitionByRange("size", "items").sortWithinPartitions("size", "items")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high > low:
                    text = ",".join(batch.column(2).slice(low, high - low).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 1), pa.array([place], pa.int64()), pa.array(sizes[low : low + 1]), pa.array([text])], names=["task", "place", "size", "text"])
                    place += 1

    def line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for size, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and size != now:
                    yield pa.RecordBatch.from_arrays([pa.array([",".join(held)])], names=["value"])
                    held = []
                now = size
                held.append(text)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([",".join(held)])], names=["value"])

    made = ordered.select(F.spark_partition_id().alias("task"), "size", "q").mapInArrow(pieces, "task int, place bigint, size int, text string")
    head = itemsets.sparkSession.createDataFrame([(0, 0, 0, f"{title}:")], made.schema)
    return head.unionByName(made).repartition(1).sortWithinPartitions("size", "task", "place").select("size", "text").mapInArrow(line, "value string")


def community_lines(communities: DataFrame) -> DataFrame:
    """One community (members array) a line, quoted members, smaller communities first."""
    quoted = F.array_join(F.transform("members", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")
    return communities.orderBy(F.size("members"), F.get("members", F.lit(0))).select(quoted.alias("value"))


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """``('a', 'b'), v``, highest betweenness first."""
    return edges.orderBy(F.desc("betweenness"), "u", "v").select(
        F.format_string("('%s', '%s'), %s", F.col("u").cast("string"), F.col("v").cast("string"), F.col("betweenness").cast("string")).alias("value")
    )


def assignment_object(labels: DataFrame) -> DataFrame:
    """{point: cluster or -1} as one JSON object; labels has id and cluster."""
    pair = F.struct(F.col("id").cast("string").alias("k"), F.coalesce(F.col("cluster"), F.lit(-1)).alias("v"))
    return labels.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(pair)))).alias("value"))


def bit_sequence(probed: DataFrame, order: str) -> DataFrame:
    """0/1 per input row in input order, separated by spaces."""
    rows = probed.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("hit").cast("int").alias("h")))).alias("l"))
    return rows.select(F.array_join(F.transform("l", lambda x: x["h"].cast("string")), " ").alias("value"))


def append_each_batch(path: str, form: str = "csv") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append the rows of every micro-batch, each batch once (its id is in the folder's name)."""

    def write(batch: DataFrame, number: int) -> None:
        where = f"{path}/batch={number}"
        if form == "text":
            batch.write.mode("overwrite").text(where)
        else:
            batch.write.mode("overwrite").option("header", True).format(form).save(where)

    return write
