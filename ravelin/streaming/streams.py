"""Structured Streaming: windowed counts, running distinct estimates, a reservoir with a report after each event."""

from __future__ import annotations

import hashlib
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sketches
from ..sources.storage import fresh_path


def sliding_counts(stream: DataFrame, time: str, key: str, length: str = "30 seconds", slide: str = "10 seconds", late: str | None = None) -> DataFrame:
    """start, key, n per sliding event-time window; ``late`` sets a watermark (an extension)."""
    rows = stream.withColumn("_ts", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if late else rows
    found = rows.groupBy(F.window("_ts", length, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), key, "n")


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process all that is there, batch by batch, and return."""
    where = checkpoint or fresh_path(stream.sparkSession, "stream-state")
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], every: str = "5 seconds", mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Start micro-batches at an interval; the caller awaits or stops the query."""
    where = checkpoint or fresh_path(stream.sparkSession, "stream-state")
    return stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", where).trigger(processingTime=every).start()


def stop_after(query: StreamingQuery, seconds: float, idle: bool = False) -> None:
    """Stop a started query after a time, with ``idle`` as soon as it has taken all that is there; its error is raised."""
    ends = time.monotonic() + seconds
    while query.isActive and time.monotonic() < ends:
        if idle and query.lastProgress is not None:
            query.processAllAvailable()
            break
        query.awaitTermination(0.2)
    query.stop()
    if query.exception() is not None:
        raise query.exception()


def last_result(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a finite stream as a table: in complete mode the last batch holds all of it."""
    path = fresh_path(stream.sparkSession, "stream-result")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    run_to_end(stream, save, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def distinct_reports(stream: DataFrame, column: str, path: str, scope: str = "cumulative", **sketch) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append (batch, time, truth, estimate) as CSV after every batch.

    ``scope`` 'cumulative' counts all values since the start (kept as a table beside the reports, one part
    a batch, so that a repeated batch is counted once); 'window' counts the batch alone.
    """
    if scope not in ("cumulative", "window"):
        raise ValueError(f"scope must be 'cumulative' or 'window', not {scope!r}")
    spark = stream.sparkSession
    kind = dict(stream.dtypes)[column]

    def report(batch: DataFrame, number: int) -> None:
        values = batch.where(F.col(column).isNotNull()).select(column).distinct()
        if scope == "cumulative":
            values.write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
            values = spark.read.schema(f"{column} {kind}, batch int").parquet(f"{path}/seen").select(column).distinct()
        truth = values.agg(F.count(F.lit(1)).alias("truth"))
        row = truth.join(sketches.distinct_estimate(values, column, **sketch), F.lit(True)).select(
            F.date_trunc("second", F.current_timestamp()).alias("time"), "truth", "estimate"
        )
        row.write.mode("overwrite").option("header", True).csv(f"{path}/reports/batch={number}")

    return report


def reservoir_reports(stream: DataFrame, size: int = 100, top: int = 3, eligible_only_alpha: bool = False, seed: int = 5) -> DataFrame:
    """number, report: after every tagged event the tags with the ``top`` highest frequencies in a reservoir.

    stream: order, tag. One state holds the reservoir (``size`` tags) and the number of events. All are
    admitted up to ``size``, then each with probability size / n in a random slot. ``eligible_only_alpha``
    admits only alphabetic tags after that. The randomness is the digest of seed and the event's number. The
    exact report is one sequence by definition, so a micro-batch goes through one task: cap it at the source.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, kept = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        rows = pd.concat(list(batches))
        if not (np.diff(rows["order"].to_numpy()) > 0).all():
            rows = rows.sort_values(["order", "tag"])
        counts, report, first, out = Counter(kept), None, n + 1, []
        for tag in rows["tag"]:
            n += 1
            if len(kept) < size:
                kept.append(tag)
                counts[tag] += 1
                report = None
            elif not eligible_only_alpha or tag.isalpha():
                digest = hashlib.md5(b"%d:%d" % (seed, n)).digest()
                if int.from_bytes(digest[:4], "big") * n < size << 32:
                    slot = int.from_bytes(digest[4:8], "big") % size
                    counts[kept[slot]] -= 1
                    counts[tag] += 1
                    kept[slot], report = tag, None
            if report is None:  # it changes with the reservoir only
                counts = +counts
                levels = sorted(set(counts.values()), reverse=True)[:top]
                report = "; ".join(f"{t} : {-c}" for c, t in sorted((-c, t) for t, c in counts.items() if c in levels))
            out.append(report)
        state.update((n, kept))
        for low in range(0, len(out), 100_000):
            part = out[low : low + 100_000]
            yield pd.DataFrame({"number": np.arange(first + low, first + low + len(part)), "report": part})

    tagged = stream.where("tag IS NOT NULL AND tag <> ''").select(F.lit(0).alias("one"), "order", "tag")
    return tagged.groupBy("one").applyInPandasWithState(step, "number long, report string", "n long, kept array<string>", "append", "NoTimeout")
