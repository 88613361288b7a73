"""Push source: messages handed over one by one become a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Feed:
    """Buffers pushed text messages and appends them, ``size`` at a time, as numbered files of a folder.

    A file is written under a hidden name and renamed, so the stream sees whole files only. The
    folder is on the store that executors share; the writer needs the session it was opened with.
    """

    def __init__(self, path: str, size: int = 1000) -> None:
        self.path, self.size, self.rows, self.number = path, size, [], 0

    def push(self, message: str) -> None:
        self.rows.append(message)
        if len(self.rows) >= self.size:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        spark = SparkSession.getActiveSession()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        hidden, shown = path(f"{self.path}/_{self.number:012d}"), path(f"{self.path}/{self.number:012d}.txt")
        store = hidden.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = store.create(hidden, True)
        out.write(bytearray("".join(m.replace("\n", " ") + "\n" for m in self.rows), "utf-8"))
        out.close()
        store.rename(hidden, shown)
        self.rows, self.number = [], self.number + 1

    def close(self) -> None:
        self.flush()

    def stream(self, spark: SparkSession, files_per_batch: int = 1) -> DataFrame:
        """Column ``value``, one row a message, in the order of the files."""
        return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(self.path)
