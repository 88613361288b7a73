"""Helpers shared by the corpus operators: shared storage, bounded broadcasts, text columns."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table  # noqa: F401 - for the operators' queries
from ..sources.storage import materialize, shared_dir  # noqa: F401

#: The white space of every text contract in this package: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Largest number of (long) ids that is ever broadcast; about 64 MB as a hashed relation.
MAX_BROADCAST_IDS = 2_000_000
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Small Arrow batches from now on: texts may be long, and each batch exists in the JVM and in Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def trim() -> None:
    """Give memory that earlier tasks of this Python worker freed back to the system."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ease(spark: SparkSession) -> bool:
    """Give memory that earlier steps freed in the driver, Python and JVM, back to the system; whether the JVM could.

    Compiling the code of many plans leaves the JVM's native heap some 100 MB larger after each long step.
    """
    trim()
    try:
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        jvm.System.gc()
        kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        inner = gateway.new_array(jvm.java.lang.Object, 1)
        inner[0], args[3] = gateway.new_array(jvm.java.lang.String, 0), gateway.new_array(jvm.java.lang.String, 1)
        args[2], args[3][0] = inner, "[Ljava.lang.String;"
        types = gateway.new_array(jvm.java.lang.Class, 4)
        for k, kind in enumerate(kinds):
            types[k] = kind
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()  # its class is not public, its interface is
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, args)
    except Exception:  # noqa: BLE001 - another JVM, or none: only memory is lost
        return False
    return True


def text_of(column: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % modulus == remainder, F.lit(True))


def without(docs: DataFrame, dropped: DataFrame, name: str, id_column: str = "doc_id") -> DataFrame:
    """``docs`` without the ids in ``dropped``; all columns stay, rows with a null id stay.

    The dropped ids are written once and counted. Up to MAX_BROADCAST_IDS they are broadcast, so
    that no text is shuffled; beyond that both sides are shuffled by id.
    """
    ids = materialize(dropped.select(F.col(id_column).alias("_dropped")).distinct(), name)
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_column] == ids["_dropped"], "left_anti")


def only(docs: DataFrame, kept: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` whose id is in the materialised table ``kept`` (one row per id)."""
    ids = kept.select(F.col(id_column).alias("_kept"))
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_column] == ids["_kept"], "left_semi")


def sample_labels(labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled training ids, the same ones on every run, one row per id.

    Of contradicting rows for one id the larger label counts; null labels and ids are left out.
    """
    return (
        labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )


