"""What the operators of this folder share: typed Arrow maps, whole tables, lineage cuts."""

from __future__ import annotations

import gc
import pickle
import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staging
from . import textbytes as tb

__all__ = ["arrow_map", "compressed", "discard", "documents", "remove", "saved", "shared", "small_batches", "table", "tidy", "where_text"]

#: Bytes of rows after which Spark hands a batch to Python. A batch lies in both the JVM's direct memory and the worker's, in each running
#: task; Spark's own limit is 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of `BATCH_BYTES` from now on, unless the session's limit is lower. The session keeps the limit: what an operator returns is not run yet."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def saved(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; shuffle files that no plan refers to any more go.

    With `files`, into so many at most, or one a core if these are more, by tasks that read several partitions in turn. On local disks,
    without Hadoop's native library, each file costs its executor two processes that set modes.
    """
    spark = df.sparkSession
    out = staging.saved(df if files is None else df.coalesce(max(files, spark.sparkContext.defaultParallelism)), name)
    del df
    tidy(spark)
    return out


def compressed(df: DataFrame, name: str, *by: str) -> DataFrame:
    """As `saved`, with slower and smaller files, in folders by the given columns."""
    path = staging.scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles are done with: it acts on what the garbage collectors of both sides have let go."""
    for _ in range(2):  # what the first finds may still be held by events on their way
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def arrow_map(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict]) -> DataFrame:
    """Apply `fn` to each Arrow batch. It returns one dict of columns, or yields several."""
    names = [f.name for f in _parsed(schema).fields]

    def run(batches):
        for batch in batches:
            out = fn(batch)
            for columns in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([_array(columns[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A read-only value for tasks, broadcast with its class inside, so that workers need no copy of this package; a task unpacks it once."""
    packed, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), {}

    def get():
        if "value" not in held:
            held["value"] = pickle.loads(packed.value)
        return held["value"]

    return get


def where_text(docs: DataFrame, passes: Callable[[tb.Texts], np.ndarray]) -> DataFrame:
    """The rows whose text passes, with all their columns. Only the text goes through Python; rows are filtered where they are."""
    @F.arrow_udf("boolean")
    def keep(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for t in tb.slices(text):
            out[t.rows] = passes(t)
        return pa.array(out)

    return docs.where(keep(F.col("text").cast("string")))


def _array(values) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def _parsed(schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more."""
    for df in tables:
        for path in df.inputFiles()[:1]:
            remove(df.sparkSession, path.rpartition("/")[0])
