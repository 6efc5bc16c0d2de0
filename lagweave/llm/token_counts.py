"""Token counts of documents in flat token streams: separators searched block by block, boundaries stitched by a prefix scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, compressed

#: Ids in a block of a stream.
BLOCK = 1 << 17


def token_streams(docs: DataFrame, tokenizer: str, end: int, dtype: str = "<u2", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents as flat streams of ids, one for each input partition, each document's ids followed by `end`.

    Returns the blocks (stream, block, ids), cut every `block` ids wherever that falls, and which document came in which place (doc_id,
    stream, place), which the scan does not use. Both are written in one pass over the texts. Names of special tokens in a text
    are ordinary text, so `end` only ends documents.
    """
    schema = "kind int, stream long, block long, ids binary, doc_ids array<long>"
    top = np.iinfo(np.dtype(dtype)).max

    def write(batches):
        stream, held, count, at, place = TaskContext.get().partitionId(), [], 0, 0, 0

        def rows(parts, kind):
            n = len(parts)
            made = {"kind": [kind] * n, "stream": [stream] * n, "block": [p[0] for p in parts], "ids": [p[1] for p in parts], "doc_ids": [p[2] for p in parts]}
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made.values(), types, strict=True)], names=list(made))

        for batch in batches:
            for span, ids, _ in tokens.encoded(batch.column(1), tokenizer, end, literal=True):
                if len(ids) and int(ids.max()) > top:
                    raise ValueError(f"id {ids.max()} does not fit {dtype}")
                own = batch.column(0).slice(span.start, span.stop - span.start).to_pylist()
                yield rows([(place, None, own)], 1)
                place += len(own)
                held.append(ids.astype(dtype))
                count += len(ids)
                if count >= 8 * block:
                    flat = np.concatenate(held)
                    whole = len(flat) // block
                    yield rows([(at + k, flat[k * block:(k + 1) * block].tobytes(), None) for k in range(whole)], 0)
                    at, held, count = at + whole, [flat[whole * block:]], len(flat) - whole * block
        if count:
            flat = np.concatenate(held)
            yield rows([(at + k, flat[i:i + block].tobytes(), None) for k, i in enumerate(range(0, len(flat), block))], 0)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kept = compressed(source.mapInArrow(write, schema), "streams", "kind")
    order = kept.where("kind = 1").select("stream", "block", F.posexplode("doc_ids").alias("_k", "doc_id"))
    return kept.where("kind = 0").select("stream", "block", "ids"), order.select("doc_id", "stream", (F.col("block") + F.col("_k")).alias("place"))


def file_streams(spark: SparkSession, path: str, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Blocks of flat files of ids below `path`: stream (number of the file by name), block, ids, file.

    A file comes as one value, so it has to be smaller than 2 GB; longer streams are to be kept as more files or as blocks.
    """
    size = np.dtype(dtype).itemsize * block

    def cut(batch):
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = memoryview(content.as_buffer())
            if len(raw) % np.dtype(dtype).itemsize:
                raise ValueError(f"{file} does not hold whole ids")
            n = max(1, -(-len(raw) // size))
            for k in range(n):
                yield {"file": [file], "block": pa.array([k], pa.int64()), "ids": [bytes(raw[k * size:(k + 1) * size])]}

    files = spark.read.format("binaryFile").load(path)
    blocks = arrow_map(files.select("path", "content"), "file string, block long, ids binary", cut)
    number = files.select(F.col("path").alias("file"), (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("stream"))
    return blocks.join(number, "file").select("stream", "block", "ids", "file")


def count_tokens(blocks: DataFrame, end: int, dtype: str = "<u2") -> DataFrame:
    """stream, place, n_tokens, ended: for each document of each stream, its ids before the separator.

    blocks: stream, block (order within the stream), ids; other columns are left out. A block knows the ids before its first separator,
    between separators, and after its last. What a block carries into the next is the running sum of open ends since the last
    block with a separator, and places are the running count of separators: two window sums over rows of blocks, not ids. Ids
    after the last separator of a stream are a document with `ended` false. Two separators in a row have an empty document
    between them. Null and empty blocks hold nothing; an empty table gives an empty result.
    """
    def search(batch):
        n, found = [], []
        for value in batch.column(2):
            ids = np.frombuffer(value.as_buffer(), dtype) if value.is_valid else np.zeros(0, dtype)
            n.append(len(ids))
            found.append(np.flatnonzero(ids == end))
        return {
            "stream": batch.column(0), "block": batch.column(1), "separators": pa.array([len(x) for x in found], pa.int64()),
            "open": pa.array([k - x[-1] - 1 if len(x) else k for k, x in zip(n, found, strict=True)], pa.int64()),
            "lengths": pa.array([np.diff(x, prepend=-1) - 1 for x in found], pa.list_(pa.int64())),
        }

    seen = arrow_map(blocks.select(F.col("stream").cast("long"), F.col("block").cast("long"), "ids"),
                     "stream long, block long, separators long, open long, lengths array<long>", search)
    order = Window.partitionBy("stream").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = seen.withColumns({"_open": F.coalesce(F.sum("open").over(before), F.lit(0)), "_place": F.coalesce(F.sum("separators").over(before), F.lit(0)),
                             "_end": F.lead("block").over(order).isNull()})
    since = F.last(F.when(F.col("separators") > 0, F.col("_open")), ignorenulls=True).over(before)
    scan = scan.withColumn("carry", F.col("_open") - F.coalesce(since, F.lit(0)))
    docs = scan.select("stream", "_place", "carry", F.posexplode("lengths").alias("_k", "n"))
    docs = docs.select("stream", (F.col("_place") + F.col("_k")).alias("place"), (F.col("n") + F.when(F.col("_k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
                       F.lit(True).alias("ended"))
    left = F.col("open") + F.when(F.col("separators") == 0, F.col("carry")).otherwise(0)
    rest = scan.where(F.col("_end") & (left > 0))
    return docs.unionByName(rest.select("stream", (F.col("_place") + F.col("separators")).alias("place"), left.alias("n_tokens"), F.lit(False).alias("ended")))


def document_counts(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id, stream, place, n_tokens of every row of `docs`: written as flat streams, then counted from these.

    Null and empty texts have 0. Null ids stay null; rows that share an id are counted each for itself.
    """
    blocks, places = token_streams(docs, tokenizer, end)
    return places.join(count_tokens(blocks, end), ["stream", "place"]).select("doc_id", "stream", "place", "n_tokens")
