"""Packing without padding: each document is cut into pieces of binary lengths, and every piece is a sequence of its own."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map

#: Bits of a sequence's number: the exponent of its length above the stream it was cut in, above its place among equal lengths there.
STREAM_BITS, NUMBER_BITS = 26, 32


def binary_lengths(total: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and length of each piece: as many of `size` as fit, then the powers of two that the rest is the sum of, the largest first."""
    top = size.bit_length() - 1
    whole = total // size
    bits = (total % size)[:, None] >> np.arange(top - 1, -1, -1) & 1
    of, place = np.nonzero(bits)
    of = np.concatenate([np.repeat(np.arange(len(total)), whole), of])
    length = np.concatenate([np.full(int(whole.sum()), size, np.int64), np.int64(1) << (top - 1 - place)])
    order = np.argsort(of, kind="stable")
    return of[order], length[order]


def binary_sequences(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece of every document, each with the id `end`.

    `size` is a power of two. A sequence is one piece, so none crosses documents, none is padded, and a document of n ids
    makes n // size pieces and one for each bit of the rest. Sequences are bucketed by length: `sequence_id` counts through one length
    after the other, so a range of it is a bucket. Numbers come from the place of a piece in its input partition; nothing is shuffled or
    counted beforehand, and a partition of any size is read slice by slice.

    Null and empty texts are the id `end` alone, one piece of length 1. Rows that share a doc_id, or have none, are documents of their
    own. Texts of any length are cut whole. Other columns are left out; an empty table gives an empty result.
    """
    if size < 1 or size & (size - 1):
        raise ValueError(f"{size} is no power of two")
    top = size.bit_length()

    def cut(batches):
        stream, count = TaskContext.get().partitionId(), np.zeros(top, np.int64)
        if stream >> STREAM_BITS:
            raise ValueError(f"more than {1 << STREAM_BITS} input partitions")
        for batch in batches:
            for rows, ids, cuts in tokens.encoded(batch.column(1), tokenizer, end):
                total = np.diff(cuts)
                of, length = binary_lengths(total, size)
                at = np.cumsum(length) - length
                power = np.searchsorted(np.int64(1) << np.arange(top), length)
                number = np.zeros(len(of), np.int64)
                for k in np.unique(power).tolist():
                    same = np.flatnonzero(power == k)
                    number[same] = count[k] + np.arange(len(same))
                    count[k] += len(same)
                if int(count.max()) >> NUMBER_BITS:
                    raise ValueError(f"more than {1 << NUMBER_BITS} pieces of one length in an input partition")
                raw = ids.astype("<u4", copy=False)
                spans = list(zip(at.tolist(), (at + length).tolist(), strict=True))
                columns = [
                    batch.column(0).slice(rows.start, rows.stop - rows.start).take(pa.array(of)), pa.array(at - cuts[of]), pa.array(length),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()), pa.array(total[of]),
                    pa.array(power << (STREAM_BITS + NUMBER_BITS) | stream << NUMBER_BITS | number), pa.array(np.zeros(len(of), np.int64)),
                ]
                if keep_ids:
                    columns.append(pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Write sequences with their ids, a folder for each length, so that a training batch is read from one of them."""
    sequences.select("doc_id", "start", "sequence_id", "ids", "length").write.option("compression", "zstd").partitionBy("length").parquet(path)


def bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length, from its folder alone; `ids` as an array of numbers."""
    rows = spark.read.parquet(path).where(F.col("length") == length)

    def read(batch):
        ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(3).to_pylist()]
        yield {"doc_id": batch.column(0), "start": batch.column(1), "sequence_id": batch.column(2), "ids": pa.array(ids, pa.list_(pa.int64()))}

    return arrow_map(rows.select("doc_id", "start", "sequence_id", "ids"), "doc_id long, start long, sequence_id long, ids array<long>", read)
