"""Training-order materialisation: sequences in the order of a keyed permutation, in shards of fixed stride."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from . import tokens
from .common import arrow_map, compressed, discard

#: Sequences of a shard, and of a chunk within it. A chunk is one value of CHUNK * stride ids.
SHARD, CHUNK = 4096, 256
ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def _feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in keys:
        left, right = right, left ^ (tb.mixed(right + np.uint64(key)) & mask)
    return left << np.uint64(half) | right


def _keys(key: int) -> list[int]:
    return [int(k) for k in tb.mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tb.mixed(np.array([key % (1 << 64)], np.uint64)))]


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n - 1 that the key picks: balanced Feistel rounds over the next power of four, walked until the value is below n."""
    half, keys = _half_bits(n), _keys(key)
    out = _feistel(index.astype(np.uint64), half, keys)
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = _feistel(out[beyond], half, keys)
    return out.astype(np.int64)


def _inverse(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    half, keys = _half_bits(n), _keys(key)
    mask = np.uint64((1 << half) - 1)

    def back(x):
        left, right = x >> np.uint64(half), x & mask
        for k in reversed(keys):
            left, right = right ^ (tb.mixed(left + np.uint64(k)) & mask), left
        return left << np.uint64(half) | right

    out = back(slot.astype(np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = back(out[beyond])
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, stride: int, end: int, pad: int, dtype: str) -> DataFrame:
    """stream, number, ids, doc_ids: each input partition's documents one after the other, each followed by `end`, cut every `stride` ids.

    The last sequence of a stream is filled up with `pad`. doc_ids are those of the documents that a sequence holds ids of, in order.
    """
    schema = "stream long, number long, ids binary, doc_ids array<long>"
    top = np.iinfo(np.dtype(dtype)).max

    def write(batches):
        stream, number = TaskContext.get().partitionId(), 0
        flat, cuts, owners = np.zeros(0, dtype), [0], []

        def rows(whole):
            starts = np.searchsorted(cuts, np.arange(whole) * stride, side="right") - 1
            ends = np.searchsorted(cuts, (np.arange(whole) + 1) * stride, side="left")
            return pa.RecordBatch.from_arrays([
                pa.array([stream] * whole, pa.int64()), pa.array(range(number, number + whole), pa.int64()),
                pa.array([flat[k * stride:(k + 1) * stride].tobytes() for k in range(whole)], pa.binary()),
                pa.array([owners[a:b] for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64()))], names=["stream", "number", "ids", "doc_ids"])

        for batch in batches:
            for span, ids, own in tokens.encoded(batch.column(1), tokenizer, end, literal=True):
                if len(ids) and int(ids.max()) > top:
                    raise ValueError(f"id {ids.max()} does not fit {dtype}")
                cuts = np.concatenate((cuts, len(flat) + own[1:])).astype(np.int64)
                flat = np.concatenate((flat, ids.astype(dtype)))
                owners = owners + batch.column(0).slice(span.start, span.stop - span.start).to_pylist()
                if whole := len(flat) // stride:
                    yield rows(whole)
                    number += whole
                    flat = flat[whole * stride:]
                    gone = int(np.searchsorted(cuts, whole * stride, side="right")) - 1
                    owners, cuts = owners[gone:], np.maximum(cuts[gone:] - whole * stride, 0)
        if len(flat):
            flat = np.concatenate((flat, np.full(stride - len(flat), pad, dtype)))
            cuts = np.append(cuts[:-1], stride)
            yield rows(1)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(write, schema)


_SHARDS = "shard long, chunk int, first_slot long, n int, ids binary, doc_ids array<array<long>>"


def materialize(seqs: DataFrame, key: int, stride: int, dtype: str = "<u2", shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """Write sequences (stream, number, ids, doc_ids) in training order and return the shards as a table (shard, chunk, first_slot, n, ids, doc_ids).

    A sequence's index is its number after all sequences of earlier streams; its slot is the permuted index. Shard k holds the slots from
    k * shard on, chunk c of it those from c * chunk on; a chunk's ids are n sequences of `stride` ids each, one after the other,
    so slot s lies at a place that its number gives, and reading can begin anywhere. The same key gives the same order for
    the same sequences. Sequences cross the network once, packed by target shard; a shard is the most that one task holds.
    The shards lie in one folder each. Only the number of sequences in each stream (one for each input partition) comes to the driver.
    """
    counts = sorted((r["stream"], r["n"]) for r in seqs.groupBy("stream").agg(F.count("*").alias("n")).collect())
    total, offset = 0, {}
    for stream, n in counts:
        offset[stream] = total
        total += n
    shared = seqs.sparkSession.sparkContext.broadcast(offset)

    def deal(batch):
        begin = np.fromiter(map(shared.value.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
        slot = slots(begin + batch.column(1).to_numpy(), total, key)
        order = np.argsort(slot)
        slot, batch = slot[order], batch.take(pa.array(order))
        target = slot // shard
        edges = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True]))) if len(slot) else [0]
        pack = zstandard.ZstdCompressor(level=3)
        ids = batch.column(2).to_pylist()
        pairs = list(zip(edges[:-1], edges[1:], strict=True))
        yield {"shard": pa.array([int(target[a]) for a, _ in pairs], pa.int64()), "slots": pa.array([slot[a:b] for a, b in pairs], pa.list_(pa.int64())),
               "ids": pa.array([pack.compress(b"".join(ids[a:b])) for a, b in pairs], pa.binary()),
               "doc_ids": pa.array([batch.column(3).slice(a, b - a).to_pylist() for a, b in pairs], pa.list_(pa.list_(pa.int64())))}

    wide = np.dtype(dtype).itemsize * stride

    def write(table: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"shard": pa.array([], pa.int64())})
        number = table["shard"][0].as_py()
        slot = np.concatenate([np.array(x, np.int64) for x in table["slots"].to_pylist()])
        unpack = zstandard.ZstdDecompressor()
        raw = np.concatenate([np.frombuffer(unpack.decompress(x), np.uint8) for x in table["ids"].to_pylist()]).reshape(-1, wide)
        docs = [d for x in table["doc_ids"].to_pylist() for d in x]
        order = np.argsort(slot)
        raw, docs = raw[order], [docs[i] for i in order]
        firsts = range(0, len(order), chunk)
        return pa.table({
            "shard": pa.array([number] * len(firsts), pa.int64()), "chunk": pa.array(range(len(firsts)), pa.int32()),
            "first_slot": pa.array([number * shard + i for i in firsts], pa.int64()), "n": pa.array([min(chunk, len(order) - i) for i in firsts], pa.int32()),
            "ids": pa.array([raw[i:i + chunk].tobytes() for i in firsts], pa.binary()), "doc_ids": pa.array([docs[i:i + chunk] for i in firsts], pa.list_(pa.list_(pa.int64())))})

    dealt = arrow_map(seqs, "shard long, slots array<long>, ids binary, doc_ids array<array<long>>", deal)
    return compressed(dealt.groupBy("shard").applyInArrow(write, _SHARDS), "shards", "shard").select("shard", "chunk", "first_slot", "n", "ids", "doc_ids")


def read_from(shards: DataFrame, slot: int, shard: int = SHARD) -> DataFrame:
    """The chunks that hold `slot` and all later ones, in order; earlier shards are not read."""
    return shards.where((F.col("shard") >= slot // shard) & (F.col("first_slot") + F.col("n") > slot)).orderBy("shard", "chunk")


def resumed(shards: DataFrame, slot: int, stride: int, dtype: str = "<u2", shard: int = SHARD) -> Iterator[np.ndarray]:
    """Sequences from `slot` on, one after the other, a chunk in memory at a time."""
    for row in read_from(shards, slot, shard).toLocalIterator():
        ids = np.frombuffer(row["ids"], dtype).reshape(-1, stride)
        yield from ids[max(0, slot - row["first_slot"]):]


def ordered_documents(docs: DataFrame, tokenizer: str, key: int, stride: int = 2048, end: int = 49407, pad: int = 0, dtype: str = "<u2") -> DataFrame:
    """slot, shard, chunk, place (in the chunk), ids_crc32, doc_ids of every sequence, read back from the shards.

    Null and empty texts are the id `end` alone. Null ids stay null among doc_ids; equal rows are documents each for itself. An empty
    table has no sequence.
    """
    seqs = compressed(sequences(docs, tokenizer, stride, end, pad, dtype), "sequences")
    shards = materialize(seqs, key, stride, dtype)
    discard(seqs)
    wide = np.dtype(dtype).itemsize * stride

    def read(batch):
        for shard, chunk, first, n, ids, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield {"slot": pa.array(range(first, first + n), pa.int64()), "shard": pa.array([shard] * n, pa.int64()), "chunk": pa.array([chunk] * n, pa.int32()),
                   "place": pa.array(range(n), pa.int32()), "ids_crc32": pa.array([zlib.crc32(ids[k * wide:(k + 1) * wide]) for k in range(n)], pa.int64()),
                   "doc_ids": pa.array(own, pa.list_(pa.int64()))}

    return arrow_map(shards, "slot long, shard long, chunk int, place int, ids_crc32 long, doc_ids array<long>", read)
