"""Best-two-fit packing of token sequences, planned on the histogram of lengths and carried out as joins."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, saved

#: Rows of one length that one task numbers; a length with more of them is cut into this many rows a bucket.
BUCKET_ROWS = 50_000


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """Cut each document's ids (and the id `end`) into pieces of at most `size`: doc_id, piece, start, length, ids_crc32 (and ids).

    Null and empty texts have the one id `end`. Rows that share a doc_id are cut as documents of their own.
    """
    def cut(batch):
        doc_id, text = batch.column(0), batch.column(1)
        for rows, ids, cuts in tokens.encoded(text, tokenizer, end):
            total = np.diff(cuts)
            count = -(-total // size)
            of = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * size
            length = np.minimum(size, total[of] - start)
            at = cuts[of] + start
            raw = ids.astype("<u4", copy=False)
            out = {
                "doc_id": doc_id.slice(rows.start, rows.stop - rows.start).take(of), "piece": piece.astype(np.int32), "start": start,
                "length": length, "ids_crc32": np.fromiter((zlib.crc32(raw[a:a + n]) for a, n in zip(at, length, strict=True)), np.int64, len(at)),
            }
            if keep_ids:
                out["ids"] = [raw[a:a + n].tobytes() for a, n in zip(at, length, strict=True)]
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, cut)


def plan(counts: np.ndarray, size: int) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths from the largest to the smallest) for counts[n] sequences of each length n <= size.

    Fill greedily: the longest sequence left, then again and again the longest that fits. Then drop the smallest of the bin
    if two unpacked ones fill the gap and its place more tightly; take the tightest two. A pattern is repeated for as long as
    the lengths it uses last: the same bins as one by one, in at most some steps for each length, however many sequences.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    bins = []
    while len(open_ := np.flatnonzero(left)):
        items, gap = [int(open_[-1])], size - int(open_[-1])
        left[items[0]] -= 1
        while gap and (fits := np.flatnonzero(left[:gap + 1])).size:
            items.append(int(fits[-1]))
            left[items[-1]] -= 1
            gap -= items[-1]
        if gap and len(items) > 1:
            room = gap + items[-1]
            a = np.flatnonzero(left[:room + 1])
            if a.size:
                # For each length the longest that fits beside it; a length paired with itself needs two of them.
                at = np.searchsorted(a, room - a, side="right") - 1
                own = (at >= 0) & (a[np.maximum(at, 0)] == a) & (left[a] < 2)
                at = at - own
                total = np.where(at >= 0, a + a[np.maximum(at, 0)], 0)
                best = int(total.argmax())
                if total[best] > items[-1]:
                    left[items[-1]] += 1
                    items[-1:] = sorted((int(a[best]), int(a[at[best]])), reverse=True)
                    left[items[-2]] -= 1
                    left[items[-1]] -= 1
        need, used = np.unique(items, return_counts=True)
        more = int((left[need] // used).min())
        left[need] -= more * used
        bins.append((1 + more, items))
    return bins


def pack(parts: DataFrame, size: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` from 1 to `size`; other columns are kept. As few sequences as the method finds.

    Only the counts of the lengths (`size` numbers) reach the driver, which plans bins by length. Each bin place is a range of
    the rows of one length, so every row finds its place by its number among them. Rows are numbered within buckets of a length, so that
    no length has to fit one task. Equal rows get places of their own. An empty table gives an empty result.
    """
    spark = parts.sparkSession
    clash = [c for c in parts.columns if c in ("sequence_id", "offset")]
    parts = parts.drop(*clash)
    by_length = parts.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(size + 1, np.int64)
    for row in by_length:
        if row["length"] is None or not 1 <= row["length"] <= size:
            raise ValueError(f"length {row['length']} is not between 1 and {size}")
        counts[row["length"]] = row["n"]
    places, first, taken = [], 0, np.zeros(size + 1, np.int64)
    for many, items in plan(counts, size):
        offset = 0
        for n in items:
            places.append((n, int(taken[n]), int(taken[n]) + many, first, offset))
            taken[n] += many
            offset += n
        first += many
    places = spark.createDataFrame(places, "length long, low long, high long, first long, offset long")

    buckets = max(1, int(counts.max()) // BUCKET_ROWS)
    keyed = parts.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in parts.columns]), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    starts = starts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    order = [F.col(f"`{c}`") for c in parts.columns]
    ranked = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1)
    ranked = ranked.join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    # A length has at most as many places as there are patterns; their starts in order find a row's place without a range join.
    by_place = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("_places"))
    found = ranked.join(F.broadcast(by_place), "length").withColumn("_place", F.expr(
        "element_at(filter(_places, p -> p.low <= _rank and _rank < p.high), 1)"))
    return found.select(*[F.col(f"`{c}`") for c in parts.columns], (F.col("_place.first") + F.col("_rank") - F.col("_place.low")).alias("sequence_id"),
                        F.col("_place.offset").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents. The pieces are saved first, so that texts are tokenised once.

    Given `keep_ids`, each row holds its ids as little-endian unsigned 32-bit numbers; a sequence is its rows in order of offset.
    """
    return pack(saved(pieces(docs, tokenizer, size, end, keep_ids), "pieces"), size)
