"""Ranked lexical search without random access: impact-sorted lists of document shards, read in step until the best are settled."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow_map, saved

#: Postings that each list gives in the first round; every round reads so many times what the one before did.
FIRST_DEPTH, DEEPER = 256, 4
#: Terms of test items in a block, documents in a shard, and postings in a shard unless one document has more. All bound memory only.
BLOCK_TERMS, SHARD_DOCS, SHARD_POSTINGS = 1_000_000, 1 << 16, 4_000_000

_GAP = np.zeros(256, bool)
_GAP[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _terms(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = tb.lowered(texts.data)
    return data, *tb.words(texts, _GAP)


@dataclass
class Items:
    """A block of test items: term numbers and how often each occurs, item after item; the terms' bytes to find them by."""

    ids: list
    first: int
    cuts: np.ndarray
    terms: np.ndarray
    times: np.ndarray
    known: tb.Dictionary

    def plain(self) -> dict:
        """What workers need, as arrays and lists."""
        d = self.known
        return {"ids": self.ids, "first": self.first, "cuts": self.cuts, "terms": self.terms, "times": self.times, "size": len(d),
                "data": d.data[:], "starts": d.starts[:], "sizes": d.sizes[:], "hashes": d.hashes[:]}


def dictionary(plain: dict) -> tb.Dictionary:
    out = tb.Dictionary()
    out.add(plain["data"], plain["starts"], plain["starts"] + plain["sizes"], plain["hashes"])
    return out


def blocks(items: DataFrame, id_column: str, block_terms: int = BLOCK_TERMS) -> Iterator[Items]:
    """The items in blocks of bounded size. Items without a term have no result and are left out."""
    rows = items.select(F.col(id_column).alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    ids, held, total, first = [], [], 0, 0

    def built() -> Items:
        known, lists = tb.Dictionary(), []
        for text in held:
            data, start, end, _ = _terms(next(tb.slices(pa.array([text], pa.string()), 1 << 62)))
            hashes = tb.Hasher(data)(start, end)
            own, at = np.unique(hashes, return_index=True)
            new = known.of_hash(own) < 0
            known.add(data, start[at[new]], end[at[new]], own[new])
            code = known.find(data, start, end, hashes)
            if (code < 0).any():
                raise ValueError("two terms share a 64-bit hash")
            lists.append(np.unique(code, return_counts=True))
        cuts = np.concatenate(([0], np.cumsum([len(x) for x, _ in lists])))
        return Items(ids, first, cuts, np.concatenate([x for x, _ in lists]), np.concatenate([n for _, n in lists]), known)

    for row in rows.toLocalIterator():
        _, start, _, _ = _terms(next(tb.slices(pa.array([row["t"]], pa.string()), 1 << 62)))
        if not len(start):
            continue
        if held and total + len(start) > block_terms:
            yield built()
            first, ids, held, total = first + len(ids), [], [], 0
        ids.append(row["i"])
        held.append(row["t"])
        total += len(start)
    if held:
        yield built()


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms, with repeats), terms and times (numbers and occurrences of the items' terms) of each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(items.plain())
    held: dict = {}

    def fn(batch):
        if "d" not in held:
            held["d"] = dictionary(shared.value)
        known = held["d"]
        for t in tb.slices(batch.column(1)):
            data, start, end, first = _terms(t)
            code = known.find(data, start, end, tb.Hasher(data)(start, end))
            n = np.diff(first)
            row = np.repeat(np.arange(len(t)), n)[code >= 0]
            pair, times = np.unique(row * np.int64(max(1, len(known))) + code[code >= 0], return_counts=True)
            row, code = pair // max(1, len(known)), pair % max(1, len(known))
            keep = np.flatnonzero(n > 0)
            cuts = np.searchsorted(row, np.append(keep, len(t)))
            if len(keep):
                yield {"doc_id": batch.column(0).slice(t.rows.start, len(t)).take(pa.array(keep)), "n": pa.array(n[keep].astype(np.int64)),
                       "terms": _lists(cuts, code.astype(np.int32)), "times": _lists(cuts, times.astype(np.int32))}

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(texts, "doc_id long, n long, terms array<int>, times array<int>", fn)


def _lists(cuts: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))


def impacts(times: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What an occurrence count counts for in a document of n terms, before the term's weight; whole numbers, rounded down."""
    m = 100 - 25 + (25 * n * docs) // length
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


class Shard:
    """Impact-sorted lists of some documents: a term's postings from the highest impact to the lowest."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.cuts = np.searchsorted(term[order], np.arange(terms + 1))
        self.docs = docs

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k documents of highest score above 0 and their scores; of equal scores the first in `order`.

        All lists are read in step, deeper each round. A document's lower bound is the sum of what was read of it; its upper bound adds,
        for each list it was not met in, what the list's next posting counts for. Documents whose upper bound lies below the k-th lower
        bound are given up for good; those not met at all have the sum of the next postings as their upper bound. Reading goes on until
        lower and upper bound are one for all that remain: then membership, ties and scores are settled.
        """
        live = (weight > 0) & (self.cuts[terms + 1] > self.cuts[terms])
        terms, weight = terms[live], weight[live]
        at, stop = self.cuts[terms].copy(), self.cuts[terms + 1]
        lower = np.zeros(self.docs, np.int64)
        met = np.zeros((len(terms), self.docs), bool)
        open_ = np.ones(self.docs, bool)
        left = None
        depth = FIRST_DEPTH
        while True:
            for i in range(len(terms)):
                to = min(stop[i], at[i] + depth)
                doc, gain = self.doc[at[i]:to], weight[i] * self.impact[at[i]:to]
                if left is not None:
                    wanted = open_[doc]
                    doc, gain = doc[wanted], gain[wanted]
                lower[doc] += gain
                met[i, doc] = True
                at[i] = to
            after = np.array([weight[i] * self.impact[at[i]] if at[i] < stop[i] else 0 for i in range(len(terms))], np.int64)
            seen = np.flatnonzero(lower) if left is None else left
            bar = int(np.partition(lower[seen], len(seen) - k)[len(seen) - k]) if len(seen) >= k else 0
            upper = lower[seen] + after.sum() - after @ met[:, seen]
            stay = upper >= max(bar, 1)
            if left is not None or after.sum() < max(bar, 1):
                # No document that was not met so far can come in any more.
                if left is None:
                    open_[:] = False
                else:
                    open_[seen] = False
                left = seen[stay]
                open_[left] = True
                upper = upper[stay]
                if (upper == lower[left]).all():
                    break
            depth *= DEEPER
        ranked = left[np.lexsort((order[left], -lower[left]))][:k]
        return ranked, lower[ranked]


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "item_id", block_terms: int = BLOCK_TERMS,
           shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0, of equal scores the smaller doc_id first.

    Documents are read in shards that fit a task; a score needs nothing but the document and counts over the whole corpus, so the best of each
    shard, k for an item, hold the best of all. Only these and the terms' document counts cross the network. Items come in blocks of
    `block_terms` terms, each block over all documents.

    Null and empty texts, and texts without a term, are no documents: they don't count and are never found. A null doc_id comes last
    among equal scores. Repeated rows are documents of their own, repeated items each have their ranks. Other columns are left out; without documents,
    or without items that have a term, the result is empty.
    """
    spark = docs.sparkSession
    id_kind = items.schema[id_column].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_kind}, rank int, doc_id long, score long")
    for block in blocks(items, id_column, block_terms):
        found = saved(vectors(docs, block), "vectors")
        count, length = found.agg(F.count("*"), F.sum("n")).first()
        if not count:
            break
        known = len(block.known)

        def frequency(batches, known=known):
            total = np.zeros(known, np.int64)
            for batch in batches:
                total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=known)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

        df = np.zeros(known, np.int64)
        for r in found.select("terms").mapInArrow(frequency, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            df[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        plain = block.plain()
        shared = spark.sparkContext.broadcast({x: plain[x] for x in ("first", "cuts", "terms", "times")} | {"weight": weight})

        def read(batches, shared=shared, known=known, count=count, length=length):
            block = shared.value

            def ranked(parts):
                ids = pa.concat_arrays([p.column(0) for p in parts])
                n = np.concatenate([p.column(1).to_numpy() for p in parts])
                lists = [p.column(2) for p in parts]
                sizes = np.concatenate([x.value_lengths().to_numpy() for x in lists])
                doc = np.repeat(np.arange(len(n)), sizes)
                term = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
                times = np.concatenate([p.column(3).flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
                shard = Shard(doc, term, impacts(times, n[doc], count, length), len(n), known)
                order = np.empty(len(n), np.int64)
                order[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(n))
                hits = []
                for i, (a, b) in enumerate(zip(block["cuts"][:-1].tolist(), block["cuts"][1:].tolist(), strict=True)):
                    own = block["terms"][a:b]
                    best, score = shard.best(own, block["weight"][own] * block["times"][a:b], k, order)
                    hits.append((np.full(len(best), block["first"] + i, np.int64), best, score))
                place, best, score = (np.concatenate(x) for x in zip(*hits, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(place), ids.take(pa.array(best)), pa.array(score)], names=["place", "doc_id", "score"])

            parts, held, postings = [], 0, 0
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    sizes = np.cumsum(batch.column(2).slice(at).value_lengths().to_numpy())
                    to = at + max(int(not parts), min(shard_docs - held, int(np.searchsorted(sizes, shard_postings - postings, side="right"))))
                    to = min(to, batch.num_rows)
                    if to > at:
                        parts.append(batch.slice(at, to - at))
                        held, postings = held + to - at, postings + int(sizes[to - at - 1])
                    at = to
                    if at < batch.num_rows or held >= shard_docs or postings >= shard_postings:
                        yield ranked(parts)
                        parts, held, postings = [], 0, 0
            if parts:
                yield ranked(parts)

        best = found.mapInArrow(read, "place long, doc_id long, score long")
        order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(block.first + i, x) for i, x in enumerate(block.ids)], f"place long, item_id {id_kind}")
        best = best.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(saved(best, "ranked"))
    return out
