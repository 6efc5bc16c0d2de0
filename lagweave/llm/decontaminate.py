"""Benchmark decontamination by greedy string tiling: how much of a test item a document holds, in whatever order."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow_map, saved, shared, where_text
from .toxicity import _GAP

#: Words of a seed and of the shortest tile; share of an item's words that tiles have to cover.
SEED, COVERED = 5, 0.8
#: Words of test items that one broadcast index holds at most (about 100 MB), beside the item that crosses the line.
BLOCK_WORDS = 2_000_000
_PAIRS = "doc_id long, item_id long, item_words int, covered int, tiles int, longest int, coverage double"


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of Latin-1 to small ones."""
    out = tb.lowered(data)
    capital = np.zeros(len(out), bool)
    capital[1:] = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
    out[capital] += 0x20
    return out


#: Code points of scripts that put no spaces between words: Thai and Lao, Burmese, Khmer, kana, Chinese characters.
_UNSPACED = [(0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000)]


_TABLE: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point: 0 between words, 1 in a word (letters, marks, digits), 2 a word of its own. Beyond the table: between words."""
    if _TABLE:
        return _TABLE[0]
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x30000)), np.int8, 0x30000)
    for low, high in _UNSPACED:
        out[low:high] *= 2
    out[ord("'")] = 1
    _TABLE.append(np.append(out, np.int8(0)))
    return _TABLE[0]


def _plain_apostrophes(texts: tb.Texts) -> tb.Texts:
    """U+2019 as the one byte of '."""
    data = texts.data
    at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] == 0x99))
    if not len(at):
        return texts
    data = data.copy()
    data[at] = 0x27
    return tb.Texts(texts.rows, np.delete(data, np.concatenate([at + 1, at + 2])), texts.cuts - 2 * np.searchsorted(at, texts.cuts))


def _words(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of the first word of each row.

    Words are letters, marks, digits and apostrophes (of either form); characters of scripts without spaces each for itself.
    """
    texts = _plain_apostrophes(texts)
    data = folded(texts.data)
    start, end, first = tb.words(tb.Texts(texts.rows, data, texts.cuts), _GAP)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) < len(data):
        point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        if len(point) == len(at):  # else bytes that are no UTF-8: they stay letters
            kind = _kinds()[np.minimum(point, 0x30000)]
            before = np.concatenate(([0], kind[:-1]))
            rows = np.searchsorted(at, texts.cuts[:-1])
            before[rows[rows < len(at)]] = 0
            begin = (kind > 0) & ((before != 1) | (kind == 2))
            stop = np.append(np.flatnonzero(begin | (kind == 0)), len(at))
            inner = np.zeros(len(at) + 1, bool)
            inner[rows] = True
            stop = np.union1d(stop, np.flatnonzero(inner))
            begin = np.flatnonzero(begin)
            at = np.append(at, len(data))
            start, end = at[begin], at[stop[np.searchsorted(stop, begin, side="right")]]
            first = np.searchsorted(start, texts.cuts)
    return tb.Hasher(data)(start, end), first


def tiles(item: np.ndarray, text: np.ndarray, least: int, open_: np.ndarray | None = None) -> list[int]:
    """Lengths of the tiles of two word sequences: again and again the longest runs that both have unmarked, each word in one tile at most.

    The longest length with a common run is found by bisection, comparing Karp-Rabin hashes of all unmarked runs of a length.
    `open_`: words of the text that may be used.
    """
    used = [np.zeros(len(item) + 1, np.int64), np.zeros(len(text) + 1, np.int64)]
    if open_ is not None:
        used[1][:-1] = ~open_
    whole = [tb.Hasher(x.view(np.uint8)) for x in (item, text)]

    def runs(side: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        marked = np.concatenate(([0], np.cumsum(used[side][:-1])))
        at = np.arange(max(0, len(marked) - size))
        at = at[marked[at + size] == marked[at]]
        return at, whole[side](8 * at, 8 * (at + size))

    def common(size: int) -> bool:
        return bool(np.isin(runs(0, size)[1], runs(1, size)[1]).any())

    found, high = [], min(len(item), len(text))
    while high >= least and common(least):
        low = least
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        (at, mine), (to, other) = runs(0, low), runs(1, low)
        order = np.argsort(other, kind="stable")
        other, to = other[order], to[order]
        next_ = np.searchsorted(other, mine)
        free = {}
        for i, h, k in zip(at.tolist(), mine.tolist(), next_.tolist(), strict=True):
            k = max(k, free.get(h, 0))
            if used[0][i:i + low].any():
                continue
            while k < len(other) and other[k] == h and used[1][to[k]:to[k] + low].any():
                k += 1
            free[h] = k
            if k < len(other) and other[k] == h:
                used[0][i:i + low] = 1
                used[1][to[k]:to[k] + low] = 1
                found.append(low)
        high = low - 1
    return found


@dataclass
class Index:
    """Seeds of some test items: sorted hashes, and for each the items that hold it."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    cuts: np.ndarray
    items: np.ndarray
    #: Items shorter than a seed, by their number of words: sorted hashes of the whole item, and which item it is.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list[int], words: list[np.ndarray]) -> Index:
        grams = [np.unique(tb.gram_hashes(w, SEED)) for w in words]
        seed = np.concatenate(grams)
        item = np.repeat(np.arange(len(words)), [len(g) for g in grams])
        order = np.argsort(seed, kind="stable")
        seeds, starts = np.unique(seed[order], return_index=True)
        short = {}
        for size in range(1, SEED):
            if own := [i for i, w in enumerate(words) if len(w) == size]:
                whole = np.concatenate([tb.gram_hashes(words[i], size) for i in own])
                by_hash = np.argsort(whole, kind="stable")
                short[size] = (whole[by_hash], np.array(own)[by_hash])
        return Index(ids, words, seeds, np.append(starts, len(seed)), item[order], short)

    def found(self, texts: tb.Texts, covered: float) -> Iterator[tuple[int, int, list[int]]]:
        """(row, item, tile lengths) of each pair whose tiles cover enough of the item."""
        word, first = _words(texts)
        for size, (whole, items) in self.short.items():
            gram = tb.gram_hashes(word, size)
            low, high = np.searchsorted(whole, gram), np.searchsorted(whole, gram, side="right")
            place = np.flatnonzero(high > low)
            row = np.searchsorted(first, place, side="right") - 1
            place, row = place[place + size <= first[row + 1]], row[place + size <= first[row + 1]]
            many = (high - low)[place]
            pairs = np.unique(np.stack([np.repeat(row, many), items[tb.ranges(low[place], many)]]), axis=1)
            yield from ((r, i, [size]) for r, i in pairs.T.tolist())
        if not len(self.seeds):
            return
        gram = tb.gram_hashes(word, SEED)
        at = np.minimum(np.searchsorted(self.seeds, gram), len(self.seeds) - 1)
        place = np.flatnonzero(self.seeds[at] == gram)
        row = np.searchsorted(first, place, side="right") - 1
        inside = place + SEED <= first[row + 1]
        place, row, at = place[inside], row[inside], at[place[inside]]
        many = self.cuts[at + 1] - self.cuts[at]
        item = self.items[tb.ranges(self.cuts[at], many)]
        row, place = np.repeat(row, many), np.repeat(place, many)
        order = np.lexsort((place, item, row))
        row, place, item = row[order], place[order], item[order]
        edges = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]), [True]))) if len(row) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            words = self.words[item[a]]
            need = covered * len(words)
            # No more can be covered than lies in shared seeds.
            shared = np.zeros(len(words) + 1, np.int64)
            held = np.flatnonzero(np.isin(tb.gram_hashes(words, SEED), gram[place[a:b]]))
            np.add.at(shared, held, 1)
            np.add.at(shared, held + SEED, -1)
            if (np.cumsum(shared) > 0).sum() < need:
                continue
            low, high = place[a], place[b - 1] + SEED
            open_ = np.zeros(high - low + 1, np.int64)
            np.add.at(open_, place[a:b] - low, 1)
            np.add.at(open_, place[a:b] - low + SEED, -1)
            found = tiles(words, word[low:high], SEED, np.cumsum(open_)[:-1] > 0)
            if sum(found) >= need:
                yield int(row[a]), int(item[a]), found


def indexes(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """The test items in blocks of bounded size, one after the other. Items without words are left out."""
    ids, words, total = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for row in rows.toLocalIterator():
        own, _ = _words(next(tb.slices(pa.array([row[1]], pa.string()))))
        if not len(own):
            continue
        ids.append(row[0])
        words.append(own)
        total += len(own)
        if total >= block_words:
            yield Index.of(ids, words)
            ids, words, total = [], [], 0
    if ids:
        yield Index.of(ids, words)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, item_words, covered (words in tiles), tiles, longest, coverage of each document and test item it holds.

    A document holds an item if tiles of SEED words or more cover `covered` of the item's words, in any order; an item of fewer words, if it holds
    all of them in a row. Words are runs of letters and digits, small or capital (A-Z and Latin-1); punctuation and white space of any script don't count, and in scripts
    without spaces each character is a word. Null and empty texts hold nothing; items without words are held by none. Every row and item is judged by itself: repeated rows give repeated pairs, and
    so do repeated items. Other columns are left out; either table may be empty.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], _PAIRS)
    for index in indexes(benchmark, block_words):
        get = shared(spark, index)

        def fn(batch, get=get):
            for t in tb.slices(batch.column(1)):
                index = get()
                found = list(index.found(t, covered))
                ids = batch.column(0).slice(t.rows.start, len(t))
                size = [len(index.words[i]) for _, i, _ in found]
                total = [sum(x) for *_, x in found]
                yield {"doc_id": ids.take(pa.array([r for r, *_ in found], pa.int64())), "item_id": pa.array([index.ids[i] for _, i, _ in found], pa.int64()),
                       "item_words": pa.array(size, pa.int32()), "covered": pa.array(total, pa.int32()), "tiles": pa.array([len(x) for *_, x in found], pa.int32()),
                       "longest": pa.array([max(x) for *_, x in found], pa.int32()), "coverage": pa.array([n / s for n, s in zip(total, size, strict=True)], pa.float64())}

        # Each block's pairs are saved before the next block is sent, so that one index is in memory at a time.
        out = out.unionByName(saved(arrow_map(texts, _PAIRS, fn), "pairs"))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no test item; see `contaminated_pairs`. Nothing is shuffled."""
    for k, index in enumerate(indexes(benchmark, block_words)):
        get = shared(docs.sparkSession, index)

        def clean(t, get=get):
            out = np.ones(len(t), bool)
            out[[r for r, *_ in get().found(t, covered)]] = False
            return out

        docs = where_text(saved(docs, "undecided") if k else docs, clean)
    return docs
