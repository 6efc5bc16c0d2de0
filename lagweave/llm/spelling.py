"""Spelling variants of the corpus' words: PartEnum signatures of letter multisets, an equi-join on them, exact edit distance."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow_map, saved

#: One in so many runs loses a letter: a stated share of invented slips.
SLIP = 31
#: Shortest word, fewest occurrences, and how many times more frequent a form has to be.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10

_CRC = np.zeros(256, np.uint32)
for _k in range(256):
    _c = _k
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_k] = _c


def _shifts(longest: int) -> np.ndarray:
    """[n, k, b]: what byte k of a crc, of value b, becomes when n zero bytes follow."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(longest):
        now = now >> np.uint32(8) ^ _CRC[now & np.uint32(0xFF)]
        out.append(now)
    return np.stack(out)


_SHIFT = _shifts(64)


def joined_crc(before: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two strings in a row, from that of each and the second one's size (64 bytes at most)."""
    moved = np.zeros(len(before), np.uint32)
    for k in range(4):
        moved ^= _SHIFT[size, k, before >> np.uint32(8 * k) & np.uint32(0xFF)]
    return moved ^ after


def _runs(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and row of each run of letters."""
    data = tb.lowered(texts.data)
    letter = (data >= 0x61) & (data <= 0x7A) | (data == 0xC3)
    letter[1:] |= data[:-1] == 0xC3
    start, end, first = tb.words(tb.Texts(texts.rows, np.where(letter, np.uint8(1), np.uint8(0)), texts.cuts), _BLANK)
    return data, start, end, np.repeat(np.arange(len(texts)), np.diff(first))


_BLANK = np.zeros(256, bool)
_BLANK[0] = True


def slice_words(texts: tb.Texts, ids: list, least: int = LEAST_LETTERS, slip: int = SLIP) -> tuple[pa.Array, pa.Array]:
    """Words of some rows and their occurrences: runs of letters, A-Z lower-cased, of which some lose a letter by the crc of id and run.

    A word that runs become by losing a letter comes in a row of its own for each such run.
    """
    data, start, end, row = _runs(texts)
    marks = np.concatenate(([0], np.cumsum(data == 0xC3)))
    letters = end - start - (marks[end] - marks[start])
    long_ = letters >= least
    start, end, row, letters = start[long_], end[long_], row[long_], letters[long_]
    size = end - start
    own, first, at = np.unique(tb.Hasher(data)(start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)), np.uint32, len(first))
    before = np.fromiter((zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids), np.uint32, len(ids))
    h = np.zeros(len(start), np.int64)
    short = size < len(_SHIFT)
    h[short] = joined_crc(before[row[short]], crc[at[short]], size[short])
    for i in np.flatnonzero(~short).tolist():
        h[i] = zlib.crc32(raw[start[i]:end[i]], int(before[row[i]]))
    cut = h % slip == 0
    total = np.bincount(at[~cut], minlength=len(first))
    kept = np.flatnonzero(total)
    size = size[first[kept]]
    cuts = np.concatenate(([0], np.cumsum(size)))
    words = pa.LargeStringArray.from_buffers(len(kept), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[tb.ranges(start[first[kept]], size)])).cast(pa.string())
    less = []
    for i in np.flatnonzero(cut & (letters > least)).tolist():
        whole = raw[start[i]:end[i]].decode()
        place = int(h[i]) % len(whole)
        less.append(whole[:place] + whole[place + 1:])
    return pa.concat_arrays([words, pa.array(less, pa.string())]), pa.array(np.concatenate([total[kept], np.ones(len(less), np.int64)]))


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, at_least: int = LEAST_COUNT) -> DataFrame:
    """word, n: all words of `least` letters and `at_least` occurrences; counted in slices, then in tasks, then over all."""
    def fn(batch):
        ids = batch.column(0).to_pylist()
        for t in tb.slices(batch.column(1)):
            word, n = slice_words(t, ids[t.rows], least)
            yield {"word": word, "n": n}

    counted = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "word string, n long", fn)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def _multiset(codes: np.ndarray) -> np.ndarray:
    """Each letter as a dimension of its own for each time that it occurs: hashes of the dimensions that each word has."""
    ranked = np.sort(codes, axis=1).astype(np.uint64)
    place = np.broadcast_to(np.arange(codes.shape[1]), codes.shape)
    new = np.ones(codes.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    return tb.mixed(ranked * np.uint64(1 << 32) + nth.astype(np.uint64) + np.uint64(1))


def _parts(dims: np.ndarray, parts: int) -> np.ndarray:
    """[word, partition]: hash of the dimensions that a word has in each partition."""
    part = tb.mixed(dims) % np.uint64(parts)
    return np.stack([tb.mixed(np.where(part == np.uint64(p), dims, np.uint64(0)).sum(1, dtype=np.uint64) + np.uint64(p + 1)) for p in range(parts)], 1)


def _one_length(codes: np.ndarray) -> np.ndarray:
    """Keys [word, signature] of words of equal length.

    Two words at edit distance one differ in two dimensions (a replaced letter) or in one (an inserted or deleted one). Of DISTANCE + 1
    partitions one agrees at least, and its content is a signature: three for words of equal length, two for those whose lengths differ by one.
    The edit lies in one third of the word, so the letters of the other two agree in order; each choice of them is part of the key:
    words that only share letters don't meet. Words of one length and those one shorter meet under the shorter one's length.
    """
    n, size = codes.shape
    dims = _multiset(codes)
    base = np.uint64(0x9E3779B97F4A7C15)
    head = np.zeros((n, size + 1), np.uint64)
    for k in range(size):
        head[:, k + 1] = tb.mixed(head[:, k] * base + codes[:, k].astype(np.uint64) + np.uint64(1))
    tail = np.zeros((n, size + 1), np.uint64)
    for k in range(size - 1, -1, -1):
        tail[:, k] = tb.mixed(tail[:, k + 1] * base + codes[:, k].astype(np.uint64) + np.uint64(2))
    keys = []
    for shorter, distance in ((size, 2), (size - 1, 1), (size, 1)):
        third = shorter // 3
        sides = (head[:, shorter - third], tail[:, size - (shorter - third)], tb.mixed(head[:, third] * base + tail[:, size - third]))
        own = _parts(dims, distance + 1)
        for p in range(distance + 1):
            for side, same in enumerate(sides):
                keys.append(tb.mixed(own[:, p] * base + same + np.uint64(((shorter * 4 + side) * 4 + p) * 4 + distance)))
    return np.stack(keys, 1)


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place of the word and key of every signature of some words."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for size, places in by_size.items():
        # Few words at a time where they are long.
        step = max(1, (1 << 16) // max(1, size))
        for a in range(0, len(places), step):
            some = np.array(places[a:a + step])
            codes = np.frombuffer("".join([words[i] for i in some.tolist()]).encode("utf-32-le"), "<u4").astype(np.int64).reshape(len(some), size)
            keys = _one_length(codes)
            out.append((np.repeat(some, keys.shape[1]), keys.ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of words at edit distance exactly one. `words` has distinct word, n.

    Words that share a signature are compared in code points; a pair that shares several counts once. Both sides of the join are one
    shuffle. Skewed keys are split by Spark's skew join: with two thirds of the word in it, a key holds little else than true neighbours.
    """
    def fn(batch):
        for a in range(0, batch.num_rows, 8192):
            some = batch.slice(a, 8192)
            place, key = signatures(some.column(0).to_pylist())
            place = pa.array(place)
            yield {"key": key.view(np.int64), "word": some.column(0).take(place), "n": some.column(1).take(place)}

    signed = arrow_map(words.select("word", "n"), "key long, word string, n long", fn)
    met = signed.alias("a").join(signed.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) &
                                 (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    pairs = met.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def group_variants(docs: DataFrame, least: int = LEAST_LETTERS, at_least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of which one in SLIP loses a letter by the crc32 of
    `<doc_id>:<run>`; kept are those of `least` code points and `at_least` occurrences. A word's form is its most frequent word at edit
    distance one (of equal ones the first in code-point order), if that is `times` as frequent or more; its root the last word that forms lead to.

    Null texts have no words; a null doc_id is written as nothing before the colon. Repeated rows count each time. Texts and runs of any length are taken
    whole. An empty table gives an empty result; other columns are left out.
    """
    words = saved(vocabulary(docs, least, at_least), "words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    found = words.join(near, "word", "left")
    good = F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False))
    found = saved(found.select("word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(good, -F.col("best.less")).alias("form_n")), "variants")
    # Frequencies grow `times` with each step, so no chain is longer than their logarithm; each round doubles the steps.
    most = found.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most, 2), max(times, 2))))
    leads = found.where("form is not null").select("word", F.col("form").alias("to"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        beyond = leads.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        leads = saved(leads.join(beyond, "to", "left").select("word", F.coalesce("beyond", "to").alias("to")), "roots")
    return found.join(leads, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
