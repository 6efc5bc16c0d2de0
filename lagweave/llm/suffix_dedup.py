"""Removal of byte strings that an earlier document holds too, by sparse suffix arrays in levels that merge geometrically.

Only some suffixes are indexed: of every `length` bytes in a row, the one whose first GRAM bytes hash lowest. Equal strings of that
length pick the same suffix, so every long match is found, with an eighteenth of the suffixes. A suffix array here orders them by the hash of
those first bytes; suffixes that agree there are compared in full, window by window, in a second step.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import scratch_path
from . import textbytes as tb
from .common import arrow_map, discard, remove, saved, tidy

GRAM = 16
#: Suffixes that a task holds before it passes them on, and that a bucket of a level is planned to hold.
HELD, BUCKET = 2_000_000, 500_000
#: A suffix start that more rows share is compared window by window across tasks, not in one.
HOT_ROWS = 50_000
#: Rows of a task whose windows are compared at once, besides those that meet with them.
COMPARED = 30_000
_LOW = np.uint64(0xFFFFFFFF)
_SALT = np.uint64(0xA0761D6478BD642F)
_RUN = "kind int, bucket long, n long, suffixes binary"
_COLUMNS = ("bucket", "n", "suffixes")


# -- suffixes of texts -------------------------------------------------------------------------------------------------

def suffixes(texts: tb.Texts, length: int) -> tuple[np.ndarray, ...]:
    """For each sampled suffix: its key, row, and the first and last of the windows of `length` bytes that picked it (starts in `data`)."""
    n = len(texts.data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    at = np.arange(n - GRAM + 1)
    gram = tb.Hasher(texts.data)(at, at + GRAM)
    low, span, width = (gram & ~_LOW) | at.astype(np.uint64), 1, length - GRAM + 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    windows = tb.ranges(texts.cuts[:-1], np.maximum(0, np.diff(texts.cuts) - length + 1))
    if not len(windows):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    picked = (low[windows] & _LOW).astype(np.int64)
    new = np.concatenate(([True], picked[1:] != picked[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(picked)])) - 1
    pos = picked[first]
    return tb.mixed(gram[pos] ^ _SALT), np.searchsorted(texts.cuts, pos, side="right") - 1, windows[first], windows[last]


# -- runs: sorted suffixes as compressed blobs ---------------------------------------------------------------------------

def _packed(*arrays: np.ndarray) -> bytes:
    """Sorted first array as differences; all arrays as planes of bytes, which leaves long runs of zeros."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    planes = [np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in (first, *arrays[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes, n: int, k: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=8 * n * k), np.uint8)
    arrays = [np.ascontiguousarray(p.reshape(8, n).T).view(np.uint64).ravel() for p in raw.reshape(k, -1)]
    return [np.cumsum(arrays[0], dtype=np.uint64), *arrays[1:]]


def _scanned(key: np.ndarray, doc: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge-scan. Per key one suffix stays (of the smallest document), and `told` if the key lies in two documents or more.

    Also returns, as a mask over the sorted pairs, the suffixes that share their key with another document and were not told before.
    """
    order = np.lexsort((doc, key))
    key, doc, told = key[order], doc[order], told[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    told = np.maximum.reduceat(told, at) if len(at) else told
    key, doc = key[at], doc[at]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(head)
    size = np.diff(np.append(starts, len(key)))
    many = np.repeat(size > 1, size)
    report = many & (told == 0)
    group_told = np.maximum.reduceat(told, starts) if len(starts) else told
    return key, doc, report, starts, np.maximum(group_told, (size > 1).astype(told.dtype))


def _rows(kind: int, bucket: int, arrays: list[np.ndarray]):
    n = len(arrays[0])
    return (kind, bucket, n, _packed(*arrays))


def _report_bucket(key: np.ndarray, doc: np.ndarray) -> int:
    """A negative bucket from all keys and documents of a report: those of many tasks spread, even where all begin with one hot key."""
    mixed = int(np.bitwise_xor.reduce((key ^ (doc * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return -1 - (mixed >> 48)


def _merged_rows(parts: list[list[np.ndarray]], bucket_bits: int, keep: bool):
    """Rows of a run (kind 0) by bucket, if `keep`, and of what is to be reported (kind 1)."""
    key, doc, told = [np.concatenate(x) for x in zip(*parts, strict=True)]
    key, doc, report, starts, told = _scanned(key, doc, told)
    if report.any():
        yield _rows(1, _report_bucket(key[report], doc[report]), [key[report], doc[report]])
    if keep:
        key, doc = key[starts], doc[starts]
        bucket = (key >> np.uint64(64 - bucket_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(key) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _rows(0, int(bucket[a]), [key[a:b], doc[a:b], told[a:b]])


def _table(rows: list[tuple]) -> pa.Table:
    kind, bucket, n, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int64()), "n": pa.array(n, pa.int64()), "suffixes": pa.array(blob, pa.binary())})


def _parts(table: pa.Table) -> list[list[np.ndarray]]:
    return [_unpacked(b, n, 3) for b, n in zip(table["suffixes"].to_pylist(), table["n"].to_pylist(), strict=True)]


def _run(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """The sorted run of a batch: sampled suffixes of its documents, one a key, and what the batch itself repeats."""
    def build(batches):
        held, count = [], 0
        for batch in batches:
            ids = batch.column(0)
            for texts in tb.slices(batch.column(1)):
                key, row, *_ = suffixes(texts, length)
                own = np.array(ids.slice(texts.rows.start, len(texts)).to_pylist(), np.int64).view(np.uint64) ^ np.uint64(1 << 63)
                held.append([key, own[row], np.zeros(len(key), np.uint64)])
                count += len(key)
                if count >= HELD:
                    yield from _table(list(_merged_rows(held, bits, True))).to_batches()
                    held, count = [], 0
        if count:
            yield from _table(list(_merged_rows(held, bits, True))).to_batches()

    def meet(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == 1:
            return table
        return _table(list(_merged_rows(_parts(table), bits, True)))

    return docs.mapInArrow(build, _RUN).groupBy("bucket").applyInArrow(meet, _RUN)


class SuffixIndex:
    """Levels of runs, sizes in batches. A batch is scanned against each level; levels of equal size merge before the next one comes.

    A run is a table bucketed by suffix key, so scans and merges read it in place, without a shuffle. What it reports lies beside it
    and stays when the run goes.
    """

    def __init__(self, spark: SparkSession, length: int, bits: int):
        self.spark, self.length, self.bits = spark, length, bits
        self.levels: list[tuple[int, str, str]] = []
        self.reported: list[DataFrame] = []
        self.scans: list[DataFrame] = []
        self.paths: list[str] = []

    def _stored(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"suffix_run_{uuid.uuid4().hex}", scratch_path(self.spark, "suffix-run")
        df.write.partitionBy("kind").bucketBy(1 << min(self.bits, 10), "bucket").option("path", path).saveAsTable(name)
        self.paths.append(path)
        self.reported.append(self.spark.read.schema(_RUN).parquet(path).where("kind = 1").select(*_COLUMNS))
        tidy(self.spark)
        return name, path

    def _level(self, name: str) -> DataFrame:
        return self.spark.table(name).where("kind = 0").select(*_COLUMNS)

    def _dropped(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{path}/kind=0")

    def _met(self, left: str, right: str, keep: bool) -> DataFrame:
        """Rows of two levels' scan: what it reports, and if `keep` the merged run."""
        bits = self.bits

        def both(a: pa.Table, b: pa.Table) -> pa.Table:
            return _table(list(_merged_rows(_parts(a) + _parts(b), bits, keep)) if keep or (len(a) and len(b)) else [])

        return self._level(left).groupBy("bucket").cogroup(self._level(right).groupBy("bucket")).applyInArrow(both, _RUN)

    def add(self, docs: DataFrame) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, *one), (_, *two) = self.levels.pop(), self.levels.pop()
            new = self._stored(self._met(one[0], two[0], True))
            self._dropped(*one)
            self._dropped(*two)
            self.levels.append((2 * size, *new))
        name, path = self._stored(_run(docs, self.length, self.bits))
        for _, other, _ in self.levels:
            self.scans.append(saved(self._met(name, other, False).select(*_COLUMNS), "suffix-scan"))
            self.reported.append(self.scans[-1])
        self.levels.append((1, name, path))

    def repeated(self) -> DataFrame:
        """doc_id, key of suffixes that begin like one of another document; some come more than once."""
        def pairs(batch):
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key, doc = _unpacked(blob, n, 2)
                yield {"doc_id": (doc ^ np.uint64(1 << 63)).view(np.int64), "key": key.view(np.int64)}

        rows = self.reported[0]
        for more in self.reported[1:]:
            rows = rows.unionByName(more)
        return arrow_map(rows, "doc_id long, key long", pairs)

    def close(self) -> None:
        """Delete all runs, and what they and the scans have reported."""
        for _, name, path in self.levels:
            self._dropped(name, path)
        discard(*self.scans)
        for path in self.paths:
            remove(self.spark, path)


# -- exact comparison of what begins alike -------------------------------------------------------------------------------

def _marked(marks: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """For every repeated suffix, the windows that picked it, as bytes; for hot ones each window by its hash. `meet` says where they meet.

    `name` tells texts of one doc_id apart; where the id has one text only, which is `alone`, it is 0.

    Equal windows of one task meet there: all but those of the smallest document are removed at once (rows with a `count`
    and no bytes), so that a passage of many documents sends one row from each task.
    """
    def contexts(batch):
        ids, text, keys, hot, alone = batch.columns
        for t in tb.slices(text):
            key, row, lo, hi = suffixes(t, length)
            wanted = [set(k or ()) for k in keys.slice(t.rows.start, len(t)).to_pylist()]
            heated = [set(k or ()) for k in hot.slice(t.rows.start, len(t)).to_pylist()]
            whole = tb.Hasher(t.data)
            name = whole(t.cuts[:-1], t.cuts[1:]).view(np.int64)
            name[np.array(alone.slice(t.rows.start, len(t)).to_pylist(), bool)] = 0
            signed = key.view(np.int64)
            use = np.fromiter((k in wanted[r] for k, r in zip(signed.tolist(), row.tolist(), strict=True)), bool, len(key))
            signed, row, lo, hi = signed[use], row[use], lo[use], hi[use]
            warm = np.fromiter((k in heated[r] for k, r in zip(signed.tolist(), row.tolist(), strict=True)), bool, len(row))
            own = np.array(ids.slice(t.rows.start, len(t)).to_pylist(), np.int64)
            if warm.any():
                each = tb.ranges(lo[warm], hi[warm] - lo[warm] + 1)
                of = np.repeat(row[warm], hi[warm] - lo[warm] + 1)
                signed = np.concatenate((signed[~warm], whole(each, each + length).view(np.int64)))
                row, lo, hi = np.concatenate((row[~warm], of)), np.concatenate((lo[~warm], each)), np.concatenate((hi[~warm], each))
            content = whole(lo, hi + length)
            order = np.lexsort((own[row], content))
            group = np.concatenate(([0], np.cumsum(content[order][1:] != content[order][:-1]))) if len(order) else order
            least = own[row][order][np.searchsorted(group, group)] if len(order) else own[:0]
            copy = np.zeros(len(order), bool)
            copy[order] = own[row][order] > least
            raw = t.data.tobytes()
            yield {
                "meet": np.where(copy, own[row], signed), "doc_id": own[row], "name": name[row], "pos": lo - t.cuts[row], "count": hi - lo + 1,
                "bytes": pa.array([None if c else raw[a:b + length] for c, a, b in zip(copy, lo, hi, strict=True)], pa.binary()),
            }

    joined = texts.join(marks, "doc_id").select("doc_id", "text", "keys", "hot", "alone")
    return arrow_map(joined, "meet long, doc_id long, name long, pos long, count long, bytes binary", contexts)


def _spans(marked: DataFrame, length: int, tasks: int) -> DataFrame:
    """doc_id, name, from, to of removed bytes: of windows for which a smaller document has an equal one."""
    def windows(table: pa.Table) -> pa.RecordBatch:
        doc, name, pos, count = (table[c].to_numpy() for c in ("doc_id", "name", "pos", "count"))
        content = pa.chunked_array([c.cast(pa.large_binary()) for c in table["bytes"].chunks]).combine_chunks()
        _, cuts, data = content.buffers()
        cuts = np.frombuffer(cuts, np.int64, len(content) + content.offset + 1)[content.offset:]
        data = np.frombuffer(data, np.uint8)[cuts[0]:cuts[-1]]
        start = tb.ranges(cuts[:-1] - cuts[0], count)
        of = np.repeat(np.arange(len(doc)), count)
        window = tb.Hasher(data)(start, start + length)
        order = np.lexsort((doc[of], window))
        head = np.concatenate(([True], window[order][1:] != window[order][:-1]))
        least = doc[of][order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        later = np.zeros(len(order), bool)
        later[order] = doc[of][order] > least
        edge = np.flatnonzero(later & ~(np.concatenate(([False], later[:-1])) & np.concatenate(([False], of[1:] == of[:-1]))))
        stop = np.flatnonzero(later & ~(np.concatenate((later[1:], [False])) & np.concatenate((of[1:] == of[:-1], [False]))))
        base = np.cumsum(count) - count
        row = of[edge]
        return pa.RecordBatch.from_pydict({"doc_id": doc[row], "name": name[row], "from": pos[row] + edge - base[row], "to": pos[row] + stop - base[row] + length})

    def compare(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        settled = table.filter(table["bytes"].is_null())
        doc, name, pos, count = (settled[c].to_numpy() for c in ("doc_id", "name", "pos", "count"))
        yield pa.RecordBatch.from_pydict({"doc_id": doc, "name": name, "from": pos, "to": pos + count + (length - 1)})
        table = table.filter(table["bytes"].is_valid())
        if not len(table):
            return
        # Some rows at a time, all of a meeting point together: the windows' arrays are many times as large as the rows.
        turn = tb.mixed(table["meet"].to_numpy().view(np.uint64)) % np.uint64(len(table) // COMPARED + 1)
        for k in np.unique(turn):
            yield windows(table.filter(pa.array(turn == k)))

    return marked.repartition(tasks, "meet").mapInArrow(compare, "doc_id long, name long, `from` long, `to` long")


def find_spans(docs: DataFrame, length: int = 50, batches: int = 4) -> DataFrame:
    """doc_id, name, spans: for each document, byte ranges that an earlier document holds too. `name` is the hash of the text, or 0 for any.

    Copies of whole texts are settled by their hash, so that a text held by a third of all rows is indexed and compared once a task.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def names(batch):
        for t in tb.slices(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(t.rows.start, len(t)), "bytes": np.diff(t.cuts), "name": tb.Hasher(t.data)(t.cuts[:-1], t.cuts[1:]).view(np.int64)}

    named = saved(arrow_map(docs, "doc_id long, bytes long, name long", names), "names")
    about = named.agg(F.sum("bytes"), F.count("*"), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5], 10_000)).first()
    total, ends = about[0] or 0, sorted(set(about[2] or []))
    first = named.groupBy("name", "bytes").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and bytes > 0")
    copies = named.join(first.drop("n"), ["name", "bytes"]).where("doc_id > first")
    copies = saved(copies.select("doc_id", "name", F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("bytes").alias("to"))).alias("spans"))
                   .where(F.col("bytes") >= length), "copies")

    suffix_count = 2 * total // (length - GRAM + 2)
    index = SuffixIndex(spark, length, max(3, int(suffix_count // BUCKET).bit_length()))
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        batch = docs if low is None else docs.where(F.col("doc_id") > low)
        index.add(batch if high is None else batch.where(F.col("doc_id") <= high))
    one_text = named.groupBy("doc_id").agg((F.min("name") == F.max("name")).alias("alone"))
    repeated = index.repeated()
    # Keys are counted by their remainders first: only those of crowded remainders can be hot.
    place = F.pmod("key", F.lit(1 << 16))
    crowded = saved(repeated.groupBy(place.alias("place")).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("place"), "crowded")
    rows = repeated.withColumn("hot", F.lit(None).cast("long"))
    if crowded.limit(1).count():
        hot = repeated.withColumn("place", place).join(crowded, "place").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
        rows = repeated.join(saved(hot.select("key", F.col("key").alias("hot")), "hot"), "key", "left").select("doc_id", "key", "hot")
    marks = rows.groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set("hot").alias("hot"))
    marks = saved(marks.join(one_text, "doc_id").join(copies.select("doc_id", F.lit(True).alias("alone")), ["doc_id", "alone"], "left_anti"), "marks")
    index.close()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), suffix_count // 1_000_000 + 1)
    spans = saved(_spans(_marked(marks, docs, length), length, tasks), "spans")
    discard(marks)
    return spans.groupBy("doc_id", "name").agg(F.collect_list(F.struct("from", "to")).alias("spans")).unionByName(copies)


def _united(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _by_doc(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("name", "spans")).alias("s")).select(
        F.col("doc_id").alias("_suffix_doc"), F.col("s.name").alias("_suffix_names"), F.col("s.spans").alias("_suffix_spans"))


def _cut(t: tb.Texts, names: pa.Array, spans: pa.Array):
    """For each row what is left of its bytes, and the ranges that go."""
    own = tb.Hasher(t.data)(t.cuts[:-1], t.cuts[1:]).view(np.int64)
    raw = t.data.tobytes()
    for i, k in enumerate(range(t.rows.start, t.rows.stop)):
        found = zip(names[k].as_py(), spans[k].as_py(), strict=True) if names[k].is_valid else ()
        body = raw[t.cuts[i]:t.cuts[i + 1]]
        out = _united([s for name, more in found if name in (0, own[i]) for s in more])
        if out:
            edges = [0, *(x for s in out for x in s), len(body)]
            body = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        yield body, out


def dedup(docs: DataFrame, length: int = 50, batches: int = 4) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256. Texts are UTF-8 bytes; null and empty texts have none. Rows without a
    doc_id are neither searched nor cut. Rows that share a doc_id are no smaller than one another and don't cut each other;
    equal rows give equal results. Columns beside doc_id and text are left out; an empty table gives an empty result.

    `batches`: ranges of doc_id that enter the index one after the other.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batch):
        doc, text, names, spans = batch.columns
        for t in tb.slices(text):
            left = list(_cut(t, names, spans))
            yield {"doc_id": doc.slice(t.rows.start, len(t)), "n_bytes": np.diff(t.cuts), "n_removed": pa.array([sum(b - a for a, b in x) for _, x in left], pa.int64()),
                   "n_spans": pa.array([len(x) for _, x in left], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(b).hexdigest() for b, _ in left], pa.string())}

    joined = ids.join(_by_doc(find_spans(docs, length, batches)), F.col("doc_id") == F.col("_suffix_doc"), "left").select("doc_id", "text", "_suffix_names", "_suffix_spans")
    return arrow_map(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", cut)


def without_repeats(docs: DataFrame, length: int = 50, batches: int = 4) -> DataFrame:
    """The rows of `docs`, with all their columns, without such byte strings in `text`; see `dedup`.

    Characters that a cut splits go. Where text was cut, `n_chars`, if there is one, counts what is left; a row of which nothing but white space
    is left goes. All other rows stay as they are.
    """
    names = docs.columns
    place = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def cut(batches):
        for batch in batches:
            *columns, marks, spans = batch.columns
            text, keep = columns[place].to_pylist(), np.ones(batch.num_rows, bool)
            size = columns[count].to_pylist() if count is not None else None
            for t in tb.slices(columns[place]):
                for k, (body, out) in zip(range(t.rows.start, t.rows.stop), _cut(t, marks, spans), strict=True):
                    if out:
                        text[k] = body.decode(errors="ignore")
                        keep[k] = bool(text[k].strip())
                        if size is not None:
                            size[k] = len(text[k])
            columns[place] = pa.array(text, columns[place].type)
            if size is not None:
                columns[count] = pa.array(size, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    joined = docs.join(_by_doc(find_spans(docs, length, batches)), F.col("doc_id") == F.col("_suffix_doc"), "left").drop("_suffix_doc")
    return joined.mapInArrow(cut, docs.schema)
