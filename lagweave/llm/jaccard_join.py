"""Exact Jaccard join of word-shingle sets by T-occurrence search on inverted lists.

A set of n shingles can only be linked with one that shares enough of its shingles; so the p = n - least overlap + 1 lowest in
hash order must meet. Their inverted lists are merged where they are short, and occurrences counted. Long lists are skipped, as DivideSkip does:
a set goes on to m further shingles, of which and the first p any partner has m + 1; so a partner occurs in m + 1 less the skipped ones of the short
lists at least. What is long is looked up for these candidates only, by binary search in the other's shingles.
A set that has skipped more than it could make up for tells all its shingles, beside the lists, which stay as short or long as they are. Any other set has
a short list in common with it if they are linked. Sets that tell all have lists of their own. Two of them that share no short one of these
differ in all their rare shingles; where these are so few that the sets may be linked, they are searched by joint shingles: of the parts into which
hashes are cut, more than linked sets can differ in, one at least is the same in both (`joint_keys`). No long list is ever paired with itself.
Near copies are gathered under pivots first, so that a group of thousands is one entry in every list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow_map, discard, saved, shared, small_batches
from .components import components
from .suffix_dedup import _packed, _unpacked

#: Entries of an inverted list beyond which it is skipped; lists below give at most LONG² / 2 pairs.
LONG = 32
#: Lowest shingles by which near copies find a common pivot.
MINIMA = 4
#: Shingles from which on a set is sketched with four bytes each.
LARGE = 4096
HELD = 500_000
#: Sets to a file of a table that grows with their number.
FILE_SETS = 50_000
#: Rows of ids that are sent to all tasks, instead of shuffling the texts they pick.
SENT = 100_000
#: Rows of shingles that are sent to all tasks, instead of shuffling the prefixes in which they are looked up.
SOUGHT = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: tb.Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's shingles of `size` words, A-Z lower-cased; of all its words if they are fewer."""
    low = tb.Texts(texts.rows, tb.lowered(texts.data), texts.cuts)
    start, end, first = tb.words(low)
    word = tb.word_hashes(low.data, start, end)
    gram = tb.gram_hashes(word, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(_distinct(gram[a:b - size + 1]))
        else:
            short = tb.gram_hashes(word[a:b], b - a) if b > a else gram[:0]
            out.append(tb.mixed(short + np.uint64(b - a)) if b > a else short)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: `np.unique` hashes them first, which takes four times as long on sets of some hundreds."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x if new.all() else x[new]


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set it is linked with, at least."""
    return -(-percent * n // 100)


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each whole set."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    cuts = np.concatenate(([0], np.cumsum(n)))
    total = _running(np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64))
    return tb.mixed(total[cuts[1:]] - total[cuts[:-1]] + n.astype(np.uint64) * _ODD).view(np.int64)


def _running(shingles: np.ndarray) -> np.ndarray:
    """Running sums of remixed shingles, from 0: differences are hashes of what lies between."""
    total = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(tb.mixed(shingles + _ODD), out=total[1:])
    return total


def size_class(n: int, percent: int) -> tuple[int, list[int]]:
    """The class of sets of n shingles, and the largest sizes of classes 0 to the next: linked sets are of one class or of neighbouring ones."""
    tops = [1]
    while tops[-1] < n:
        tops.append(100 * (tops[-1] + 1) // percent)
    return len(tops) - 1, [*tops, 100 * (tops[-1] + 1) // percent]


def joint_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which any two linked sets have one in common, and that other sets rarely share.

    Linked sets of a class and the next differ in `apart` shingles at most, so of more parts, cut at fixed hashes, one is the same in
    both. Empty parts are left out, as there are some more parts than need be; a set with too many gives its prefix as well, and two such sets meet there.
    """
    n = len(shingles)
    here, tops = size_class(n, percent)
    total, out = _running(shingles), []
    for low in {max(0, here - 1), here}:
        apart = (100 - percent) * 2 * tops[low + 1] // (100 + percent)
        k = apart + 3 + apart // 32
        edge = np.arange(1, k, dtype=np.uint64) * np.uint64((1 << 64) // k)
        cuts = np.concatenate(([0], np.searchsorted(shingles, edge), [n]))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        out.append(tb.mixed(total[cuts[full + 1]] - total[cuts[full]] + full.astype(np.uint64) * _ODD + np.uint64(low)))
        if len(full) <= apart:
            out.append(tb.mixed(shingles[:n - least_overlap(n, percent) + 1] + np.uint64(low)))
    return np.unique(np.concatenate(out))


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, key (hash of the set), minima."""
    def fn(batch):
        for t in tb.slices(batch.column(1)):
            sets = shingle_sets(t, size)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            yield {"doc_id": batch.column(0).slice(t.rows.start, len(t)), "n_shingles": n, "key": set_keys(sets),
                   "minima": pa.array([s[:MINIMA].view(np.int64) for s in sets], pa.list_(pa.int64()))}

    return arrow_map(docs, "doc_id long, n_shingles long, key long, minima array<long>", fn)


# -- inverted lists ----------------------------------------------------------------------------------------------------

def _posted(held: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    """The entries held, by bucket; empties `held`."""
    shingle, key = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.lexsort((key, shingle))
    shingle, key = shingle[order], key[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])
    shingle, key = shingle[new], key[new]
    bucket = (tb.mixed(shingle) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    shingle, key, bucket = shingle[order], key[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), "n": pa.array([b - a for a, b in spans], pa.int64()),
        "entries": pa.array([_packed(shingle[a:b], key[a:b]) for a, b in spans], pa.binary())})


def prefixes(docs: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """bucket, n, entries: packed (shingle, set key) of every set's prefix, once a task however many rows share the set."""
    def post(batches):
        held, count = [], 0
        for batch in batches:
            for t in tb.slices(batch.column(1)):
                sets = shingle_sets(t, size)
                for s, key in zip(sets, set_keys(sets).view(np.uint64), strict=True):
                    if len(s):
                        p = len(s) - least_overlap(len(s), percent) + 1
                        held.append((s[:p].copy(), np.full(p, key)))  # a view would hold the whole set
                        count += p
            if count >= HELD:
                yield _posted(held, bits)
                count = 0
        if held:
            yield _posted(held, bits)

    return docs.mapInArrow(post, "bucket long, n long, entries binary")


def _entries(table: pa.Table) -> list[np.ndarray]:
    parts = [_unpacked(b, n, 2) for b, n in zip(table["entries"].to_pylist(), table["n"].to_pylist(), strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * 2


def shared_entries(posts: DataFrame) -> DataFrame:
    """shingle, node, k: the entries of lists that hold two sets or more, and how many."""
    def fn(table: pa.Table) -> pa.Table:
        shingle, key = _entries(table)
        order = np.lexsort((key, shingle))
        shingle, key = shingle[order], key[order]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])
        shingle, key = shingle[new], key[new]
        same = shingle[1:] == shingle[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        edge = np.flatnonzero(np.concatenate(([True], ~same, [True]))) if len(shingle) else np.zeros(1, np.int64)
        k = np.repeat(np.diff(edge), np.diff(edge))
        return pa.table({"shingle": shingle[many].view(np.int64), "node": key[many].view(np.int64), "k": k[many[:len(k)]]})

    return posts.groupBy("bucket").applyInArrow(fn, "shingle long, node long, k long")


def entries_of(posts: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """shingle, node: the entries of the wanted shingles."""
    def fn(posted: pa.Table, asked: pa.Table) -> pa.Table:
        shingle, key = _entries(posted)
        hit = np.isin(shingle, np.unique(asked["shingle"].to_numpy().view(np.uint64)))
        return pa.table({"shingle": shingle[hit].view(np.int64), "node": key[hit].view(np.int64)})

    def place(batch):
        s = batch.column(0).to_numpy()
        return {"bucket": (tb.mixed(s.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64), "shingle": s}

    if wanted.limit(SOUGHT + 1).count() <= SOUGHT:
        get = shared(posts.sparkSession, np.unique(wanted.select("shingle").distinct().toArrow()["shingle"].to_numpy().view(np.uint64)))

        def pick(batch):
            asked = get()
            for raw, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingle, key = _unpacked(raw, n, 2)
                hit = asked[np.minimum(np.searchsorted(asked, shingle), len(asked) - 1)] == shingle if len(asked) else np.zeros(len(shingle), bool)
                yield {"shingle": shingle[hit].view(np.int64), "node": key[hit].view(np.int64)}

        return arrow_map(posts.select("bucket", "n", "entries"), "shingle long, node long", pick)
    asked = arrow_map(wanted.select("shingle").distinct(), "bucket long, shingle long", place)
    return posts.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(fn, "shingle long, node long")


def is_few(ids: DataFrame) -> bool:
    return ids.limit(SENT + 1).count() <= SENT


def picked(df: DataFrame, ids: DataFrame, on: str = "node", sent: bool | None = None) -> DataFrame:
    """The rows of `df` with one of the ids, and the ids' other columns. Few ids (counted, unless `sent` is given) go to all tasks and `df` stays where it is."""
    return df.join(F.broadcast(ids) if (is_few(ids) if sent is None else sent) else ids, on)


# -- probing sets --------------------------------------------------------------------------------------------------------

def shortlisted(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, reach, na, nb) that their sketches don't rule out.

    Of the smaller set's cut hashes at least as many lie among the other's as there are common shingles; a pair in reach
    needs (1 - d) / (2 - d) * (na + nb) of these.
    """
    names = pairs.columns

    def fn(batch):
        x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("_x", "_y"))
        reach, na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("reach", "na", "nb"))
        far = 1 - percent / 100 + reach
        need = (1 - far) / (2 - far) * (na + nb) - 1e-6
        keep = []
        for one, two, n, m, k in zip(x, y, na.tolist(), nb.tolist(), need.tolist(), strict=True):
            one, two = (np.frombuffer(v.as_buffer(), "<u2" if c < LARGE else "<u4") for v, c in ((one, n), (two, m)))
            if one.dtype != two.dtype:
                one, two = (v if v.dtype.itemsize == 2 else np.sort(v.astype("<u2")) for v in (one, two))
            short, long = sorted((one, two), key=len)
            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
            keep.append(int((long[at] == short).sum()) >= k)
        kept = batch.filter(pa.array(keep, pa.bool_()))
        return {c: kept.column(kept.schema.get_field_index(c)) for c in names}

    held = texts.select("node", "sketch")
    joined = pairs.join(held.withColumnsRenamed({"node": "a", "sketch": "_x"}), "a").join(held.withColumnsRenamed({"node": "b", "sketch": "_y"}), "b")
    return arrow_map(joined, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), fn)


def _with_sets(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Add the shingles `_x` and `_y` to pairs (a, b, ...) of node ids; texts: node, text."""
    def sets(batch):
        for t in tb.slices(batch.column(1)):
            yield {"node": batch.column(0).slice(t.rows.start, len(t)), "shingles": pa.array([s.tobytes() for s in shingle_sets(t, size)], pa.binary())}

    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = arrow_map(picked(texts.select("node", "text"), used, sent=(small := is_few(used))), "node long, shingles binary", sets)
    if small:  # both sides of the pairs read them
        held = saved(held, "held", 1)
    return pairs.join(held.withColumnsRenamed({"node": "a", "shingles": "_x"}), "a").join(held.withColumnsRenamed({"node": "b", "shingles": "_y"}), "b")


def probed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Add `both`, the size of the intersection, to pairs (a, b, ...) of node ids; texts: node, text."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]

    def probe(batch):
        x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("_x", "_y"))
        both = []
        for raw, other in zip(x, y, strict=True):
            short, long = sorted((np.frombuffer(v.as_buffer(), np.uint64) for v in (raw, other)), key=len)
            at = np.minimum(np.searchsorted(long, short), len(long) - 1)
            both.append(int((long[at] == short).sum()))
        return {c: batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", *rest)} | {"both": pa.array(both, pa.int64())}

    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in ("a", "b", *rest)) + ", both long"
    return arrow_map(_with_sets(pairs, texts, size), schema, probe)


def telling(apart: int, pivot: int, own: int, percent: int) -> int:
    """How many of the `apart` shingles in which a member of `own` shingles differs from its pivot tell it: any set that is linked with the
    member, but not with the pivot, differs from the pivot in one of these too, whichever they are.

    Sets are linked that differ in (100 - percent) / (100 + percent) of their sizes' sum at most. Two that differ from the pivot in s and d
    shingles, c of them the same, differ in s + d - 2c; as s is too much for a link, c is over half of d, give or take the sizes.
    """
    least = ((100 + percent) * apart + (100 - percent) * (pivot - own)) // (2 * (100 + percent)) + 1
    return max(0, apart - least + 1)


def differing(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, member, linked, tell, shingle: from pairs (a, b, member) of a pivot and a set, all shingles in which they differ.

    `tell` is how many of a member's are telling. Others that are linked with the pivot come with `linked` instead, in one row.
    """
    def fn(batch):
        out = {"a": [], "b": [], "member": [], "linked": [], "tell": [], "shingle": []}
        a, b, member, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "member", "_x", "_y"))
        for a, b, member, x, y in zip(a.to_pylist(), b.to_pylist(), member.to_pylist(), x, y, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            rows = np.setxor1d(x, y, assume_unique=True)
            linked = not member and (100 + percent) * len(rows) <= (100 - percent) * (len(x) + len(y))
            tell = telling(len(rows), len(x), len(y), percent) if member else 0
            rows = np.zeros(1, np.uint64) if linked else rows
            for c, v in (("a", a), ("b", b), ("member", member), ("linked", linked), ("tell", tell)):
                out[c].append(np.full(len(rows), v))
            out["shingle"].append(rows.view(np.int64))
        kinds = {"member": bool, "linked": bool}
        yield {c: np.concatenate([np.zeros(0, kinds.get(c, np.int64)), *v]) for c, v in out.items()}

    return arrow_map(_with_sets(pairs, texts, size), "a long, b long, member boolean, linked boolean, tell long, shingle long", fn)


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """The hashes cut to two bytes each, four in large sets."""
    return np.sort(shingles.astype("<u2" if len(shingles) < LARGE else "<u4"))


def texts_of(docs: DataFrame, wanted: DataFrame, size: int, unique: bool, files: int) -> DataFrame:
    """node, text, sketch of the wanted sets (node, first), read from a document that has the set."""
    def fn(batch):
        for t in tb.slices(batch.column(1)):
            sets = shingle_sets(t, size)
            node = batch.column(2).slice(t.rows.start, len(t))
            same = pa.array((set_keys(sets) == node.to_numpy()) & (np.fromiter(map(len, sets), np.int64, len(sets)) > 0))
            sketch = pa.array([_sketch(s).tobytes() for s in sets], pa.binary())
            yield {"node": node.filter(same), "text": batch.column(1).slice(t.rows.start, len(t)).filter(same), "sketch": sketch.filter(same)}

    found = picked(docs, wanted.withColumnRenamed("first", "doc_id"), "doc_id").select("doc_id", "text", "node")
    found = arrow_map(found, "node long, text string, sketch binary", fn)
    return saved(found if unique else found.dropDuplicates(["node"]), "texts", files)


def file_count(sets: int) -> int:
    """Files of a table that grows with the number of sets."""
    return 1 + sets // FILE_SETS


def links(docs: DataFrame, sets: DataFrame, size: int, percent: int, unique: bool) -> DataFrame:
    """a, b: linked sets; enough of them to connect all that are linked, not all links.

    Members of one pivot are not compared with one another, nor those of two linked pivots: what is returned gives components, no counts of links.

    docs: doc_id, text. sets: node (hash of the set), first (smallest doc_id), n, minima, one row for each distinct set.
    """
    far = 1 - percent / 100
    linked = F.expr(f"100 * both >= {percent} * (na + nb - both)")
    apart = F.expr("1 - both / (na + nb - both)")
    names = sets.select("node", "n")
    prefix = f"(n - ({percent} * n + 99) div 100 + 1)"

    def few(df: DataFrame, name: str) -> DataFrame:
        """As `saved`, for results far smaller than what they are made of: all tasks make them, a shuffle brings them into `files` files."""
        return saved(df.repartition(files), name)

    def sized(pairs: DataFrame, slack: str = "0") -> DataFrame:
        both = pairs.join(names.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(names.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
        return both.where(f"100 * least(na, nb) >= ({percent} - 100 * {slack} - 1e-6) * greatest(na, nb)")

    # Sets that share a prefix shingle with another. Most of what follows reads only their texts.
    total, distinct = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    files = file_count(distinct)
    bits = max(3, int(total * (100 - percent) // 100 // 500_000).bit_length())
    posts = saved(prefixes(docs.select("doc_id", "text"), size, percent, bits), "posts")
    live = saved(shared_entries(posts), "live", files)
    weight = live.groupBy("node").agg(F.sum("k").alias("weight")).join(names, "node").select("node", (F.col("weight") / F.col("n")).alias("weight"))
    live = live.drop("k")
    firsts = sets.select("node", "first")
    near = texts_of(docs, firsts.join(live.select("node").distinct(), "node"), size, unique, files)

    # Pivots: sets that share a low shingle are measured against the one among them whose shingles most others have. Where many share it,
    # those that come near by their prefixes are weighed by all their shingles: the middle of a large group is linked with more of it.
    low = sets.join(weight, "node").select("node", "weight", F.explode("minima").alias("shingle"))
    top = low.groupBy("shingle").agg(F.max("weight").alias("top"), F.count("*").alias("k")).where("k > 1")
    high = few(low.join(top, "shingle").where("weight >= 0.9 * top").select("shingle", "node", "weight", "k"), "high")

    def whole(batch):
        for t in tb.slices(batch.column(1)):
            told = shingle_sets(t, size)
            yield {"shingle": np.concatenate(told).view(np.int64), "node": np.repeat(batch.column(0).to_numpy()[t.rows], [len(s) for s in told])}

    crowd = picked(near.select("node", "text"), high.where(F.col("k") > LONG).select("node").distinct())
    crowd = saved(arrow_map(crowd, "shingle long, node long", whole), "crowd", files)
    finer = crowd.join(crowd.groupBy("shingle").agg(F.count("*").alias("k")), "shingle").groupBy("node").agg(F.avg("k").alias("finer"))
    lead = high.join(finer, "node", "left").groupBy("shingle").agg(F.max(F.struct(F.coalesce("finer", F.lit(0.0)).alias("finer"), "weight", "node")).alias("m"))
    lead = lead.select("shingle", F.col("m.node").alias("a"), F.struct("m.finer", "m.weight").alias("weight"))
    spokes = sized(low.drop("weight").join(lead, "shingle").where("node <> a").select("a", "weight", F.col("node").alias("b")).distinct())
    spokes = few(shortlisted(spokes.withColumn("reach", F.lit(0.0)), near, percent).drop("reach"), "near")
    spokes = few(probed(spokes, near, size).where(linked).withColumn("apart", apart), "spokes")
    own = spokes.join(spokes.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    member = few(own.groupBy("b").agg(F.max_by(F.struct("a", "apart"), F.struct("weight", "a")).alias("m")).select(F.col("b").alias("node"), "m.a", "m.apart"), "members")
    radius = member.groupBy("a").agg(F.max("apart").alias("radius")).withColumnRenamed("a", "node")
    # What is known to hang together: pivots, their members, and what is linked with a member.
    tied = member.select("node", F.col("a").alias("tie")).unionByName(radius.select("node", F.col("node").alias("tie")))
    hung = spokes.join(tied.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("tie").alias("tie")).withColumnRenamed("b", "node")
    tied = few(tied.unionByName(hung.join(tied.select("node"), "node", "left_anti")), "tied")

    def apart_yet(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) that are not known to hang together."""
        for side in ("a", "b"):
            pairs = pairs.join(tied.withColumnsRenamed({"node": side, "tie": f"_t{side}"}), side, "left")
        return pairs.where("coalesce(_ta, a) <> coalesce(_tb, b)").drop("_ta", "_tb")

    def starred(entries: DataFrame) -> DataFrame:
        return entries.join(member.select("node", "a"), "node", "left").select("shingle", F.coalesce("a", "node").alias("star"))

    def lists(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Entries of short lists, shingles of long ones, and all entries, by star."""
        held = saved(starred(entries).distinct(), "lists", files)
        count = held.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1")
        return held.join(count.where(F.col("k") <= LONG), "shingle").drop("k"), count.where(F.col("k") > LONG).select("shingle"), held

    def paired(short: DataFrame, skips: DataFrame | None = None) -> DataFrame:
        """a, b: stars that may fit by size and occur together in enough of the lists; in one, where `skips` (node, least) doesn't ask for more."""
        star = names.join(radius, "node", "left").select(F.col("node").alias("star"), "n", F.coalesce("radius", F.lit(0.0)).alias("r"))
        if skips is not None:
            lone = skips.join(radius.select("node"), "node", "left_anti").where("least > 1").select(F.col("node").alias("star"), "least")
            star = star.join(lone, "star", "left")
        star = star.withColumn("least", F.coalesce("least", F.lit(1)) if skips is not None else F.lit(1))
        one, two = (short.join(star, "star").withColumnsRenamed({"star": x, "n": f"_n{x}", "r": f"_r{x}", "least": f"_l{x}"}) for x in "ab")
        fits = f"a < b and 100 * least(_na, _nb) >= ({percent} - 100 * (_ra + _rb) - 1e-6) * greatest(_na, _nb)"
        met = one.join(two, "shingle").where(fits).groupBy("a", "b").agg(F.count("*").alias("met"), F.min(F.least("_la", "_lb")).alias("least"))
        return met.where("met >= least").select("a", "b")

    def read_too(near: DataFrame, nodes: DataFrame) -> DataFrame:
        late = few(firsts.join(nodes.join(near.select("node"), "node", "left_anti"), "node"), "late")
        return near.unionByName(texts_of(docs, late, size, unique, files)) if late.limit(1).count() else near

    short, long, held = lists(live)
    long = few(long, "long")
    if not long.limit(1).count():
        pairs = paired(short)
    else:
        # A set that met long lists goes on until as many short ones are to be expected, and some more, at the rate at which it has
        # met long ones so far; whom it meets there is read from all prefixes.
        met = few(live.join(long, "shingle").groupBy("node").agg(F.countDistinct("shingle").cast("int").alias("skipped")), "skipped")

        def further(batch):
            node, text, skipped = batch.columns
            for t in tb.slices(text):
                for i, s in enumerate(shingle_sets(t, size)):
                    p = len(s) - least_overlap(len(s), percent) + 1
                    m = skipped[t.rows.start + i].as_py()
                    more = s[p:p + 8 + (13 * m * p) // (10 * max(1, p - m))] if m < p else s[p:]
                    yield {"shingle": more.view(np.int64), "node": np.repeat(np.int64(node[t.rows.start + i].as_py()), len(more))}

        more = saved(arrow_map(picked(near.select("node", "text"), met).select("node", "text", "skipped"), "shingle long, node long", further), "further", files)
        done = [live, held, met]
        live = saved(live.unionByName(more).unionByName(entries_of(posts, more, bits)).distinct(), "live", files)
        discard(*done)
        short, long, held = lists(live)
        long = few(long, "long")
        # Of its p + m shingles a set shares m + 1 with a partner; so many of them, less the skipped ones, are in short lists.
        skips = live.join(long, "shingle").groupBy("node").agg(F.count("*").alias("gone")).join(more.groupBy("node").agg(F.count("*").alias("more")), "node", "outer")
        skips = saved(skips.na.fill(0).selectExpr("node", "more + 1 - gone as least").where("least <> 1"), "skips", files)
        pairs = paired(short, skips)
        # A set for which that is nothing tells all its shingles. The count of any other set that is linked with it holds, as the lists stay as they are;
        # so these two meet in a list that is not long, be it of one set, as prefixes that nobody shares may be.
        full = few(skips.where("least < 1").select("node"), "full")
        if full.limit(1).count():
            near = read_too(near, full)
            told = saved(arrow_map(picked(near.select("node", "text"), full), "shingle long, node long", whole), "told", files)
            ends = saved(starred(told).distinct(), "ends", files)
            open_ends = saved(ends.join(long, "shingle", "left_anti"), "open", files)
            others = held.unionByName(saved(starred(entries_of(posts, open_ends, bits)), "others", files))
            meets = open_ends.withColumnRenamed("star", "_x").join(others, "shingle").where("_x <> star")
            pairs = pairs.unionByName(meets.select(F.least("_x", "star").alias("a"), F.greatest("_x", "star").alias("b")))
            # Sets that tell all meet one another in lists of their own. Two of them without a short one in common differ in all their rare shingles:
            # linked they are at most where there are few of these, and such pairs are searched by joint shingles.
            count = ends.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1")
            pairs = pairs.unionByName(paired(ends.join(count.where(F.col("k") <= LONG).select("shingle"), "shingle"))).distinct()
            gone = told.join(count.where(F.col("k") > LONG).select("shingle"), "shingle").groupBy("node").agg(F.count("*").alias("gone"))
            asked = few(gone.join(names, "node").selectExpr("node", "n", "n - gone as rare"), "asked")
        discard(posts)
        if full.limit(1).count() and asked.limit(1).count():
            def joint(batch):
                for t in tb.slices(batch.column(1)):
                    keys = [joint_keys(s, percent) for s in shingle_sets(t, size)]
                    yield {"shingle": np.concatenate(keys).view(np.int64), "node": np.repeat(batch.column(0).to_numpy()[t.rows], [len(k) for k in keys])}

            differ = (100 - percent) / (100 + percent)  # of the sizes' sum, in linked sets
            keys = arrow_map(picked(near.select("node", "text"), asked.select("node")), "shingle long, node long", joint)
            # All that two may share are their shingles in long lists; that has to do for the size of the other.
            over = asked.join(member.select("node", "a"), "node", "left").groupBy(F.coalesce("a", "node").alias("star")).agg(
                F.max("n").alias("n"), F.min("rare").alias("rare"), F.min("n").alias("least"), F.expr(f"max({100 + percent} * (n - rare) - {percent} * n)").alias("room"))
            over = over.join(tied.withColumnRenamed("node", "star"), "star", "left").select(
                "star", F.expr(f"rare - n * {differ}").alias("over"), (percent * F.col("least")).alias("least"), "room", F.coalesce("tie", "star").alias("tie"))
            keys = saved(starred(keys).distinct().join(over, "star"), "joint", files)
            many = keys.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle")
            one, two = (keys.withColumnsRenamed({"star": x, "over": f"_o{x}", "least": f"_l{x}", "room": f"_r{x}", "tie": f"_t{x}"}) for x in "ab")
            one = one.where("_oa <= 1e-6").join(many, "shingle")
            fits = "a <> b and _ta <> _tb and _la <= _rb and _lb <= _ra and _oa + _ob <= 1e-6 and (a < b or _ob > 1e-6)"
            pairs = pairs.unionByName(one.join(two, "shingle").where(fits).selectExpr("least(a, b) as a", "greatest(a, b) as b")).distinct()
    # A pair of lone sets has to fit by size; pivots may have members that do.
    reach = apart_yet(pairs).join(radius.withColumnsRenamed({"node": "a", "radius": "ra"}), "a", "left").join(radius.withColumnsRenamed({"node": "b", "radius": "rb"}), "b", "left")
    reach = reach.select("a", "b", (F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))).alias("reach"))
    wide = sized(reach, "reach")
    wide = few(wide, "pairs")
    near = read_too(near, wide.select(F.col("a").alias("node")).unionByName(wide.select(F.col("b").alias("node"))).distinct())
    discard(live, held)
    wide = few(shortlisted(wide, near, percent), "shortlist")
    measured = few(probed(wide, near, size).withColumn("apart", apart), "measured")
    direct = measured.where(linked).select("a", "b")

    # Pivots that are not linked themselves, but near enough for members that are. Those of the smaller one are measured against the other: what
    # is linked with a member, but not with the pivot, differs from it in some of the shingles in which that member does.
    close = measured.where(~linked & (F.col("reach") > 0) & (F.col("apart") <= far + F.col("reach") + 1e-9)).select("a", "b", "apart")
    star = member.groupBy("a").agg(F.max("apart").alias("radius"), F.count("*").alias("many"))
    for side in ("a", "b"):
        close = close.join(star.withColumnsRenamed({"a": side, "radius": f"r{side}", "many": f"k{side}"}), side, "left")
    turned = F.expr("coalesce(kb, 0) > coalesce(ka, 0)")
    close = close.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("pivot"),
                         F.when(turned, F.col("rb")).otherwise(F.col("ra")).alias("radius"), "apart")
    of = member.select("node", F.col("a").alias("pivot"), F.col("apart").alias("off"))
    others = close.join(of, "pivot").where(f"off >= apart - {far} - radius - 1e-9").select("a", F.col("node").alias("b"))
    others = few(others.unionByName(close.select("a", F.col("pivot").alias("b"))).distinct(), "others")
    near = read_too(near, others.select(F.col("b").alias("node")).distinct())
    own = member.join(others.select("a").distinct(), "a", "left_semi").select("a", F.col("node").alias("b"))
    told = saved(differing(own.withColumn("member", F.lit(True)).unionByName(others.withColumn("member", F.lit(False))), near, size, percent), "told", files)
    often = told.where("not linked").groupBy("a", "shingle").agg(F.count("*").alias("k"))
    rarest = F.row_number().over(Window.partitionBy("a", "b").orderBy("k", "shingle"))
    one = told.where("member").join(often, ["a", "shingle"]).withColumn("at", rarest).where("at <= tell").select("a", F.col("b").alias("m"), "shingle")
    two = told.where("not member and not linked").select("a", "b", "shingle")
    inner = one.join(two, ["a", "shingle"]).where("m <> b").select(F.least("m", "b").alias("a"), F.greatest("m", "b").alias("b")).distinct()
    inner = few(apart_yet(sized(inner)), "inner")
    more_links = probed(inner, near, size).where(linked).select("a", "b").unionByName(told.where("linked").select("a", "b"))
    return spokes.select("a", "b").unionByName(direct).unionByName(more_links)


def join_documents(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text; other columns are left out).

    A row's set: its distinct shingles of `size` words (A-Z lower-cased, split at white space); with fewer words, the whole sequence
    as one. Rows link when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable by links, the
    row's own included. Null or empty texts and texts without words have empty sets and no links. Rows of equal sets are
    linked; they are searched as one. Rows without a doc_id keep a null component_id and link nothing. Rows that share a doc_id
    belong together. An empty table gives an empty result. Only components are delivered: neither the links nor how many a row has.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    rows = saved(described(docs, size), "sets")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    sets = full.groupBy(F.col("key").alias("node")).agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n"), F.first("minima").alias("minima"))
    files = file_count(rows.count())
    sets = saved(sets, "classes", files)
    unique = full.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() == 0
    found = links(docs.where("doc_id is not null"), sets, size, percent, unique)
    firsts = sets.select("node", "first")
    edges = found.join(firsts.withColumnsRenamed({"node": "a", "first": "u"}), "a").join(firsts.withColumnsRenamed({"node": "b", "first": "v"}), "b")
    copies = full.select("doc_id", F.col("key").alias("node")).join(firsts, "node").where("doc_id <> first").select("doc_id", "first")
    found = components(edges.select("u", "v").unionByName(copies.withColumnsRenamed({"doc_id": "u", "first": "v"})), "u", "v", files=files).withColumnRenamed("node", "doc_id")
    return rows.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, without those that have a smaller doc_id in their component; see `join_documents`.

    Of rows that share a doc_id one stays, that of the first text. Rows without a doc_id stay, and so do all empty texts with ids of their own.
    """
    gone_id, rank = (max(docs.columns, key=len) + x for x in ("_gone", "_rank"))  # names that no column has
    ids = docs.select(F.col("doc_id").cast("long").alias(gone_id))
    gone = join_documents(docs, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    if ids.where(F.col(gone_id).isNotNull()).groupBy(gone_id).agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        order = Window.partitionBy(F.coalesce(F.col("doc_id").cast("string"), F.uuid())).orderBy("text", *[c for c in docs.columns if c != "text"])
        left = left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return left
