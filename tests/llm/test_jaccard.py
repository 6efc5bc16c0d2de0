"""Jaccard join against all pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest

from lagweave.llm import components, jaccard_join
from lagweave.llm import textbytes as tb

DOCS = "doc_id long, text string, key long, n_shingles string"


def brute(rows, size=4, percent=85):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    sets = [shingles(t) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                    root[b] = a
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def mixture(seed):
    """Unrelated texts with common passages, groups that drift from copy to copy, exact copies, edge cases."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"W{i}é" if i % 3 else f"w{i}" for i in range(400)]
    draw = lambda n: rng.choice(vocabulary, n).tolist()
    passages = [draw(12) for _ in range(3)]
    texts = []
    for _ in range(40):
        texts.append(draw(int(rng.integers(5, 60))) + passages[int(rng.integers(3))] * int(rng.integers(0, 2)))
    for _ in range(40):
        texts.append(passages[int(rng.integers(3))] + draw(int(rng.integers(0, 3))))
    for _ in range(4):
        base = draw(int(rng.integers(30, 120)))
        for _ in range(15):
            base = list(base) if rng.random() < 0.7 else texts[-1]
            new = list(base)
            for _ in range(int(rng.integers(0, 3))):
                new[int(rng.integers(len(new)))] = draw(1)[0]
            texts.append(new)
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "one two"), (504, "ONE\x0btwo"), (505, "one two three"), (506, rows[0][1]), (506, rows[0][1]),
             (507, "a b c d e"), (508, "x " * 4000), (509, "X " * 3000), (510, rows[1][1].upper().replace("É", "é")), (None, rows[2][1])]
    return rows + [(int(5), "some other words here for the same id")]


@pytest.mark.parametrize(("seed", "long", "percent"), [(0, 32, 85), (1, 2, 85), (2, 1, 60), (3, 3, 50)])
def test_equals_all_pairs(spark, monkeypatch, seed, long, percent):
    monkeypatch.setattr(jaccard_join, "LONG", long)
    rows = mixture(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS).repartition(3)
    got = jaccard_join.join_documents(docs, percent=percent).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, percent=percent)


@pytest.mark.parametrize(("seed", "long", "percent"), [(4, 1, 60), (5, 2, 85)])
def test_lists_are_built_twice(spark, monkeypatch, seed, long, percent):
    """However many sets have to tell all their shingles, no list is counted again for them; so also where nothing is small enough to be sent to all tasks."""
    names = []

    def counted(df, name, *more, saved=jaccard_join.saved):
        names.append(name)
        return saved(df, name, *more)

    for name, value in (("LONG", long), ("SENT", 0), ("SOUGHT", 0), ("saved", counted)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = mixture(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS).repartition(3)
    got = jaccard_join.join_documents(docs, percent=percent).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, percent=percent)
    assert "ends" in names
    assert names.count("live") == names.count("lists") == 2


def test_few_texts_are_read_without_a_shuffle(spark):
    """Documents stay where they are if few of them are wanted."""
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('w', id) as text")
    wanted = spark.createDataFrame([(3, 33), (77, 777)], "doc_id long, node long")
    found = jaccard_join.picked(docs, wanted, "doc_id")
    assert sorted(map(tuple, found.collect())) == [(3, "w3", 33), (77, "w77", 777)]
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning" not in plan


def test_hashes_of_words():
    """Equal words have equal hashes wherever they lie, other words others; pieces of eight bytes and what is longer than all of them alike."""
    rng = np.random.default_rng(11)
    words = {bytes(rng.integers(0, 3, int(n)).astype(np.uint8)) for n in rng.integers(1, 3 * tb.WORD_BYTES, 3000)} | {b"\0", b"\0\0", b"a" * 8, b"a" * 9, b"a" * 64, b"a" * 65}
    seen = {}
    for _ in range(2):
        dealt = [sorted(words)[i] for i in rng.permutation(len(words))]
        end = np.cumsum([len(w) for w in dealt])
        start = end - [len(w) for w in dealt]
        for w, h in zip(dealt, tb.word_hashes(np.frombuffer(b"".join(dealt), np.uint8), start, end).tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(words)
    every = np.arange(256, dtype=np.uint8)
    assert bytes(tb.lowered(every)) == bytes(every).lower()
    text = rng.integers(0, 48, 5000).astype(np.uint8)
    cuts = np.array([0, 0, 700, 701, 5000, 5000])
    for one, two in zip(tb.words(tb.Texts(slice(0, 5), text, cuts)), tb.words(tb.Texts(slice(0, 5), text, cuts), tb._SPACE.copy()), strict=True):
        assert (one == two).all()


def test_empty(spark):
    docs = spark.createDataFrame([(1, None, 1, "x"), (2, "", 1, "x")], DOCS)
    assert sorted(map(tuple, jaccard_join.join_documents(docs).collect())) == [(1, 0, 1), (2, 0, 2)]
    assert jaccard_join.join_documents(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100, int(x)) for x in rng.permutation(np.arange(101, 140))] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, **{i: 100 for i in range(100, 140)}}


def test_joint_keys_meet():
    """Linked sets of every size share a joint key, and a part that is empty in both is none."""
    rng = np.random.default_rng(5)
    for trial in range(1500):
        percent = (85, 80, 60, 50)[trial % 4]
        n = int(rng.integers(1, 40 if trial % 3 else 800))
        pool = np.unique(rng.integers(0, 1 << 64, 3 * n, dtype=np.uint64))
        one = pool[np.sort(rng.permutation(len(pool))[:n])]
        gone = int(rng.integers(0, n - jaccard_join.least_overlap(n, percent) + 1))
        left = one[np.sort(rng.permutation(n)[gone:])]
        room = 100 * len(left) // percent - n  # the most that may be added
        two = np.union1d(left, pool[rng.permutation(len(pool))[:int(rng.integers(0, max(0, room) + 1))]])
        both = len(np.intersect1d(one, two))
        if both and 100 * both >= percent * (len(one) + len(two) - both):
            assert len(np.intersect1d(jaccard_join.joint_keys(one, percent), jaccard_join.joint_keys(two, percent)))
    far = [jaccard_join.joint_keys(np.unique(rng.integers(0, 1 << 64, 100, dtype=np.uint64)), 85) for _ in range(200)]
    assert len(np.unique(np.concatenate(far))) == sum(map(len, far))


def test_drifting_groups_and_large_sets(spark, monkeypatch):
    """Two groups that drift from copy to copy, documents made of common lines alone, sets sketched with four bytes."""
    monkeypatch.setattr(jaccard_join, "LONG", 8)
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: rng.choice(vocabulary, n).tolist()
    texts, lines = [], [draw(20) for _ in range(8)]
    for _ in range(2):
        base = draw(60)
        for _ in range(70):
            base = [draw(1)[0] if rng.random() < 0.03 else w for w in base]
            texts.append(base)
    texts += [sum((lines[i] for i in rng.permutation(8)[:int(rng.integers(1, 6))]), draw(int(rng.integers(0, 3)))) for _ in range(90)]
    long = draw(5200)
    for share in (0.005, 0.02, 0.06, 0.2):
        texts.append([draw(1)[0] if rng.random() < share else w for w in long])
    texts += [long, long[:4600], long[:4400], long[900:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS).repartition(4)
    got = jaccard_join.join_documents(docs).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_linked_sets_meet_in_telling_shingles():
    """What is linked with a pivot's member, but not with the pivot, differs from it in any so many of the member's shingles; a middle pivot leaves few."""
    rng = np.random.default_rng(3)
    met = 0
    for trial in range(4000):
        percent = (85, 80, 60)[trial % 3]
        n = int(rng.integers(20, 90))
        pivot = rng.choice(400, n, replace=False)
        change = lambda s, most: np.union1d(rng.permutation(s)[int(rng.integers(0, most)):], rng.choice(400, int(rng.integers(0, most))))
        member = change(pivot, 1 + n // 10)
        other = change(member, 1 + n // 10)
        linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))
        if linked(pivot, member) and linked(member, other) and not linked(pivot, other):
            apart = rng.permutation(np.setxor1d(pivot, member))
            tell = apart[:jaccard_join.telling(len(apart), len(pivot), len(member), percent)]
            assert len(np.intersect1d(tell, np.setxor1d(pivot, other)))
            met += 1
    assert met > 100
    assert jaccard_join.telling(8, 147, 147, 85) == 4  # one word of 147 replaced: only what the member alone has


def test_prefixes_hold_no_whole_sets(monkeypatch):
    """Entries that wait in a task are copies: views would keep every set in memory; and they go when they are sent."""
    seen, posted = [], jaccard_join._posted

    def watched(held, bits):
        seen.extend(s.base is None for s, _ in held)
        out = posted(held, bits)
        assert not held
        return out

    class Rows:
        def mapInArrow(self, fn, schema):
            texts = [" ".join(f"w{i}" for i in range(d, d + 100)) for d in range(30)]
            return list(fn([pa.RecordBatch.from_pydict({"doc_id": range(30), "text": texts})] * 2))

    monkeypatch.setattr(jaccard_join, "_posted", watched)
    monkeypatch.setattr(jaccard_join, "HELD", 100)
    out = jaccard_join.prefixes(Rows(), 4, 85, 3)
    assert len(seen) == 60
    assert all(seen)
    assert len(out) == 2
    assert sum(sum(b.column("n").to_pylist()) for b in out) == 2 * 30 * (97 - jaccard_join.least_overlap(97, 85) + 1)


def test_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, tables of a few sets are not cut into as many files."""
    files, parts = [], "spark.sql.shuffle.partitions"

    def counted(df, name, *more, saved=jaccard_join.saved):
        out = saved(df, name, *more)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(jaccard_join, "saved", counted)
    monkeypatch.setattr(components, "saved", counted)
    rows = [(d, t) for d, t in mixture(3) if d is not None]
    kept = {k: spark.conf.get(k) for k in (parts, "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set(parts, 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {"live", "lists", "texts", "spokes", "edges"} <= {n for n, _ in files}
    assert max(k for _, k in files) <= spark.sparkContext.defaultParallelism
    assert not jaccard_join.file_count(0) < 1 < jaccard_join.file_count(10 * jaccard_join.FILE_SETS)
