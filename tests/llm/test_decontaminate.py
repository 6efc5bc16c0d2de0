"""Greedy string tiling against a word-by-word version; planted test items."""

import random
import re

import numpy as np
import pytest

from lagweave.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id long, coverage string"


def tiled(a, b, least):
    """Tiling by definition: mark all longest unmarked matches, in order, until none of `least` is left."""
    used = set(), set()
    found = []
    while True:
        best, at = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used[0] and j + k not in used[1]:
                    k += 1
                if k > best:
                    best, at = k, [(i, j)]
                elif k == best and k >= least:
                    at.append((i, j))
        if not at:
            return found
        for i, j in at:
            if not any(i + k in used[0] or j + k in used[1] for k in range(best)):
                used[0].update(range(i, i + best))
                used[1].update(range(j, j + best))
                found.append(best)


@pytest.mark.parametrize("seed", range(8))
def test_tiles(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 4, int(rng.integers(1, 40))).astype(np.uint64), rng.integers(0, 4, int(rng.integers(1, 60))).astype(np.uint64)
    least = int(rng.integers(1, 5))
    assert dc.tiles(a, b, least) == tiled(a.tolist(), b.tolist(), least)


def words(text):
    return re.findall(r"[0-9A-Za-z'\x80-\U0010ffff]+", (text or "").lower())


@pytest.mark.parametrize("block", [1, 10_000])
def test_equals_brute_force(spark, block):
    rnd = random.Random(3)
    pool = [f"w{i}" for i in range(300)] + ["Ünder", "garçon", "don't"]
    draw = lambda n: [rnd.choice(pool) for _ in range(n)]
    items = [draw(rnd.randint(5, 40)) for _ in range(12)] + [draw(4), []]
    texts = []
    for k in range(80):
        item = items[k % len(items)]
        cut = rnd.randint(0, len(item))
        parts = [draw(rnd.randint(0, 40)), item[cut:], draw(rnd.randint(0, 3)), item[:cut] if k % 3 else item[:cut // 2], draw(rnd.randint(0, 40))]
        texts.append(", ".join(w.upper() if k % 2 else w for p in parts for w in p))
    texts += [None, "", " ".join(items[0] * 300), "a " * 20000]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1, "x") for i, t in enumerate(texts)], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(None, "a b c d e f"), (99, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in dc.contaminated_pairs(docs, bench, block_words=block).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            if len(x) >= 5:
                share = sum(tiled(words(" ".join(x)), words(t)[:3000], 5)) / len(x)
                if share >= 0.8:
                    want[i if i != 3 else None, k] = share
    assert got == pytest.approx(want) and len(want) > 30
    bad = {d for d, _ in want}
    left = dc.decontaminated(docs, bench, block_words=block)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i if i != 3 else None for i in range(len(texts))} - bad


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 1, "x")], DOCS)
    bench = spark.createDataFrame([(1, "A, b c-d e!")], "item_id long, text string")
    assert dc.contaminated_pairs(docs.limit(0), bench).count() == dc.contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert dc.contaminated_pairs(docs.union(docs), bench).count() == 2
    assert dc.decontaminated(docs, bench.limit(0)).count() == 1


def test_short_items_punctuation_and_scripts_without_spaces(spark):
    items = spark.createDataFrame([(1, "four words stand here"), (2, "Well, it’s “done” — she said so at last"), (3, "今天天气很好我们去公园"), (4, "..."), (5, "é")], "item_id long, text string")
    rows = [(1, "x four WORDS, stand here y"), (2, "four words stand"), (3, 'well it\'s "done" - she said so at last!'), (4, "前今天天气很好我们去公园了"), (5, "今天天气"),
            (6, "É"), (7, "été"), (8, None), (9, "four words\nstand here four words stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated_pairs(docs, items).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (6, 5), (9, 1)}
    for block in (1, 10 ** 6):
        assert {r["doc_id"] for r in dc.decontaminated(docs, items, block_words=block).collect()} == {2, 5, 7, 8}
        assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated_pairs(docs, items, block_words=block).collect()} == got
