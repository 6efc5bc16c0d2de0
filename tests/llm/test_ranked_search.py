"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lagweave.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(x):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(x or "")]


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    count, length = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        ranks = []
        for i, c, n in found:
            m = 100 - 25 + (25 * n * count) // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                ranks.append((-s, i is None, i, s))
        ranks.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, rank + 1, i, s) for rank, (_, _, i, s) in enumerate(ranks[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "a", "of", *(f"w{k}" for k in range(60)), "Größe", "naïve", "中文", "x1"]
    weight = [300, 200, 100, *(100 / (k + 1) for k in range(60)), 1, 1, 1, 1]
    docs = [(i, rng.choice([" ", ", ", "_"]).join(rng.choices(words, weight, k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!"), (None, "the w5 w6 w7"), (n + 4, "the w5 w6 w7"), (n + 4, "the w5 w6 w7"), (n + 5, "w9 " * 5000)]
    items = [(k, " ".join(rng.choices(words, weight, k=rng.randint(1, 12)))) for k in range(12)]
    items += [(50, None), (51, "!!"), (52, "nowhere"), (53, "w5 W5 w5 w6"), (53, "w5 W5 w5 w6"), (None, "the the a"), (54, "w9")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST_DEPTH", [1, 8, 256][seed])
    docs, items = corpus(seed, 300)
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(4)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    for k, block, shard, postings in ((20, 10 ** 6, 1 << 16, 10 ** 6), (3, 20, 37, 400), (400, 10 ** 6, 100, 1)):
        got = ranked_search.search(table, wanted, k, block_terms=block, shard_docs=shard, shard_postings=postings)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "")], "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0 and ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.where("doc_id = 2"), items).count() == 0


def test_many_equal_scores_are_settled():
    doc, n = np.arange(5000), 5000
    shard = ranked_search.Shard(np.concatenate([doc, doc[::7]]), np.concatenate([np.zeros(n, int), np.ones(len(doc[::7]), int)]),
                                np.concatenate([np.full(n, 10), np.full(len(doc[::7]), 3)]), n, 2)
    best, score = shard.best(np.array([0, 1]), np.array([5, 2]), 20, doc[::-1].copy())
    assert best.tolist() == sorted(doc[::7].tolist(), reverse=True)[:20] and set(score.tolist()) == {56}
