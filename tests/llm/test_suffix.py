"""Byte-string removal against brute force."""

import hashlib

import numpy as np
import pytest

from lagweave.llm import suffix_dedup

DOCS = "doc_id long, text string, lang string, bytes long, name string"


def brute(rows, length=50):
    first = {}
    for doc, text in rows:
        if doc is not None:
            raw = (text or "").encode()
            for i in range(len(raw) - length + 1):
                w = raw[i:i + length]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if doc is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i:i + length]] < doc:
                    gone[i:i + length] = True
        gone[-1] = False
        spans = int((gone[1:] < gone[:-1]).sum())
        left = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def mixture(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé "), 6))
    passages = ["".join(word() for _ in range(int(rng.integers(4, 40)))) for _ in range(6)]
    rows = []
    for i in rng.permutation(60).tolist():
        parts = [passages[int(rng.integers(6))] if rng.random() < 0.5 else "".join(word() for _ in range(int(rng.integers(0, 30)))) for _ in range(int(rng.integers(0, 7)))]
        text = "".join(parts)
        cut = int(rng.integers(0, 10))
        rows.append((i, text[cut:] if rng.random() < 0.5 else text))
    rows += [(100 + i, rows[3][1]) for i in range(8)] + [(200, "ab" * 3000), (201, "x" + "ab" * 2000), (7, rows[0][1]), (7, "fresh " + passages[0]), (202, None), (203, "")]
    return rows + [(204, "short")] * 2 + [(None, passages[1] * 2)]


@pytest.mark.parametrize(("seed", "batches", "hot", "parts"), [(0, 4, 50_000, 3), (1, 1, 50_000, 1), (2, 5, 3, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, batches, hot, parts):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix_dedup, "COMPARED", hot)
    rows = mixture(seed)
    docs = spark.createDataFrame([(d, t, "en", 1, "n") for d, t in rows], DOCS).repartition(parts)
    got = suffix_dedup.dedup(docs, batches=batches).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a" * 49, "en", 1, "n"), (2, "a" * 49, "en", 1, "n"), (3, "b" * 50, "en", 1, "n")], DOCS)
    assert [r["n_removed"] for r in suffix_dedup.dedup(docs).collect()] == [0, 0, 0]
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "c" * 60, None, None, None)] * 2, DOCS)
    assert [r["n_removed"] for r in suffix_dedup.dedup(nulls).collect()] == [0, 0]
