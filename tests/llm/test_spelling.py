"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lagweave.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    n = counted(rows)
    form, out = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [len(own)]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n[w], out[w][0], n[form[w]] if form[w] else None)
    return set(out.values())


def corpus(seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdeéßÿ") for _ in range(rng.randint(7, 11))) for _ in range(40)]

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcéZ") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1:], w[:k] + w[k + 1:] + w[k]])

    some = bases + [slip(b) for b in bases for _ in range(4)] + [slip(slip(b)) for b in bases for _ in range(4)]
    weight = [rng.choice([1, 3, 30, 300]) for _ in some]
    rows = [(i, rng.choice([" ", "1", "-"]).join(rng.choices(some, weight, k=60))) for i in range(120)]
    rows += [(200 + k, "chainword " * 200 + "chainwore " * 10 + "chainwere ") for k in range(3)]
    return rows + [(500, None), (501, ""), (None, "Résumés résumés Résumés RÉSUMÉS"), (502, "A" * 300 + " " + "a" * 300 + " " + "a" * 301), (502, "A" * 300 + "×÷" + "a" * 301)]


@pytest.mark.parametrize("seed", range(2))
def test_variants_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, word string, n long").repartition(5)
    got = spelling.group_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert {tuple(r) for r in got.collect()} == want
    assert any(x[1] for x in want) and any(x[2] not in (x[0], x[1]) for x in want)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "short ones only")], "doc_id long, text string")
    assert spelling.group_variants(docs).count() == 0 and spelling.group_variants(docs.limit(0)).count() == 0


def test_crc_of_joined_strings():
    rng = random.Random(0)
    for _ in range(200):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(20))) for _ in range(2))
        got = spelling.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)


def test_near_words_share_a_signature():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 12)))
        k = rng.randrange(len(a))
        for b in (a[:k] + a[k + 1:], a[:k] + "z" + a[k + 1:], a[:k] + "a" + a[k:]):
            place, key = spelling.signatures([a, b])
            assert set(key[place == 0]) & set(key[place == 1])
