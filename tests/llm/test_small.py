"""URL filter, packing and quality rules against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lagweave.llm import packing, quality_rules, tokens, url_filter
from lagweave.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_longest_url_rule_wins(spark):
    urls = [None, "", "no scheme", "http://a.NET", "http://a.net/", "https://x.example.net/en/1?a=/fr/", "http://example.net/en", "http://notexample.net/en/",
            "ftp://u.example.com/de/x#y", "http://example.com?x=/de/", "http://w.org/fr/", "http://org/fr/a/b", "a://b://c.net/x\ny", "http://net./", "http:///en/",
            "http://a.net/"]
    got = url_filter.filter_urls(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string"), URL_RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for row in got.collect():
        u = row["url"]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_rules_inside_a_segment_and_equal_rules(spark):
    pages = spark.createDataFrame([(0, "http://a.b/xyz"), (1, "http://a.b/xy/z"), (2, "http://b/q")], "page_id long, url string")
    rules = [("allow", "b", "/x"), ("block", "b", "/xy"), ("allow", "b", "/xy"), ("block", "", "/q")]
    assert [r["rule"] for r in url_filter.filter_urls(pages, rules).orderBy("page_id").collect()] == ["b/xy", "b/xy", "/q"]
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules).collect()} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, [("deny", "b", "/")])


def one_by_one(lengths, size):
    """The method on single sequences."""
    left, bins = sorted(lengths), []
    while left:
        items = [left.pop()]
        while fits := [x for x in left if x <= size - sum(items)]:
            items.append(fits[-1])
            left.remove(fits[-1])
        gap = size - sum(items)
        if gap and len(items) > 1:
            best = None
            for i in range(len(left)):
                for j in range(i + 1, len(left)):
                    if items[-1] < left[i] + left[j] <= gap + items[-1] and (best is None or left[i] + left[j] > sum(best)):
                        best = [left[i], left[j]]
            if best:
                left = sorted([*left, items.pop()])
                for x in best:
                    left.remove(x)
                items += sorted(best, reverse=True)
        bins.append(items)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_one_by_one(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(8, 60))
    lengths = rng.integers(1, size + 1, int(rng.integers(1, 80))).tolist()
    found = [items for many, items in packing.plan(np.bincount(lengths, minlength=size + 1), size) for _ in range(many)]
    assert Counter(x for b in found for x in b) == Counter(lengths)
    assert all(sum(b) <= size for b in found)
    assert sorted(map(sum, found)) == sorted(map(sum, one_by_one(lengths, size)))


def test_packed_documents_hold_every_id_once(spark):
    path = tokens.default_path()
    texts = ["", None, "Hello, World. It's <|endoftext|> über 3,5 Größe\u00a0x I\u0307 ŉa", "a b " * 3000, "same text", "same text", "ÉCOLE e\u0301cole … don't!! x.,"]
    docs = spark.createDataFrame([(i if i < 6 else None, t, "en", "s", 7, i) for i, t in enumerate(texts)], DOCS + ", offset long")
    got = packing.packed_documents(docs, path, keep_ids=True).toPandas()
    enc = tokens.tokenizer(path).tokenizer
    want = {(None if i > 5 else i): [*(enc.encode(t or "", add_special_tokens=False).ids), 0] for i, t in enumerate(texts)}
    for key, ids in want.items():
        rows = got[got.doc_id.isna() if key is None else got.doc_id == key].sort_values("piece")
        assert rows.piece.tolist() == list(range(-(-len(ids) // 2048)))
        have = [np.frombuffer(x, "<u4").tolist() for x in rows.ids]
        assert sum(have, []) == ids and all(len(x) == 2048 for x in have[:-1])
        assert [zlib.crc32(x) for x in rows.ids] == rows.ids_crc32.tolist()
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist() and rows.length.sum() <= 2048
    assert packing.packed_documents(docs.limit(0), path).count() == 0


def test_hot_length_is_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    rows = spark.range(300).selectExpr("id", "case when id < 200 then 3L else id % 7 + 1 end as length")
    got = packing.pack(rows, 10).toPandas()
    assert len(got) == 300 and not got.duplicated(["sequence_id", "offset"]).any()
    assert got.groupby("sequence_id").length.sum().max() <= 10
    with pytest.raises(ValueError):
        packing.pack(spark.range(1).selectExpr("id", "11L as length"), 10)


def counted(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_counts(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", " \n\t ", "x", "a b c d e f g h " * 3, "a\u00a0b\x1fc \x0b\x0c d\r\n\na\n a\na", "## || < > é$%&*", "w " * 5000,
             *[" ".join(rng.choice(list("abc"), 60)) + "\n" + " ".join(map(str, rng.integers(0, 9999, 40))) for _ in range(10)]]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", "s", 1, 5) for i, t in enumerate(texts)], DOCS + ", n_words long")
    for row in quality_rules.quality_rules(docs).collect():
        want = counted(texts[row["doc_id"]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row["base_failed"] and row["kept"])
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_limits_follow_the_group_and_fall_back(spark):
    good, wordy = "the quick brown fox jumps over one lazy dog number ", "internationalisation "
    rows = [(i, good + " ".join(f"{i}x{k}" for k in range(20)), "en", "big", 1) for i in range(60)]
    rows += [(100 + i, good + " ".join(f"{wordy}{i}x{k}" for k in range(20)), "xx", "odd", 1) for i in range(60)]
    rows += [(200, good + " ".join(f"### *** {k}" for k in range(20)), "en", "big", 1), (201, good + " ".join(f"### *** {k}" for k in range(20)), "en", "tiny", 1)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS), least_rows=20).collect()}
    assert all(kept[i] for i in range(60)) and all(kept[100 + i] for i in range(60))
    assert not kept[200] and not kept[201]


def test_sketches_merge(spark):
    docs = spark.createDataFrame([(i, " ".join("ab" * (k % (i + 1) + 1) for k in range(30)), f"l{i % 3}", f"s{i % 2}", 1) for i in range(30)], DOCS)
    counts = quality_rules.base_counts(docs)
    for groups in (["lang"], []):
        one = quality_rules.sketch(counts, groups)
        two = quality_rules.merged(quality_rules.sketch(counts, ["lang", "source"]), groups)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))
