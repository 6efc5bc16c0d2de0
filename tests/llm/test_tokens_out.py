"""Token streams, their counts, and shards in training order: exact round trips."""

import zlib

import numpy as np
import pytest

from lagweave.llm import materialize, token_counts, tokens

DOCS = "doc_id long, text string, stream long, place string"
END = 49407
TEXTS = ["", None, "one two three", "x", "<|endoftext|> is text here", "word " * 5000, "same", "same", " \n", "über, größe. naïve"]


def docs_of(spark, parts=3):
    return spark.createDataFrame([(i if i != 3 else None, t, 9, "x") for i, t in enumerate(TEXTS * 3)], DOCS).repartition(parts)


def ids_of(text):
    return tokens.tokenizer(tokens.default_path(), True).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 17])
def test_counts_equal_the_tokenizer(spark, block):
    docs = docs_of(spark) if block > 1 else spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(["a b", None, "c"])], DOCS)
    blocks, places = token_counts.token_streams(docs, tokens.default_path(), END, block=block)
    got = places.join(token_counts.count_tokens(blocks, END), ["stream", "place"]).collect()
    want = sorted(((r["doc_id"], len(ids_of(r["text"]))) for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == want and all(r["ended"] for r in got)


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    want = []
    for k in range(3):
        ids = rng.choice([5, 6, 7], size=500 + k, p=[0.9, 0.08, 0.02]).astype("<u4")
        ids.tofile(tmp_path / f"part-{k}.bin")
        cuts = [-1, *np.flatnonzero(ids == 7).tolist()]
        want += [(k, i, b - a - 1, True) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        want += [(k, len(cuts) - 1, len(ids) - cuts[-1] - 1, False)] * (cuts[-1] < len(ids) - 1)
    (tmp_path / "part-9.bin").write_bytes(b"")
    for block in (1, 7, 100, 10_000):
        got = token_counts.count_tokens(token_counts.file_streams(spark, str(tmp_path), "<u4", block), 7, "<u4")
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_documents(spark):
    docs = docs_of(spark).limit(0)
    assert token_counts.document_counts(docs, tokens.default_path(), END).count() == 0
    assert materialize.ordered_documents(docs, tokens.default_path(), 1).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_slots_are_a_permutation(n):
    for key in (0, 1, 1 << 63):
        slot = materialize.slots(np.arange(n), n, key)
        assert sorted(slot.tolist()) == list(range(n))
        assert materialize._inverse(slot, n, key).tolist() == list(range(n))
    assert n < 17 or materialize.slots(np.arange(n), n, 1).tolist() != materialize.slots(np.arange(n), n, 2).tolist()


def test_shards_hold_every_id_once_and_resume(spark):
    docs, path, stride = docs_of(spark), tokens.default_path(), 16
    seqs = materialize.sequences(docs, path, stride, END, 0, "<u2").persist()
    rows = {(r["stream"], r["number"]): (r["ids"], r["doc_ids"]) for r in seqs.collect()}
    flat = []
    for stream in sorted({s for s, _ in rows}):
        ids = np.concatenate([np.frombuffer(rows[k][0], "<u2") for k in sorted(rows) if k[0] == stream])
        flat += ids[:np.flatnonzero(ids == END)[-1] + 1].tolist()
    docs_found = [tuple(x) for x in np.split(np.array(flat), np.flatnonzero(np.array(flat) == END) + 1) if len(x)]
    assert sorted(docs_found) == sorted((*ids_of(r["text"]), END) for r in docs.collect())
    owned = [d for k in rows for d in rows[k][1]]
    assert {r["doc_id"] for r in docs.collect()} == set(owned)
    shards = materialize.materialize(seqs, 42, stride, shard=64, chunk=8)
    total = len(rows)
    order = sorted(rows)
    want = [rows[order[i]][0] for i in materialize._inverse(np.arange(total), total, 42)]
    for start in (0, 1, 63, 64, 100, total - 1):
        assert [x.tobytes() for x in materialize.resumed(shards, start, stride, shard=64)] == want[start:]
    for r in shards.collect():
        assert r["first_slot"] == r["shard"] * 64 + r["chunk"] * 8 and len(r["ids"]) == r["n"] * stride * 2 and len(r["doc_ids"]) == r["n"]


def test_query_rows(spark):
    docs = docs_of(spark)
    got = materialize.ordered_documents(docs, tokens.default_path(), 7, stride=32).toPandas()
    seqs = materialize.sequences(docs, tokens.default_path(), 32, END, 0, "<u2").collect()
    assert sorted(got.slot) == list(range(len(seqs)))
    assert sorted(got.ids_crc32) == sorted(zlib.crc32(r["ids"]) for r in seqs)
