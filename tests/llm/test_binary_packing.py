"""Binary packing and the tokenizer's chunks: exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lagweave.llm import binary_packing, tokens

DOCS = "doc_id long, text string, start long, sequence_id string"
BYTES = "byte_bpe_50k.json"


def ids_of(text):
    return tokens.tokenizer(tokens.default_path(BYTES)).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 2, 8, 2048])
def test_lengths_are_binary(size):
    total = np.arange(0, 5 * size + 3)
    of, length = binary_packing.binary_lengths(total, size)
    for n in total.tolist():
        own = length[of == n].tolist()
        assert sum(own) == n and own == sorted(own, reverse=True) and all(x & (x - 1) == 0 and x <= size for x in own)
        rest = [x for x in own if x < size]
        assert len(set(rest)) == len(rest)


@pytest.mark.parametrize("size", [8, 2048])
def test_every_id_lies_in_one_piece(spark, size):
    texts = ["", None, "Hello, World. It's <|endoftext|> über", "a b " * 4000, "same text", "same text", " x", "\n\n  tab\t", "一二三" * 50]
    docs = spark.createDataFrame([(i if i != 6 else None, t, 5, "x") for i, t in enumerate(texts)], DOCS).repartition(3)
    sequences = binary_packing.binary_sequences(docs, tokens.default_path(BYTES), size, keep_ids=True)
    got = sequences.toPandas()
    assert not got.sequence_id.duplicated().any() and (got.offset == 0).all()
    for i, t in enumerate(texts):
        rows = got[got.doc_id.isna() if i == 6 else got.doc_id == i].sort_values("start")
        ids = [*ids_of(t), 1]
        assert rows.start.tolist() == (rows.length.cumsum() - rows.length).tolist()
        assert np.concatenate([np.frombuffer(x, "<u4") for x in rows.ids]).tolist() == ids
        assert (rows.doc_tokens == len(ids)).all() and [zlib.crc32(x) for x in rows.ids] == rows.ids_crc32.tolist()
        assert all(n & (n - 1) == 0 and n <= size for n in rows.length)
    # A range of numbers is a bucket.
    order = got.sort_values("sequence_id").length.tolist()
    assert order == sorted(order)
    assert binary_packing.binary_sequences(docs.limit(0), tokens.default_path(BYTES)).count() == 0
    with pytest.raises(ValueError):
        binary_packing.binary_sequences(docs, tokens.default_path(BYTES), 12)


def test_buckets_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * i, 0, "") for i in range(40)], DOCS)
    sequences = binary_packing.binary_sequences(docs, tokens.default_path(BYTES), 16, keep_ids=True)
    binary_packing.write_buckets(sequences, str(tmp_path / "out"))
    found = {}
    for length in (1, 2, 4, 8, 16):
        for r in binary_packing.bucket(spark, str(tmp_path / "out"), length).collect():
            assert len(r["ids"]) == length
            found[r["doc_id"], r["start"]] = r["ids"]
    for i in range(40):
        assert sum((found[k] for k in sorted(k for k in found if k[0] == i)), []) == [*ids_of("word " * i), 1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", BYTES])
@pytest.mark.parametrize("literal", [False, True])
def test_chunks_give_the_tokenizers_ids(name, literal, monkeypatch):
    rng = random.Random(3)
    pieces = ["a", "B", " ", "  ", "\n", "\t", " ", " ", "　", "'s", "'ll", " 12", "é", "É", "ß", "×", "中", "<|endoftext|>", "!", "?", "...", "\x1c",
              "\x85", "é", " don't", "x" * 70, "🙂", " word", " word.", " Wort,", "İ", "ŉ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", None, " ", "y" * 5000]
    enc = tokens.ChunkTokens(tokens.default_path(name), literal)
    for kept in (1_500_000, 200):
        monkeypatch.setattr(tokens, "CACHED_CHUNKS", kept)
        for t in tokens.tb.slices(pa.array(texts), 4000):
            ids, cuts = enc.encode(t)
            for i in range(len(t)):
                want = enc.tokenizer.encode(texts[t.rows.start + i] or "", add_special_tokens=False).ids
                assert ids[cuts[i]:cuts[i + 1]].tolist() == want, texts[t.rows.start + i]


def test_strings_that_share_a_hash_are_told_apart(monkeypatch):
    class Same(tokens.tb.Hasher):
        def __call__(self, start, end):
            return super().__call__(start, end) & np.uint64(3)

    monkeypatch.setattr(tokens.tb, "Hasher", Same)
    enc = tokens.ChunkTokens(tokens.default_path(BYTES))
    texts = ["one two three four five", "six seven eight one", "nine ten two"]
    for _ in range(2):
        ids, cuts = enc.encode(next(tokens.tb.slices(pa.array(texts))))
        for i, x in enumerate(texts):
            assert ids[cuts[i]:cuts[i + 1]].tolist() == ids_of(x)
