"""Token ids of texts by a tokenizer file whose pieces never cross spaces; each distinct chunk between spaces is encoded once."""

from __future__ import annotations

import itertools
import json
import sys
import types

import numpy as np

from . import textbytes as tb

#: Chunks that a Python worker keeps encoded; beyond it the store starts anew. About 50 MB, held as long as the worker lives.
CACHED_CHUNKS = 400_000
#: Longer chunks are encoded each time.
KEPT_BYTES = 64
#: Bytes that begin a character which is surely no white space.
_VISIBLE = np.ones(256, bool)
_VISIBLE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: How byte-level files cut a text before merging: a fixed pattern of theirs.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_STORE = "lagweave_worker_tokens"


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str, literal: bool = False) -> ChunkTokens:
    """The worker's encoder of this file. It outlives a task, as the worker process does, so that chunks stay encoded.

    `literal`: names of special tokens in a text are ordinary text.
    """
    store = sys.modules.setdefault(_STORE, types.ModuleType(_STORE)).__dict__
    if (path, literal) not in store:
        store[path, literal] = ChunkTokens(path, literal)
    return store[path, literal]


class ChunkTokens:
    """Ids of whole texts, as the tokenizer gives without special tokens. Texts are cut into chunks that no token crosses.

    Two kinds of tokenizer files: those that drop white space and split at it (chunks are what stands between), and byte-level
    ones that keep it (a chunk begins at each space that a visible character follows: there a match of their pattern always begins).
    Chunks are found in the bytes of a slice at once and looked up by hash and bytes; only new ones go through the tokenizer.
    """

    def __init__(self, path: str, literal: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.model = self.tokenizer.model
        rule = json.loads(self.tokenizer.to_str())
        before = rule.get("pre_tokenizer") or {}
        self.keeps_space = rule.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        self.merger, self.real, self.last = self.merges(rule["model"])
        self.special = [t["content"] for t in rule.get("added_tokens", [])] if not literal else []
        self.reset()

    def reset(self) -> None:
        self.known = tb.Dictionary()
        self.flat, self.starts, self.counts = tb.Grown(np.uint32), tb.Grown(np.int64), tb.Grown(np.int64)

    def merges(self, model: dict):
        """The file's merges as ranks of byte strings, the number of each rank's token, and which ranks end a word.

        Where space is dropped, a word's last byte is a symbol of its own: words are given with a line feed, which is merged before all else.
        """
        import tiktoken

        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        close = model.get("end_of_word_suffix") or ""

        def raw(piece: str) -> bytes:
            ends = close and piece.endswith(close)
            return bytes(map(byte_of.__getitem__, piece[:len(piece) - len(close)] if ends else piece)) + b"\n" * bool(ends)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = [k for k in byte_of if k in model["vocab"]]
        first = [*letters, *[k + close for k in letters if close]]
        pieces = [*first, *map("".join, pairs)]
        ranks = {raw(x): k for k, x in enumerate(pieces)}
        if close and b"\n" not in ranks:
            ranks[b"\n"] = len(pieces)
        for b in range(256):
            ranks.setdefault(bytes([b]), len(ranks) + len(pieces))
        real = np.zeros(max(ranks.values()) + 1, np.uint32)
        last = np.zeros(len(real), bool)
        size = np.zeros(len(real), np.int64)
        for x, k in ranks.items():
            size[k], last[k] = len(x), x.endswith(b"\n")
        real[:len(pieces)] = [model["vocab"][x] for x in pieces]
        self.sizes = size
        return tiktoken.Encoding("merges", pat_str=r"[^\n]+\n" if close else _PATTERN, mergeable_ranks=ranks, special_tokens={}), real, last

    def cut(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each chunk, and the chunk numbers at which rows begin."""
        if not self.keeps_space:
            return tb.words(texts)
        begins = np.zeros(len(texts.data) + 1, bool)
        begins[:-2] = (texts.data[:-1] == 0x20) & _VISIBLE[texts.data[1:]]
        # The last byte of a row is followed by another row, not by its own character.
        begins[np.maximum(texts.cuts[1:] - 1, 0)] = False
        begins[texts.cuts[:-1]] = True
        begins[-1] = False
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], len(texts.data))[:len(start)], np.searchsorted(start, texts.cuts)

    def simple(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which chunks need no normalizer, and the ids of those, with their counts: merged by rank all together.

        Where space is kept, chunks that begin with it. Else letters of a-z and U+00C0 to U+00FF, with a full stop or comma after them or not.
        """
        size = end - start
        if self.keeps_space:
            fit = (data[start] == 0x20) & (size > 1)
            if self.special:
                fit[fit] = [not any(s in x for s in self.special) for x in (data[a:b].tobytes().decode() for a, b in zip(start[fit], end[fit], strict=True))] if _has(data, self.special) else True
            joined = data[tb.ranges(start[fit], size[fit])]
            found = np.array(self.merger.encode_ordinary(joined.tobytes().decode()), np.int64)
            done = np.searchsorted(np.cumsum(self.sizes[found]), np.cumsum(size[fit]), side="left") + 1 if len(found) else np.zeros(0, np.int64)
            return fit, self.real[found], np.diff(done, prepend=0)
        own = data[tb.ranges(start, size)]
        at = np.concatenate(([0], np.cumsum(size)))
        lead = np.concatenate(([False], own[:-1] == 0xC3))
        upper = (own >= 0x41) & (own <= 0x5A) | lead & (own >= 0x80) & (own <= 0x9E)
        letter = (own >= 0x61) & (own <= 0x7A) | (own >= 0x41) & (own <= 0x5A) | (own == 0xC3) | lead & (own != 0x97) & (own != 0xB7)
        mark = (size > 1) & ((own[at[1:] - 1] == 0x2E) | (own[at[1:] - 1] == 0x2C))
        odd = np.concatenate(([0], np.cumsum(~letter)))
        fit = odd[at[1:] - mark] == odd[at[:-1]]
        own = own + np.where(upper, 0x20, 0).astype(np.uint8)
        size, mark, at = size[fit], mark[fit], at[:-1][fit]
        room = size + 1 + mark
        base = np.cumsum(room) - room
        joined = np.full(int(room.sum()), 0x0A, np.uint8)
        joined[tb.ranges(base, size - mark)] = own[tb.ranges(at, size - mark)]
        joined[(base + size)[mark]] = own[(at + size - 1)[mark]]
        found = np.array(self.merger.encode_ordinary(joined.tobytes().decode()), np.int64)
        done = np.flatnonzero(self.last[found])[np.cumsum(1 + mark) - 1] + 1 if len(found) else np.zeros(0, np.int64)
        return fit, self.real[found], np.diff(done, prepend=0)

    def asked(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and their counts."""
        fit, ids, counts = self.simple(data, start, end)
        if fit.all():
            return ids, counts
        odd = np.flatnonzero(~fit)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([data[start[i]:end[i]].tobytes().decode() for i in odd], add_special_tokens=False)]
        total = np.zeros(len(start), np.int64)
        total[fit], total[odd] = counts, list(map(len, found))
        place = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)
        out[tb.ranges(place[fit], counts)] = ids
        out[tb.ranges(place[odd], total[odd])] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(total[odd].sum()))
        return out, total

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Keep the ids of chunks that differ from one another and from all known ones."""
        ids, counts = self.asked(data, start, end)
        self.starts.append(len(self.flat) + np.cumsum(counts) - counts)
        self.counts.append(counts)
        self.flat.append(ids)
        self.known.add(data, start, end, hashes)

    def encode(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the cuts between the texts."""
        start, end, first = self.cut(texts)
        hashes = tb.Hasher(texts.data)(start, end)
        code = self.known.find(texts.data, start, end, hashes)
        new = np.flatnonzero((code < 0) & (end - start <= KEPT_BYTES))
        if len(new):
            own, at = np.unique(hashes[new], return_index=True)
            if len(self.known) + len(own) > CACHED_CHUNKS and len(self.known):
                self.reset()
                return self.encode(texts)
            at = new[at]
            same = self.known.of_hash(own) >= 0  # another string has this hash: never kept
            self.learn(texts.data, start[at[~same]], end[at[~same]], own[~same])
            code[new] = self.known.find(texts.data, start[new], end[new], hashes[new])
        held = code >= 0
        counts = np.zeros(len(code), np.int64)
        counts[held] = self.counts[code[held]]
        if held.all():
            ids = self.flat[tb.ranges(self.starts[code], counts)]
        else:
            left = np.flatnonzero(~held)
            found, counts[left] = self.asked(texts.data, start[left], end[left])
            place = np.cumsum(counts) - counts
            ids = np.empty(int(counts.sum()), np.uint32)
            ids[tb.ranges(place[held], counts[held])] = self.flat[tb.ranges(self.starts[code[held]], counts[held])]
            ids[tb.ranges(place[left], counts[left])] = found
        return ids, np.concatenate(([0], np.cumsum(counts)))[first]


def _has(data: np.ndarray, names: list[str]) -> bool:
    raw = data.tobytes()
    return any(x.encode() in raw for x in names)


def encoded(column, path: str, end: int | None = 0, literal: bool = False):
    """Slices of a text column as (rows, ids, cuts); each text's ids are followed by the id `end`, if one is given."""
    enc = tokenizer(path, literal)
    for texts in tb.slices(column, 1 << 20):
        ids, cuts = enc.encode(texts)
        if end is not None:
            ids = np.insert(ids, cuts[1:], end)
            cuts = cuts + np.arange(len(cuts))
        yield texts.rows, ids, cuts
