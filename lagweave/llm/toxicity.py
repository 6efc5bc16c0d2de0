"""Toxicity as a weighted finite-state grammar over clauses.

A lexicon transducer rewrites words as the symbols insult, threat, target, negation and report (or other); insults and their weights are
whole words and word beginnings learnt from labels. Four small transducers read these symbols; their composition is one table of
states in which every insult, or threat at a target, is put out on one path: plain, negated, reported, aimed, and what combines of them.
A document's score weighs the paths that its clauses match; the weights are learnt too.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow_map, shared
from .fitting import is_held_out, labelled_sample, logistic, sample_texts

#: Documents of each label that lexicon and weights are fitted on; entries of the lexicon.
FIT_DOCS, MAX_ENTRIES = 3_000, 5_000
#: An entry has to be so many times as frequent in toxic documents as in others.
LEAST_RATE = 20
#: Bytes of a word's beginning that may become an entry.
STEMS = range(3, 10)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
WORDS = {
    THREAT: "kill hurt destroy murder beat töten umbringen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself u du dich dir euch ihr sie tu te toi vous ton ta tus tú ti usted ustedes vosotros",
    NEGATION: "not never no isn't aren't wasn't don't nicht nie kein keine niemals ne pas jamais aucun nunca jamás ningún",
    REPORT: "said says saying wrote writes claimed claims called quoted reported sagte sagt schrieb nannte behauptet dit écrit déclaré appelé dijo dice escribió llamó",
}
#: Words after a negation that it still reaches.
REACH = 3

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), ord("'"), *range(128, 256)]] = False
_END = np.zeros(256, bool)
_END[list(b".!?;:\n")] = True


def _compose() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """next[state, symbol], path[state, symbol] (0: nothing put out) and the paths' names.

    The factors: negation counts down REACH words; a report, a target and a threat hold until the clause ends.
    """
    states = list(product(range(REACH + 1), (0, 1), (0, 1), (0, 1)))
    number = {s: i for i, s in enumerate(states)}
    names = [""]
    for kind in ("insult", "aimed insult", "threat"):
        names += [" ".join(x for x in (neg, rep, kind) if x) for rep, neg in product(("", "reported"), ("", "negated"))]
    table, path = np.zeros((len(states), 6), np.int64), np.zeros((len(states), 6), np.int64)
    for (neg, rep, aim, threat), symbol in product(states, range(6)):
        after = (REACH if symbol == NEGATION else max(0, neg - 1), int(rep or symbol == REPORT), int(aim or symbol == TARGET), int(threat or symbol == THREAT))
        mood = int(neg > 0) + 2 * rep
        if symbol == INSULT:
            out = 1 + mood + 4 * aim
        elif symbol == THREAT and aim or symbol == TARGET and threat:
            out, after = 9 + mood, (*after[:3], 0)
        else:
            out = 0
        table[number[neg, rep, aim, threat], symbol] = number[after]
        path[number[neg, rep, aim, threat], symbol] = out
    return table, path, names


NEXT, PATH, PATHS = _compose()
#: Log odds that a unit of each path adds before anything is learnt.
PRIOR = np.array([(0.3 if "negated" in n else 1) * (0.5 if "reported" in n else 1) * (1.2 if "aimed" in n else 1) for n in PATHS[1:]])


def word_hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    cuts = np.concatenate(([0], np.cumsum([len(w) for w in raw]))).astype(np.int64)
    return tb.Hasher(np.frombuffer(b"".join(raw), np.uint8))(cuts[:-1], cuts[1:])


def _sorted_fixed() -> tuple[np.ndarray, np.ndarray]:
    pairs = [(h, s) for s, text in WORDS.items() for h in word_hash(text.split()).tolist()]
    pairs.sort()
    return np.array([h for h, _ in pairs], np.uint64), np.array([s for _, s in pairs], np.int64)


def _looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted `keys`, and whether they hold the wanted ones."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Grammar:
    """Hashes of whole words and of beginnings by length, with weights; the weights of the paths, the last for none at all."""

    stems: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # 0: whole words
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    theta: np.ndarray = field(default_factory=lambda: np.append(PRIOR, 0.0))

    def paths(self, texts: tb.Texts) -> np.ndarray:
        """For each row, the summed lexicon weight put out on each path."""
        data = tb.lowered(texts.data)
        start, end, first = tb.words(tb.Texts(texts.rows, data, texts.cuts), _GAP)
        total = np.zeros((len(texts), len(PATHS) - 1))
        fixed, kinds = _sorted_fixed()
        if not len(start):
            return total
        whole = tb.Hasher(data)
        weight = np.zeros(len(start))
        if len(self.heads):
            near = np.flatnonzero(np.isin(_heads(data, start, end), self.heads))
            for size, (keys, values) in self.stems.items():
                i = near if size == 0 else near[end[near] - start[near] >= size]
                at, hit = _looked_up(keys, whole(start[i], end[i] if size == 0 else start[i] + size))
                np.maximum.at(weight, i[hit], values[at[hit]])
        symbol = np.where(weight > 0, INSULT, OTHER)
        at, hit = _looked_up(fixed, whole(start, end))
        symbol = np.where((symbol == OTHER) & hit, kinds[at], symbol)
        # Clauses end at a mark, a line's end or a row's end; only those with an insult or threat are read on.
        marks = np.concatenate(([0], np.cumsum(_END[data], dtype=np.int64)))
        new = np.ones(len(start), bool)
        new[1:] = marks[start[1:]] > marks[end[:-1]]
        new[first[first < len(start)]] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(start)))
        alive = np.add.reduceat(((symbol == INSULT) | (symbol == THREAT)).astype(np.int64), begin) > 0
        begin, size = begin[alive], size[alive]
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state = np.zeros(len(begin), np.int64)
        row = np.searchsorted(first, begin, side="right") - 1
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            i = begin[:live] + t
            out = PATH[state[:live], symbol[i]]
            hit = out > 0
            np.add.at(total, (row[:live][hit], out[hit] - 1), np.where(symbol[i[hit]] == INSULT, weight[i[hit]], 1.0))
            state[:live] = NEXT[state[:live], symbol[i]]
        return total

    def score(self, texts: tb.Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(self.paths(texts)) @ self.theta[:-1] + self.theta[-1], -30, 30)))


def _heads(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first three bytes of each word as a number; shorter words are filled with zeros."""
    code = np.zeros(len(start), np.int64)
    for k in range(3):
        at = start + k
        code = code * 256 + np.where(at < end, data[np.minimum(at, len(data) - 1)], 0)
    return code


def candidates(texts: tb.Texts, label: np.ndarray) -> dict:
    """Words and beginnings: for each, in how many rows of label 1 and 0 it occurs."""
    data = tb.lowered(texts.data)
    start, end, first = tb.words(tb.Texts(texts.rows, data, texts.cuts), _GAP)
    row = np.searchsorted(first, np.arange(len(start)), side="right") - 1
    # One word of each row is enough, however often it occurs.
    whole = tb.Hasher(data)
    name = whole(start, end)
    order = np.lexsort((row, name))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (row[order][1:] != row[order][:-1])
    i = order[new]
    start, end, row, name = start[i], end[i], row[i], name[i]
    head = _heads(data, start, end)
    parts = [(np.zeros(len(i), np.int64), name, np.zeros(len(i), np.uint64), head, row)]
    before = whole(start, np.minimum(end, start + STEMS.start - 1))
    for size in STEMS:
        j = np.flatnonzero(end - start >= size)
        now = whole(start[j], start[j] + size)
        parts.append((np.full(len(j), size), now, before[j], head[j], row[j]))
        before = np.zeros(len(start), np.uint64)
        before[j] = now
    size, key, parent, head, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((row, key, size))
    size, key, parent, head, row = (x[order] for x in (size, key, parent, head, row))
    same = (size[1:] == size[:-1]) & (key[1:] == key[:-1])
    once = np.concatenate(([True], ~(same & (row[1:] == row[:-1]))))
    group = np.concatenate(([True], ~same))
    at = np.flatnonzero(group)
    toxic = np.add.reduceat((once & (label[row] == 1)).astype(np.int64), at) if len(at) else at
    clean = np.add.reduceat((once & (label[row] == 0)).astype(np.int64), at) if len(at) else at
    return {"size": size[at].astype(np.int32), "key": key[at].view(np.int64), "parent": parent[at].view(np.int64), "head": head[at].astype(np.int32), "toxic": toxic, "clean": clean}


def lexicon(found: list[tuple], toxic: int, clean: int) -> Grammar:
    """Keep what marks toxic rows beyond chance; of a chain of beginnings, the longest that loses no rows.

    found: (size, key, parent, head, rows of label 1, rows of label 0), already beyond chance.
    """
    rate = {(s, k): np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) for s, k, _, _, t, c in found}
    count = {(s, k): t for s, k, _, _, t, _ in found}
    longer = {}
    for s, k, parent, _, t, _ in found:
        if s > STEMS.start and t >= 0.95 * count.get((s - 1, parent), np.inf):
            longer[s - 1, parent] = (s, k)
    entries: dict[int, dict[int, float]] = {}
    heads = set()
    kept = set()
    for s, k, parent, head, _, _ in sorted(found, key=lambda x: (x[0] == 0, x[0], x[1])):
        covered = (s - 1, parent) in kept
        if covered:
            kept.add((s, k))
        if (s, k) in longer or covered:
            continue
        if s:
            kept.add((s, k))
        entries.setdefault(s, {})[k] = rate[s, k]
        heads.add(head)
    model = Grammar(heads=np.array(sorted(heads), np.int64))
    for s, own in entries.items():
        keys = np.array(list(own), np.int64).view(np.uint64)
        order = np.argsort(keys)
        model.stems[s] = (keys[order], np.array(list(own.values()))[order])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = FIT_DOCS) -> Grammar:
    """Fit on at most `per_class` labelled documents of each class outside the held-out fold; at most MAX_ENTRIES entries.

    Whether an entry is beyond chance is judged by twice the log likelihood ratio, against the number of candidates.
    """
    sample, counts = labelled_sample(labels, label, folds, fold, per_class)
    texts = sample_texts(docs, sample).persist()
    drawn = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = drawn.get(1, 0), drawn.get(0, 0)
    if not toxic or not clean:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        texts.unpersist()
        return Grammar(theta=np.append(PRIOR, np.log(share / (1 - share))))

    def fn(batch):
        y = np.array(batch.column(2).to_pylist(), np.int64)
        for t in tb.slices(batch.column(1)):
            yield candidates(t, y[t.rows])

    each = arrow_map(texts, "size int, key long, parent long, head int, toxic long, clean long", fn)
    each = each.groupBy("size", "key").agg(F.min("parent").alias("parent"), F.min("head").alias("head"), F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    share = toxic / (toxic + clean)
    ratio = F.expr(f"2 * (t * ln(t / ((t + c) * {share!r}D)) + case when c > 0 then c * ln(c / ((t + c) * {1 - share!r}D)) else 0 end)")
    at_all = each.where("t + c > 2").count()
    strong = each.where(f"t > 2 and (t + 0.5) / ({toxic} + 1) >= {LEAST_RATE} * (c + 0.5) / ({clean} + 1)").withColumn("ratio", ratio).where(F.col("ratio") > 2 * np.log(max(2, at_all)) + 8)
    found = [tuple(r)[:6] for r in strong.orderBy(F.desc("ratio"), "size", "key").limit(MAX_ENTRIES).collect()]
    model = lexicon(found, toxic, clean)

    def read(batch):
        for t in tb.slices(batch.column(1)):
            yield {"label": batch.column(2).slice(t.rows.start, len(t)), "paths": pa.array(list(model.paths(t)), pa.list_(pa.float64()))}

    rows = arrow_map(texts, "label int, paths array<double>", read).collect()
    texts.unpersist()
    x = np.log1p(np.array([r["paths"] for r in rows]))
    y = np.array([r["label"] for r in rows], float)
    weight = np.where(y == 1, counts[1] / toxic, counts[0] / clean)
    model.theta = logistic(x, y, weight / weight.mean(), np.append(PRIOR, 0.0))
    return model


def score_documents(docs: DataFrame, model: Grammar, folds: int = 5, fold: int = 0, limit: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`, from whole texts alone.

    Texts in which no clause matches (null and empty ones too) all get the score of no match. Null ids are not held out. Equal
    texts get equal scores; an empty table gives an empty result. Other columns are left out.
    """
    grammar = shared(docs.sparkSession, model)

    def fn(batch):
        for t in tb.slices(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(t.rows.start, len(t)), "score": grammar().score(t)}

    scored = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, score double", fn)
    return scored.select("doc_id", is_held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
