"""Document quality from a linear-chain conditional random field that labels every line good or bad."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow_map, shared, where_text
from .fitting import is_held_out, labelled_sample, logistic, sample_texts

#: Labelled documents of each class that the model is fitted on, with their whole texts.
FIT_DOCS = 2000


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LETTER = _mask(bytes(range(65, 91))), _mask(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_CLASSES = {"symbol": _mask(b"#*$%&<>@^~=_\\{}[]|"), "bang": _mask(b"!?"), "pipe": _mask(b"|"), "digit": _mask(b"0123456789")}
#: Limits of the indicator features. A line has the feature if its share (or count) lies above (or below) the limit.
_ABOVE = {"symbol": (0.0, 0.02, 0.1, 0.25), "bang": (0.02, 0.1), "pipe": (0.01, 0.1), "digit": (0.05, 0.2, 0.5), "upper": (0.2, 0.5, 0.8),
          "repeat": (0.05, 0.2, 0.5), "length": (8, 12, 20), "words": (3, 10, 50)}
_BELOW = {"length": (3,), "words": (2,)}
WIDTH = sum(map(len, [*_ABOVE.values(), *_BELOW.values()]))


def line_features(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """0/1 features of every line that has a word, its characters beside white space, and the number of the first line of each row."""
    data = texts.data
    start, end, _ = tb.words(texts)
    if not len(start):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0), np.zeros(len(texts) + 1, np.int64)
    breaks = np.union1d(np.flatnonzero(data == 10) + 1, texts.cuts)
    line_of = np.searchsorted(breaks, start, side="right") - 1
    used, line_of = np.unique(line_of, return_inverse=True)
    low, high = breaks[used], np.append(breaks, len(data))[used + 1]
    first = np.searchsorted(low, texts.cuts)

    def count(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(mask[data], dtype=np.int64)))
        return upto[high] - upto[low]

    n = len(used)
    words = np.bincount(line_of, minlength=n)
    solid = np.bincount(line_of, weights=end - start, minlength=n)
    word = tb.Hasher(data)(start, end)
    again = np.concatenate(([False], (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])))
    value = {k: count(m) / solid for k, m in _CLASSES.items()}
    value["upper"] = count(_UPPER) / np.maximum(1, count(_LETTER))
    value["repeat"] = np.bincount(line_of, weights=again, minlength=n) / words
    value["length"] = solid / words
    value["words"] = words
    columns = [value[k] > x for k, limits in _ABOVE.items() for x in limits] + [value[k] < x for k, limits in _BELOW.items() for x in limits]
    return np.column_stack(columns).astype(np.float32), solid, first


@dataclass
class Field:
    """Log weights: of a line's features for good against bad, for itself and its neighbours; of equal labels in a row; of the first label."""

    own: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 3)))
    edge: np.ndarray = field(default_factory=lambda: np.zeros(4))  # constant, stay bad, stay good, first is good
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    base: float = 0.5

    def emission(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of good for each line from its own features and those of the lines before and after it in its row."""
        part = features @ self.own
        out = part[:, 0] + self.edge[0]
        inner = np.ones(len(out) + 1, bool)
        inner[first] = False
        out[1:] += np.where(inner[1:-1], part[:-1, 1], 0)
        out[:-1] += np.where(inner[1:-1], part[1:, 2], 0)
        return out

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per line the probability of good, and of (bad, bad) and (good, good) together with the line before it (0 for first lines).

        Forward and backward over all rows at once, line by line; a row takes part as long as it has lines.
        """
        counts = np.diff(first)
        rows = np.argsort(-counts, kind="stable")
        at, counts = first[:-1][rows], counts[rows]
        longest = int(counts[0]) if len(counts) else 0
        active = np.searchsorted(-counts, -np.arange(1, longest + 1), side="right")
        good = 1 / (1 + np.exp(-np.clip(emission, -40, 40)))
        local = np.stack([1 - good, good], 1)
        move = np.exp(np.array([[self.edge[1], 0.0], [0.0, self.edge[2]]]))
        begin = np.array([1.0, np.exp(self.edge[3])])
        forward, backward = np.ones((len(emission), 2)), np.ones((len(emission), 2))
        for t in range(longest):
            i = at[:active[t]] + t
            now = (begin if t == 0 else forward[i - 1] @ move) * local[i]
            forward[i] = now / now.sum(1, keepdims=True)
        pair = np.zeros((len(emission), 2))
        for t in range(longest - 1, 0, -1):
            i = at[:active[t]] + t
            after = backward[i] * local[i]
            both = forward[i - 1][:, :, None] * move[None] * after[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            pair[i] = both[:, [0, 1], [0, 1]]
            back = after @ move.T
            backward[i - 1] = back / back.sum(1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(1), pair

    def raw(self, features: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each row's length-weighted mean marginal; NaN for rows without lines."""
        good, _ = self.marginals(self.emission(features, first), first)
        part = np.concatenate(([0.0], np.cumsum(good * length)))
        total = np.concatenate(([0.0], np.cumsum(length)))
        weight = total[first[1:]] - total[first[:-1]]
        mean = np.clip((part[first[1:]] - part[first[:-1]]) / np.where(weight > 0, weight, np.nan), 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: tb.Texts) -> np.ndarray:
        raw = self.raw(*line_features(texts))
        return np.where(np.isnan(raw), self.base, 1 / (1 + np.exp(-(self.scale[0] * np.nan_to_num(raw) + self.scale[1]))))


def fit_field(rows: list[tuple[int, np.ndarray, np.ndarray]], counts: dict[int, int], steps: int = 120, ridge: float = 1e-3) -> Field:
    """Maximise the conditional likelihood of lines that carry their document's label, by Adam; then calibrate document scores.

    rows: label, features and lengths of each document's lines. counts: how many labelled documents each class has, so that scores
    follow their true shares. Without both labels the field stays flat and scores are the smoothed share of label 1.
    """
    model = Field(base=(counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    rows = [r for r in rows if len(r[1])]
    if len({r[0] for r in rows}) < 2:
        model.scale = np.array([0.0, np.log(model.base / (1 - model.base))])
        return model
    features = np.concatenate([r[1] for r in rows])
    length = np.concatenate([r[2] for r in rows])
    sizes = np.array([len(r[1]) for r in rows])
    first = np.concatenate(([0], np.cumsum(sizes)))
    label = np.array([r[0] for r in rows], float)
    drawn = {k: max(1, int((label == k).sum())) for k in (0, 1)}
    of = np.repeat(label, sizes)
    # Each class weighs the same, each document at most as ten lines.
    weight = np.repeat(1 / np.maximum(1, sizes / 10), sizes) * np.where(of == 1, 1 / drawn[1], 1 / drawn[0])
    weight /= weight.mean()
    inner = np.ones(len(of), bool)
    inner[first[:-1]] = False
    before, after = np.flatnonzero(inner) - 1, np.flatnonzero(inner)
    theta, m, v = np.zeros(3 * WIDTH + 4), np.zeros(3 * WIDTH + 4), np.zeros(3 * WIDTH + 4)
    for step in range(1, steps + 1):
        model.own, model.edge = theta[:3 * WIDTH].reshape(WIDTH, 3), theta[3 * WIDTH:]
        good, pair = model.marginals(model.emission(features, first), first)
        error = weight * (of - good)
        shifted = np.zeros((len(of), 3))
        shifted[:, 0] = error
        shifted[before, 1] = error[after]
        shifted[after, 2] = error[before]
        stay = np.stack([(of == 0), (of == 1)], 1)[after] - pair[after]
        gradient = np.concatenate([(features.T @ shifted).ravel(), [error.sum()], (weight[after][:, None] * stay).sum(0), [error[first[:-1]].sum()]])
        gradient = gradient / len(of) - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model.own, model.edge = theta[:3 * WIDTH].reshape(WIDTH, 3), theta[3 * WIDTH:]
    raw = model.raw(features, length, first)
    share = np.where(label == 1, counts.get(1, 0) / drawn[1], counts.get(0, 0) / drawn[0])
    model.scale = logistic(raw[:, None], label, share / share.mean(), np.array([1.0, 0.0]), ridge=0.1)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, per_class: int = FIT_DOCS) -> Field:
    """Fit on at most `per_class` labelled documents of each class outside the held-out fold, with their whole texts: a few bytes a line reach the driver."""
    sample, counts = labelled_sample(labels, label, folds, fold, per_class)

    def fn(batch):
        for t in tb.slices(batch.column(1)):
            features, length, first = line_features(t)
            bits = np.packbits(features.astype(bool), axis=1)
            spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            yield {"label": batch.column(2).slice(t.rows.start, len(t)), "features": [bits[a:b].tobytes() for a, b in spans], "length": [length[a:b].astype(np.float32).tobytes() for a, b in spans]}

    rows = arrow_map(sample_texts(docs, sample), "label int, features binary, length binary", fn).collect()
    rows = sorted((r["label"], bytes(r["features"]), bytes(r["length"])) for r in rows)
    wide = -(-WIDTH // 8)
    return fit_field([(y, np.unpackbits(np.frombuffer(f, np.uint8).reshape(-1, wide), axis=1)[:, :WIDTH].astype(np.float32), np.frombuffer(n, np.float32).astype(float)) for y, f, n in rows], counts)


def classify(docs: DataFrame, model: Field, folds: int = 4, fold: int = 2, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`, from whole texts alone.

    Lines are cut at newlines; those without a word are passed over. A text without words (null and empty ones too) gets the smoothed share of
    label 1. Null ids are not held out. Equal texts get equal scores; an empty table gives an empty result. Other columns are left out.
    """
    field = shared(docs.sparkSession, model)

    def fn(batch):
        for t in tb.slices(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(t.rows.start, len(t)), "score": field().score(t)}

    scored = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, score double", fn)
    return scored.select("doc_id", is_held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Field, limit: float = 0.7) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores `limit` or more; see `classify`. Nothing is shuffled."""
    field = shared(docs.sparkSession, model)
    return where_text(docs, lambda t: field().score(t) >= limit)
