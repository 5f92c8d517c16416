"""Document quality from a linear-chain conditional random field over lines.

Each line that isn't blank is good or bad. Its features are counts over its bytes and words, and
those of the lines before and after; neighbouring states are tied by learnt transition weights.
Forward-backward gives every line's probability of being good, and a document's score is their
mean, weighted by line length.

Lines have no labels of their own: each takes its document's. The field is fitted by gradient
ascent on the conditional likelihood over a bounded sample (CrfParams.per_class documents a class,
none over most_bytes, total_bytes in all); scoring reads all rows and whole texts and moves none.

Defined cases: a null, empty or blank text is one empty line, scored like any line; null keys stay;
repeated rows are scored each; an empty table gives no rows; no usable labels give 0.5 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ._sample import labelled_ids, labelled_texts
from ._text import Words, chunks, string_bytes


@dataclass(frozen=True)
class CrfParams:
    """The sample's bounds; ridge and steps of the fit; the score from which a text is predicted good."""

    per_class: int = 2500
    most_bytes: int = 65536
    total_bytes: int = 48_000_000
    steps: int = 150
    rate: float = 0.1
    ridge: float = 1e-3
    threshold: float = 0.3


def _is(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_CLASSES = [_is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("0123456789"), _is(" \t"), _is(".,;:'\"?-()"), _is("|"), _is("!"), _is("#$%&*@^~+=<>{}[]\\/_`")]
OWN = len(_CLASSES) + 7
N_FEATURES = 1 + 3 * OWN + 2


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines that aren't blank (a text without any has one empty line), their lengths
    in bytes, and the n + 1 places where texts' lines begin."""
    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]))  # an empty text's begin stays, as its one line
    text_of = np.searchsorted(offsets[1:], begins, "right")
    own_begin = np.concatenate([[True], begins[1:] != begins[:-1]]) if len(begins) else np.zeros(0, bool)
    # A line break that ends a text begins nothing: its place is the next text's first byte.
    keep = own_begin & (begins < len(data))
    begins, text_of = begins[keep], text_of[keep]
    ends = np.minimum(np.append(begins[1:], len(data)), offsets[1:][text_of]) if len(begins) else begins
    words = Words(data, offsets)
    first = np.searchsorted(words.starts, np.append(begins, len(data)))
    n_words = np.diff(first)
    full = n_words > 0
    blank = np.setdiff1d(np.arange(len(offsets) - 1), text_of[full])
    begins, ends, text_of, n_words = begins[full], ends[full], text_of[full], n_words[full]
    length = ends - begins
    own = np.zeros((len(begins), OWN), np.float32)
    for k, kind in enumerate(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32)])
        own[:, k] = (sums[ends] - sums[begins]) / np.maximum(length, 1)
    k = len(_CLASSES)
    h, line = words.hashes(), np.repeat(np.arange(len(begins)), n_words)
    size = words.ends - words.starts
    if len(h):
        at = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        again = np.zeros(len(h), np.float32)
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        order = np.lexsort((h, line))
        new = np.ones(len(h), np.float32)
        new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        own[:, k] = np.log1p(length)
        own[:, k + 1] = np.log1p(n_words)
        own[:, k + 2] = np.add.reduceat(size, at) / n_words
        own[:, k + 3] = np.add.reduceat(again, at) / n_words
        own[:, k + 4] = np.add.reduceat(new, at) / n_words
        own[:, k + 5] = np.add.reduceat((size <= 3).astype(np.float32), at) / n_words
        own[:, k + 6] = np.add.reduceat(np.minimum(size, 40) ** 2, at) / n_words / 100
    if len(blank):
        own = np.concatenate([own, np.zeros((len(blank), OWN), np.float32)])
        length, text_of = np.concatenate([length, np.zeros(len(blank), np.int64)]), np.concatenate([text_of, blank])
        order = np.argsort(text_of, kind="stable")
        own, length, text_of = own[order], length[order], text_of[order]
    x = np.zeros((len(own), N_FEATURES), np.float32)
    x[:, 0], x[:, 1 : 1 + OWN] = 1, own
    if len(own):
        joined = np.append(text_of[1:] == text_of[:-1], False)
        x[:-1, 1 + OWN : 1 + 2 * OWN] = own[1:] * joined[:-1, None]
        x[1:, 1 + 2 * OWN : 1 + 3 * OWN] = own[:-1] * joined[:-1, None]
        x[:, -2] = ~joined
        x[1:, -1] = ~joined[:-1]
        x[0, -1] = 1
    return x, length, np.searchsorted(text_of, np.arange(len(offsets)))


def marginals(score: np.ndarray, at: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of being good, and the expected counts of the four transitions in each text.
    score: a good line's log-odds; at: where texts' lines begin; tie: 2 x 2 log-weights."""
    count = np.diff(at)
    order = np.argsort(-count, kind="stable")
    begins, lines = at[:-1][order], count[order]
    most = int(lines[0]) if len(lines) else 0
    odds, t = np.exp(np.clip(score, -30, 30)), np.exp(tie)
    fore, back = np.zeros((len(score), 2)), np.ones((len(score), 2))
    active = [int(np.searchsorted(-lines, -k, "left")) for k in range(most)]  # texts of more than k lines
    for k in range(most):
        i = begins[: active[k]] + k
        a = np.ones((len(i), 2)) if k == 0 else fore[i - 1] @ t
        a[:, 1] *= odds[i]
        fore[i] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((len(count), 2, 2))
    for k in range(most - 2, -1, -1):
        n = active[k + 1]
        i = begins[:n] + k
        onward = back[i + 1].copy()
        onward[:, 1] *= odds[i + 1]
        joint = fore[i][:, :, None] * t * onward[:, None, :]
        pairs[order[:n]] += joint / joint.sum((1, 2), keepdims=True)
        b = onward @ t.T
        back[i] = b / b.sum(1, keepdims=True)
    both = fore * back
    return both[:, 1] / both.sum(1), pairs


@dataclass(frozen=True)
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    tie: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, length, at = line_features(data, offsets)
        good, _ = marginals(((x - self.mean) / self.scale) @ self.weight, at, self.tie)
        size = length + 1.0
        return np.clip(np.add.reduceat(good * size, at[:-1]) / np.add.reduceat(size, at[:-1]), 0, 1)


def fit(texts: pa.ChunkedArray, labels: np.ndarray, params: CrfParams = CrfParams()) -> Crf:
    """The field that maximises the mean log-likelihood a line of the documents' labels, by Adam."""
    flat = Crf(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)))
    if not len(labels):
        return flat
    data, offsets = string_bytes(texts)
    parts = [line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    x = np.concatenate([p[0] for p in parts]).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale < 1e-9] = 0, 1
    x = (x - mean) / scale
    n = np.diff(at)
    # Each text counts alike, however many lines it has, and so does each class.
    text_weight = 1 / np.array([max((labels == y).sum(), 1) for y in (0, 1)])[labels]
    line_weight = np.repeat(text_weight / n, n)
    target = np.repeat(labels, n).astype(float)
    theta, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    observed = np.zeros((len(n), 2, 2))
    observed[np.arange(len(n)), labels, labels] = n - 1
    for step in range(1, params.steps + 1):
        good, pairs = marginals(x @ theta[:N_FEATURES], at, theta[N_FEATURES:].reshape(2, 2))
        slope = np.concatenate([x.T @ ((target - good) * line_weight), ((observed - pairs) * (text_weight / n)[:, None, None]).sum(0).ravel()]) - params.ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += params.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(mean, scale, theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, *, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", params: CrfParams = CrfParams()) -> Crf:
    ids = labelled_ids(labels, key=key, label=label, usable=usable, per_class=params.per_class)
    texts, y, _ = labelled_texts(docs, ids, key=key, text=text, most_bytes=params.most_bytes, total_bytes=params.total_bytes)
    return fit(texts, (y > 0).astype(np.int64), params)


def score_quality(docs: DataFrame, model: Crf, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with one more column: the probability, by length, that its lines are good. No shuffle.
    A column of that name is replaced."""
    docs = docs.drop(score)
    model = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch[text])
            out = [model.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, score])

    return docs.mapInArrow(run, schema)
