"""Toxicity by multiple-instance learning.

A text is a bag of sentences (split at . ! ? and line ends; a sentence that a text repeats counts
once). A sentence's log-odds are a bias and the weights of its words and of their beginnings; a text
is toxic unless none of its sentences is (noisy-or):

    P(toxic) = 1 - prod over sentences of (1 - p)

Only texts have labels. The weights maximise the likelihood of those, so the blame falls on the
sentences that toxic texts have and others don't, and the same weights then locate them.

Words are runs of letters, digits and non-ASCII bytes, A-Z folded; they and their first 4 to 7 bytes
are hashed to 2^20 weights. A weight is fitted, and is never negative, for what at least
MilParams.least_texts toxic texts of the sample hold and is MilParams.least_lift times as common in
them as in others. The sample is bounded (per_class texts a class, none over most_bytes, total_bytes in all); scoring
reads all rows and whole texts and moves none.

Defined cases: a text without words (null, empty) has one sentence without words; null keys stay;
repeated rows are scored each; an empty table gives no rows; no usable labels give 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ._sample import labelled_ids, labelled_texts
from ._text import NOT_ALNUM, Words, chunks, mix, string_bytes

_BITS = 20
_PREFIXES = (4, 5, 6, 7)
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


@dataclass(frozen=True)
class MilParams:
    """The sample's bounds; the fit's steps, rate and penalties; the score from which a text is
    predicted toxic, and the probability from which a sentence is named."""

    per_class: int = 4000
    most_bytes: int = 65536
    total_bytes: int = 48_000_000
    least_texts: int = 3
    least_lift: float = 6.0
    steps: int = 150
    rate: float = 0.15
    lasso: float = 2e-5
    threshold: float = 0.3
    sentence_threshold: float = 0.5


class Bag:
    """The sentences of a batch of texts, with the weight slots of their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, NOT_ALNUM)
        hashes = words.hashes(*_PREFIXES)
        self.slot = (np.stack(hashes, 1) >> np.uint64(64 - _BITS)).astype(np.int32)
        text = words.doc_of()
        ends = np.cumsum(_ENDS[data], dtype=np.int32)
        mark = ends[words.starts] if len(data) else np.zeros(0, np.int32)
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
        self.sentence = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        with np.errstate(over="ignore"):
            whole = np.add.reduceat(mix(hashes[0]), first) if len(first) else np.zeros(0, np.uint64)
        self.begin, self.end = words.starts[first], words.ends[np.append(first[1:], len(mark)) - 1] if len(first) else first
        self.text = text[first]
        self.counts = np.zeros(len(first), bool)
        self.counts[np.unique(whole ^ mix(self.text.astype(np.uint64)), return_index=True)[1]] = True
        bare = np.setdiff1d(np.arange(len(offsets) - 1), self.text)
        if len(bare):  # sentences are numbered anew, in order of text
            both = np.concatenate([self.text, bare])
            order = np.argsort(both, kind="stable")
            place = np.empty(len(both), np.int64)
            place[order] = np.arange(len(both))
            self.sentence = place[self.sentence]
            self.counts = np.append(self.counts, np.ones(len(bare), bool))[order]
            zero = offsets[bare]
            self.text, self.begin, self.end = both[order], np.concatenate([self.begin, zero])[order], np.concatenate([self.end, zero])[order]
        self.begin, self.end = self.begin - offsets[self.text], self.end - offsets[self.text]
        self.at = np.searchsorted(self.text, np.arange(len(offsets)))
        self.word_text = text

    def log_odds(self, weight: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.sentence, weight[self.slot].sum(1), len(self.text))

    def text_score(self, odds: np.ndarray) -> np.ndarray:
        return -np.expm1(-np.add.reduceat(np.logaddexp(0, odds) * self.counts, self.at[:-1]))


@dataclass(frozen=True)
class Mil:
    weight: np.ndarray
    bias: float


def fit(texts: pa.ChunkedArray, labels: np.ndarray, row_weight: np.ndarray, params: MilParams = MilParams()) -> Mil:
    """Adam with a proximal lasso step on the noisy-or likelihood of the texts' labels."""
    none = Mil(np.zeros(1 << _BITS, np.float32), -40.0)
    if not len(labels) or not (labels > 0).any():
        return none
    data, offsets = string_bytes(texts)
    bags = [Bag(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    n_sentences = np.cumsum([0] + [len(b.text) for b in bags])
    n_texts = np.cumsum([0] + [len(b.at) - 1 for b in bags])
    at = np.append(np.concatenate([b.at[:-1] + n for b, n in zip(bags, n_sentences, strict=False)]), n_sentences[-1])
    counts = np.concatenate([b.counts for b in bags])
    # In how many toxic texts, and in what weight of other texts, each slot occurs.
    toxic, other = np.zeros(1 << _BITS), np.zeros(1 << _BITS)
    for bag, a, b in zip(bags, n_texts, n_texts[1:], strict=False):
        pair = np.unique(bag.slot.ravel().astype(np.int64) * (b - a) + np.repeat(bag.word_text, bag.slot.shape[1]))
        slot, row = pair // (b - a), a + pair % (b - a)
        toxic += np.bincount(slot, labels[row] > 0, 1 << _BITS)
        other += np.bincount(slot, labels[row] <= 0, 1 << _BITS)
    n_toxic = (labels > 0).sum()
    lift = (toxic / n_toxic) / ((other + 0.5) / (len(labels) - n_toxic + 0.5))
    used = np.flatnonzero((toxic >= params.least_texts) & (lift >= params.least_lift))
    number = np.full(1 << _BITS, -1)
    number[used] = np.arange(len(used))
    words, sentences = [], []
    for bag, n in zip(bags, n_sentences, strict=False):
        w = number[bag.slot]
        hit = np.nonzero(w >= 0)
        words.append(w[hit])
        sentences.append(bag.sentence[hit[0]] + n)
    word, sentence = np.concatenate(words), np.concatenate(sentences)
    y, share = labels > 0, row_weight / row_weight.sum()
    text_of = np.repeat(np.arange(len(labels)), np.diff(at))
    theta, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    theta[-1] = -7.0
    for step in range(1, params.steps + 1):
        odds = theta[-1] + np.bincount(sentence, theta[word], n_sentences[-1])
        p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        miss = np.exp(-np.add.reduceat(np.logaddexp(0, odds) * counts, at[:-1]))  # no sentence is toxic
        pull = np.where(y, miss / np.maximum(1 - miss, 1e-9), -1.0) * share
        each = pull[text_of] * p * counts
        slope = np.append(np.bincount(word, each[sentence], len(used)), each.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        pace = params.rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        theta += pace * m / (1 - 0.9**step)
        theta[:-1] = np.maximum(theta[:-1] - (pace * params.lasso)[:-1], 0)
    weight = np.zeros(1 << _BITS, np.float32)
    weight[used] = theta[:-1]
    return Mil(weight, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, *, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", params: MilParams = MilParams()) -> Mil:
    ids = labelled_ids(labels, key=key, label=label, usable=usable, per_class=params.per_class)
    texts, y, weight = labelled_texts(docs, ids, key=key, text=text, most_bytes=params.most_bytes, total_bytes=params.total_bytes)
    return fit(texts, y, weight, params)


def score_toxicity(docs: DataFrame, model: Mil, *, text: str = "text", score: str = "score", spans: str = "toxic_sentences", params: MilParams = MilParams()) -> DataFrame:
    """docs with the text's score and its offending sentences: array of (begin, end) byte places and
    probability. No shuffle. Columns of those names are replaced."""
    docs = docs.drop(score, spans)
    model = docs.sparkSession.sparkContext.broadcast(model)
    found = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(spans, found)])
    limit = np.log(params.sentence_threshold / (1 - params.sentence_threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = string_bytes(batch[text])
            scores, counts, parts = [], [], []
            for a, b in chunks(offsets):
                bag = Bag(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                odds = bag.log_odds(model.value.weight, model.value.bias)
                scores.append(bag.text_score(odds))
                hit = np.flatnonzero(odds >= limit)
                counts.append(np.bincount(bag.text[hit], minlength=b - a))
                parts.append((bag.begin[hit], bag.end[hit], 1 / (1 + np.exp(-odds[hit]))))
            begin, end, p = (np.concatenate([x[i] for x in parts]) for i in range(3))
            lists = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(p)], ["begin", "end", "probability"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores)), pa.ListArray.from_arrays(pa.array(lists), struct)], [*batch.schema.names, score, spans])

    return docs.mapInArrow(run, schema)
