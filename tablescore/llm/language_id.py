"""Language identification with a blended-spectrum string kernel.

A text's features are the byte n-grams (n = 1 to 3, A-Z folded) that occur in it. The kernel of two
texts is the number of n-grams that both have, divided by the geometric mean of their own counts.
Landmark texts make it finite (Nystroem): only n-grams of landmarks can be shared with one, so the
feature space is theirs, and a text's kernel row is one product with the landmarks' presence
matrix. One kernel ridge regression for each language (one against the rest) is fitted on those rows: the
functions are sums of landmark kernels and an offset, and their norm is that of the kernel's own space,
w' K w with the landmarks' kernel matrix K. With all texts as landmarks that is the dense kernel ridge
regression. A batch is scored by two matrix products.

The fit takes a bounded sample (LangParams.per_class texts a language, none over most_bytes, total_bytes in all;
`landmarks` of them a language). Scoring reads all rows and whole texts and moves none.

Defined cases: null texts and texts without a letter are `und` with score 0; null keys stay;
repeated rows are predicted each; an empty table gives no rows; no usable language gives `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ._sample import labelled_ids, labelled_texts
from ._text import chunks, string_bytes

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


@dataclass(frozen=True)
class LangParams:
    """per_class, most_bytes, total_bytes: the sample's bounds; landmarks: of each language; ridge: of the regression;
    sharpness: of the softmax that turns regression outputs into a score."""

    per_class: int = 400
    most_bytes: int = 16384
    total_bytes: int = 48_000_000
    landmarks: int = 24
    ridge: float = 1e-3
    sharpness: float = 4.0


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Number of the 1-, 2- and 3-gram that begins at each byte (0 where it would leave its text), and
    each byte's text."""
    b = _FOLD[data]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = [b + 1]
    for n in (2, 3):
        code = np.zeros(len(b), np.uint32)
        if len(b) >= n:
            inside = text[n - 1 :] == text[: len(b) - n + 1]
            grown = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                grown = grown << np.uint32(8) | b[k : len(b) - n + 1 + k]
            code[: len(grown)] = np.where(inside, grown + 1, 0)
        out.append(code)
    return out, text


@dataclass(frozen=True)
class LangModel:
    languages: list[str]
    tables: list[np.ndarray]  # for each n, the feature of each n-gram number, 0 if it is none
    landmarks: np.ndarray  # features x landmarks, presence by the root of the landmark's own count
    weight: np.ndarray  # landmarks + 1 x languages

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.landmarks) + 1), np.float32)
        codes, text = _codes(data, offsets)
        base = text * out.shape[1]
        flat = out.reshape(-1)
        for table, code in zip(self.tables, codes, strict=True):
            flat[base + table[code]] = 1
        return out[:, 1:]

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p = self.presence(data, offsets)
        k = p @ self.landmarks / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
        return np.hstack([k, np.ones((len(k), 1), np.float32)])

    def outputs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.kernel(data, offsets) @ self.weight


def fit(texts: pa.ChunkedArray, labels: np.ndarray, languages: list[str], params: LangParams = LangParams()) -> LangModel | None:
    if not len(labels):
        return None
    marks = np.concatenate([np.flatnonzero(labels == k)[: params.landmarks] for k in range(len(languages))])
    data, offsets = string_bytes(texts)
    spans = list(chunks(offsets))
    mark_data, mark_at = string_bytes(pa.chunked_array([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts]).take(pa.array(marks)))
    tables, n_features = [], 0
    for n, code in enumerate(_codes(mark_data, mark_at)[0], 1):
        seen = np.unique(code)
        table = np.zeros((1 << 8 * n) + 1, np.int16)
        table[seen[seen > 0]] = n_features + 1 + np.arange((seen > 0).sum())
        n_features += int((seen > 0).sum())
        tables.append(table)
    if n_features >= 1 << 15:
        tables = [t.astype(np.int32) for t in tables]
    model = LangModel(languages, tables, np.zeros((n_features, 0), np.float32), np.zeros(0))
    p = model.presence(mark_data, mark_at)
    model = LangModel(languages, tables, (p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))).T.copy(), np.zeros(0))
    k = np.concatenate([model.kernel(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in spans]).astype(np.float64)
    share = 1 / np.bincount(labels, minlength=len(languages))[labels]
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    own = model.kernel(mark_data, mark_at).astype(np.float64)[:, :-1]
    norm = np.zeros((k.shape[1], k.shape[1]))
    norm[:-1, :-1] = params.ridge * share.sum() * (own + own.T) / 2
    # Landmarks that repeat make the system singular; the least of its solutions is taken.
    weight = np.linalg.lstsq(k.T * share @ k + norm, k.T * share @ target, rcond=1e-10)[0]
    return LangModel(languages, tables, model.landmarks, weight.astype(np.float32))


def train(docs: DataFrame, *, usable: Column, key: str = "doc_id", text: str = "text", language: str = "lang", params: LangParams = LangParams()) -> LangModel | None:
    ids = labelled_ids(docs, key=key, label=language, usable=usable, per_class=params.per_class)
    languages = sorted(r[0] for r in ids.select("__label").distinct().collect())
    number = {x: i for i, x in enumerate(languages)}
    numbered = ids.replace({x: str(i) for x, i in number.items()}, subset=["__label"]) if languages else ids
    texts, y, _ = labelled_texts(docs, numbered.withColumn("__label", numbered["__label"].cast("long")), key=key, text=text, most_bytes=params.most_bytes, total_bytes=params.total_bytes)
    return fit(texts, y, languages, params)


def predict_language(docs: DataFrame, model: LangModel | None, *, text: str = "text", prediction: str = "lang_pred", score: str = "score", params: LangParams = LangParams()) -> DataFrame:
    """docs with the predicted language and the softmax share of its output. No shuffle. Columns of
    those names are replaced."""
    docs = docs.drop(prediction, score)
    model = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            letters = pc.fill_null(pc.match_substring_regex(batch[text], r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, share = np.array(["und"], object)[np.zeros(n, int)], np.zeros(n)
            if model.value is not None:
                data, offsets = string_bytes(batch[text])
                out = np.concatenate([model.value.outputs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, 500_000)])
                e = np.exp(params.sharpness * (out - out.max(1, keepdims=True)))
                names = np.where(letters, np.array(model.value.languages, object)[out.argmax(1)], "und")
                share = np.where(letters, e.max(1) / e.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(share, pa.float64())], [*batch.schema.names, prediction, score])

    return docs.mapInArrow(run, schema)
