"""Alignments themselves, for looking into a score: which row, and which cell, was held against which.

Batched like the score: problems of equal shape go through each step of the dynamic programming at
once, and so do their ways back. A way back costs a byte for each place of its matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ScoringParams
from ..functions.align import grid_problem
from .score import in_parts, row_matrices, row_scores

_DIAGONAL, _UP, _LEFT, _NONE = 0, 1, 2, 3
#: Places of matrices whose ways back are kept together.
_PLACES = 16_000_000


def ways(score: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and moves (steps x problems, filled up with _NONE behind) of the best alignments with free end gaps;
    score is m x n x (problems). Leading gaps are moves, trailing ones are not."""
    m, n, k = score.shape
    gap, s = np.float32(gap), np.zeros((m + 1, n + 1, k), np.float32)
    came = np.full((m + 1, n + 1, k), _LEFT, np.int8)
    came[1:, 0] = _UP
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            options = np.stack([s[i - 1, j - 1] + score[i - 1, j - 1], s[i - 1, j] + gap, s[i, j - 1] + gap])
            came[i, j] = options.argmax(0)  # the first of equals
            s[i, j] = options.max(0)
    problem = np.arange(k)
    i, j, best = np.full(k, m), np.full(k, n), s[m, n].copy()
    for line, rows in ((s[:, n], True), (s[m], False)):
        top, at = line.max(0), line.argmax(0)
        better = top > best
        i, j, best = np.where(better, at if rows else m, i), np.where(better, n if rows else at, j), np.where(better, top, best)
    back = np.full((m + n, k), _NONE, np.int8)
    for step in range(m + n):
        way = np.where((i > 0) | (j > 0), came[i, j, problem], _NONE)
        back[step] = way
        i, j = i - ((way == _DIAGONAL) | (way == _UP)), j - ((way == _DIAGONAL) | (way == _LEFT))
    length = (back != _NONE).sum(0)
    forward = length[None] - 1 - np.arange(m + n)[:, None]
    return best, np.where(forward >= 0, np.take_along_axis(back, np.maximum(forward, 0), 0), _NONE)


def _steps(moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all moves, problem by problem: the problem, the place in it, and the members of both sides, -1 for a gap."""
    moves = moves.T
    problem, place = np.nonzero(moves != _NONE)
    sides = []
    for gap in (_LEFT, _UP):
        there = (moves != _NONE) & (moves != gap)
        sides.append(np.where(there, np.cumsum(there, 1) - 1, -1)[problem, place])
    return problem, place, *sides


def _in_groups(score: np.ndarray, gap: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, scores and moves of problems of equal shape, so many at once that their ways back fit."""
    step = max(1, _PLACES // ((score.shape[0] + 1) * (score.shape[1] + 1)))
    for a in range(0, score.shape[2], step):
        best, moves = ways(score[:, :, a : a + step], gap)
        yield np.arange(a, a + len(best)), best, moves


def _ready(pairs: DataFrame, truth: str, prediction: str, new: list[T.StructField]) -> tuple[DataFrame, T.StructType, list[str]]:
    """The pairs that can be scored, and the fields of the result: the other columns and the new ones."""
    names = [f.name for f in new]
    rest = [f for f in pairs.schema.fields if f.name not in (truth, prediction, *names)]
    ready = pairs.filter(grid_problem(F.col(truth), F.col(prediction)).isNull()).select(*(f.name for f in rest), F.col(truth).alias("__a"), F.col(prediction).alias("__b"))
    return ready, T.StructType([*rest, *new]), [f.name for f in rest]


def align_cells(pairs: DataFrame, truth: str = "truth", prediction: str = "prediction", params: ScoringParams = ScoringParams()) -> DataFrame:
    """One row (truth_row, prediction_row, score, truth_cells, prediction_cells) for every pair of rows of every pair
    of grids, beside the other columns: the two rows' aligned cells, normalised, null for a gap. Pairs of grids
    without a score have none. No shuffle."""
    cells = T.ArrayType(T.StringType())
    new = [T.StructField("truth_row", T.IntegerType()), T.StructField("prediction_row", T.IntegerType()), T.StructField("score", T.FloatType()), T.StructField("truth_cells", cells), T.StructField("prediction_cells", cells)]
    ready, schema, rest = _ready(pairs, truth, prediction, new)

    def part(batch: pa.RecordBatch, a, b, m, n, some, words) -> pa.RecordBatch:
        held: list[tuple[np.ndarray, ...]] = []

        def aligned(own: np.ndarray, x: np.ndarray, y: np.ndarray, cell: np.ndarray) -> np.ndarray:
            out = np.zeros(len(own), np.float32)
            for which, best, moves in _in_groups(cell, params.column_gap):
                out[which] = best
                problem, _, left, right = _steps(moves)
                code = [np.where(side >= 0, codes[np.maximum(side, 0), which[problem]], -1) if codes.size else np.full(len(side), -1) for side, codes in ((left, x), (right, y))]
                held.append((np.repeat(own[which], np.bincount(problem, minlength=len(which))), *code))
            return out

        at, scores = row_scores(a, b, m, n, some, words, params, aligned)
        pair = np.arange(at[-1])
        table = np.repeat(np.arange(len(some)), m * n)
        own, left, right = (np.concatenate(h) for h in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
        order = np.argsort(own, kind="stable")
        lists = np.searchsorted(own[order], np.append(pair, at[-1])).astype(np.int32)
        told = pa.array(words, pa.string())
        columns = [pa.ListArray.from_arrays(pa.array(lists), told.take(pa.array(side[order], mask=side[order] < 0))) for side in (left, right)]
        nth = pair - at[table]
        where = pa.array(some[table])
        return pa.RecordBatch.from_arrays([*(batch[c].take(where) for c in rest), pa.array((nth // n[table]).astype(np.int32)), pa.array((nth % n[table]).astype(np.int32)), pa.array(scores - np.float32(params.row_match)), *columns], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in in_parts(batch["__a"], batch["__b"]):
                yield part(batch, *some)

    return ready.mapInArrow(run, schema)


def align_rows(pairs: DataFrame, truth: str = "truth", prediction: str = "prediction", params: ScoringParams = ScoringParams()) -> DataFrame:
    """One row (place, truth_row, prediction_row) for each step of each alignment, beside the other columns: the
    rows held against each other, null for a gap. Pairs of grids without a score have none. No shuffle."""
    new = [T.StructField(n, T.IntegerType()) for n in ("place", "truth_row", "prediction_row")]
    ready, schema, rest = _ready(pairs, truth, prediction, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, m, n, some, words in in_parts(batch["__a"], batch["__b"]):
                at, scores = row_scores(a, b, m, n, some, words, params)
                for own, matrix in row_matrices(at, scores, m, n):
                    for which, _, moves in _in_groups(matrix, params.row_gap):
                        problem, place, left, right = _steps(moves)
                        where = pa.array(some[own[which[problem]]])
                        columns = [pa.array(place.astype(np.int32)), *(pa.array(x.astype(np.int32), mask=x < 0) for x in (left, right))]
                        yield pa.RecordBatch.from_arrays([*(batch[c].take(where) for c in rest), *columns], schema.names)

    return ready.mapInArrow(run, schema)
