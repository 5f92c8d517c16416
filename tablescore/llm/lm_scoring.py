"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of all orders up to n are mixed with weights that depend on how often
the context was seen (a bucket for each power of two). The weights come from expectation-
maximisation on counts of the deleted part: training documents whose own counts are left out while
the weights are learnt. The final counts hold the deleted part again.

Documents are put into blocks of about block_bytes of text where they lie, and blocks are written
once to the shared folder. For each order in turn a block sends its sorted distinct n-gram keys with
their counts, cut into key ranges; the task of a range adds them up and answers each block with the
counts of the others, in the order of the block's own keys, so no key travels back. Counts never meet
on the driver or in a broadcast: what is gathered grows with the corpus and is spread over all tasks,
and a task holds a block or a key range of bounded size at a time. A frequent n-gram is one key a
block, however often it occurs.

EM sees the held-out estimates in cells: tokens whose estimates of every order fall into the same
1/steps_per_octave of an octave share their exact mean (that moves a score by less than 1e-4 of it, see
the tests). Cells are added up before they meet, and a task has at most bins^order of a context bucket.

Defined cases: a null or empty text is one end token; null doc_id counts as training; repeated rows
each count and are each scored; an empty table gives no rows; a text over block_bytes is a block of
its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import free, n_blocks, pack, pack_small, ranges, stored, unpack, unpack_small
from ._text import END, START, Words, chunks, give_back, join_hash, string_bytes

REQUEST, MAIN, DELETED = 0, 1, 2
_ANSWER = "kind int, bucket int, block long, others binary, held binary, n_types long, n_tokens long, n_main long"


@dataclass(frozen=True)
class LmParams:
    """order: longest n-gram. deleted: remainder (of 7) whose training documents teach the weights.
    context_buckets: powers of two of the context's count, the last one open. em_rounds: EM steps.
    steps_per_octave, octaves: how finely, and from which probability on, EM tells held-out estimates apart.
    block_bytes, range_bytes: text of a block, and text whose keys a key range has on average."""

    order: int = 3
    deleted: int = 3
    context_buckets: int = 24
    em_rounds: int = 60
    steps_per_octave: int = 16
    octaves: int = 48
    block_bytes: int = 4_000_000
    range_bytes: int = 12_000_000


def _bits(order: int) -> int:
    return 62 if order == 1 else 54


def _blocks(most: int):
    """Packs rows (key, text, role) into rows of one block each: its number, keys, texts one after another,
    where they end, and roles."""

    def flush(held: list[tuple], number: int) -> pa.RecordBatch:
        keys = pa.concat_arrays([h[0] for h in held])
        ends = np.cumsum(np.concatenate([h[2] for h in held]))
        data = b"".join(h[1].tobytes() for h in held)
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        role = np.concatenate([h[3] for h in held]).astype(np.int8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([number]), lists, pa.array([data], pa.binary()), pa.array([ends.astype("<i8").tobytes()], pa.binary()), pa.array([role], pa.binary()), pa.array([len(data)], pa.int64())], ["block", "keys", "text", "ends", "roles", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            data, offsets = string_bytes(batch["text"])
            role = batch["role"].to_numpy()
            for a, b in chunks(offsets, most):
                if held and size + offsets[b] - offsets[a] > most:
                    yield flush(held, number)
                    number, held, size = number + 1, [], 0
                held.append((batch["key"].slice(a, b - a), data[offsets[a] : offsets[b]].copy(), np.diff(offsets[a : b + 1]), role[a:b]))
                size += int(offsets[b] - offsets[a])
        if held:
            yield flush(held, number)

    return run


class Grams:
    """The tokens of some texts as keys of their n-grams up to an order."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, order: int):
        offsets = np.concatenate([[0], ends])
        tokens, counts = [], []
        for a, b in chunks(offsets):
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out = np.full(len(words.starts) + b - a, END, np.uint64)
            out[np.arange(len(words.starts)) + words.doc_of()] = words.hashes()
            tokens.append(out)
            counts.append(np.diff(words.first) + 1)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        self.token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.texts = len(self.at) - 1
        self.order = order

    def keys(self, order: int) -> np.ndarray:
        """The key of the n-gram that ends at each token; below the last order then that of the n-gram of
        padding alone, once for each text, which is the context of a first token."""
        shift, size = np.uint64(64 - _bits(order)), len(self.token)

        def back(k: int) -> np.ndarray:
            out = np.full(size, START, np.uint64)
            out[k:] = self.token[: size - k]
            for j in range(k):  # the texts' first tokens have padding before them
                first = self.at[:-1] + j
                out[first[first < self.at[1:]]] = START
            return out

        key, pad = back(order - 1) if order > 1 else self.token, START
        for k in range(order - 2, -1, -1):
            key, pad = join_hash(key, back(k) if k else self.token), join_hash(np.array([pad]), np.array([START]))[0]
        if order < self.order:
            key = np.concatenate([key, np.full(self.texts, pad)])
        return key >> shift

    def roles(self, role: np.ndarray, order: int) -> np.ndarray:
        """The role of each of keys(order)."""
        own = np.repeat(role, np.diff(self.at))
        return np.concatenate([own, role]) if order < self.order else own


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and each key's place among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place


def _texts(row: dict, only: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, their ends and roles of a block; with `only`, those of that role."""
    data, ends, role = np.frombuffer(row["text"], np.uint8), np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["roles"], np.int8)
    if only is None:
        return data, ends, role
    size = np.diff(np.concatenate([[0], ends]))
    mine = role == only
    return data[np.repeat(mine, size)], np.cumsum(size[mine]), role[mine]


def _send(kind: int, order: int, buckets: int):
    names = ["bucket", "block", "keys", "main", "deleted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, ends, role = _texts(row)
                grams = Grams(data, ends, order)
                keys, place = _distinct(grams.keys(kind))
                roles = grams.roles(role, kind)
                main, deleted = (np.bincount(place[roles == r], minlength=len(keys)) for r in (MAIN, DELETED))
                cut = ranges(keys, buckets, _bits(kind))
                sent = [(i, row["block"], pack(keys[a:b]), pack_small(main[a:b]), pack_small(deleted[a:b])) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
                columns = zip(*sent, strict=True) if sent else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)
            give_back()

    return run


def _answer(kind: int):
    start = START >> np.uint64(64 - _bits(1))

    def answer(table: pa.Table) -> pa.Table:
        """Each block's counts of its keys in the other blocks, and for the keys that its deleted part holds
        the main counts of all."""
        bucket, blocks = table["bucket"][0].as_py(), table["block"].to_pylist()
        sent = [unpack(x.as_py()) for x in table["keys"]]
        keys, place = _distinct(np.concatenate(sent))
        counts = [np.concatenate([unpack_small(x.as_py()) for x in table[c]]) for c in ("main", "deleted")]
        main, deleted = (np.bincount(place, c, len(keys)).astype(np.int64) for c in counts)
        total, rows, done = main + deleted, [], 0
        for block, n in zip(blocks, map(len, sent), strict=True):
            mine = place[done : done + n]
            m, d = (c[done : done + n] for c in counts)
            done += n
            rows.append((kind, bucket, block, pack_small(total[mine] - m - d), pack_small(main[mine[d > 0]]) if (d > 0).any() else None, None, None, None))
        if kind == 1:
            real = keys != start
            rows.append((0, bucket, -1, None, None, int((total[real] > 0).sum()), int(total[real].sum()), int(main[real].sum())))
        give_back()
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _ANSWER.split(", ")])

    return answer


def _replies(answers: pa.Table, column: str, kind: int, size: int) -> np.ndarray:
    """The answers of one order, range after range: a count for each of the block's keys."""
    mine = answers.filter(pc.equal(answers["kind"], kind)).sort_by("bucket")
    out = np.concatenate([unpack_small(x.as_py()) for x in mine[column]]) if len(mine) else np.zeros(0, np.int64)
    if len(out) != size:
        raise ValueError(f"{len(out)} answers to {size} keys of order {kind}")
    return out


def _estimates(grams: Grams, count_of, n_tokens: int, n_types: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's context bucket, its estimates (uniform, order 1, ...; 0 where the context is unseen) and
    its own count. count_of(kind, keys, place) gives the counts of the distinct keys of an order."""
    size = len(grams.token)
    rows, seen, context, own = [np.full(size, 1 / (n_types + 1))], np.zeros(size, np.int64), None, None
    for kind in range(1, grams.order + 1):
        keys, place = _distinct(grams.keys(kind))
        count = count_of(kind, keys, place)[place]
        if kind == 1:
            own = count[:size]
            rows.append(own / max(n_tokens, 1))
        else:
            seen = context
            rows.append(count[:size] / np.maximum(seen, 1))
        # The context of a token is the n-gram that ends at the one before, or padding alone.
        context = np.concatenate([[0], count[: size - 1]]) if size else count[:0]
        if kind < grams.order:
            context[grams.at[:-1]] = count[size:]
    return np.minimum(np.log2(seen + 1).astype(np.int64) + (seen > 0), buckets - 1), np.array(rows), own


def _expectation_maximisation(n: np.ndarray, p: np.ndarray, rounds: int) -> np.ndarray:
    """Mixture weights of a context bucket: n tokens have the estimates p. The uniform part never falls below
    1e-6, so that no token is impossible."""
    w = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = p * w
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        w = share.sum(0) / n.sum()
    w = np.maximum(w, [1e-6] + [0] * (len(w) - 1))
    return w / w.sum()


def score_documents(docs: DataFrame, *, text: str, key: str, held_out: Column, part: Column, params: LmParams = LmParams(), buckets: int | None = None) -> DataFrame:
    """Scores every row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out rows teach nothing; `part` (0-6) says which training rows are the deleted part."""
    spark, order = docs.sparkSession, params.order
    role = F.when(held_out, REQUEST).when(part == params.deleted, DELETED).otherwise(MAIN).cast("int")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), role.alias("role"))
    kind = docs.select(key).schema[0].dataType.simpleString()
    blocks = stored(rows.mapInArrow(_blocks(params.block_bytes), f"block long, keys array<{kind}>, text binary, ends binary, roles binary, bytes long"), group_rows=1)
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = buckets or max(n_blocks(spark), -(-size // params.range_bytes))
    answers = None
    for k in range(1, order + 1):
        sent = blocks.select("block", "text", "ends", "roles").mapInArrow(_send(k, order, buckets), "bucket int, block long, keys binary, main binary, deleted binary")
        own = stored(sent.groupBy("bucket").applyInArrow(_answer(k), _ANSWER))
        answers = own if answers is None else answers.unionByName(own)
    total = answers.filter("kind = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_types", "n_tokens", "n_main"))).first()
    parts, steps, bins = params.context_buckets, params.steps_per_octave, params.steps_per_octave * params.octaves + 2

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, ends, role = _texts(row, DELETED)
                if len(ends):
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([data.tobytes()], pa.binary()), pa.array([ends.astype("<i8").tobytes()], pa.binary())], ["block", "text", "ends"])

    def learn(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["cell", "n", *(f"p{k}" for k in range(1, order + 1))]
        cells, sums = np.zeros(0, np.int64), np.zeros((order + 1, 0))
        for row in docs.to_pylist():
            grams = Grams(np.frombuffer(row["text"], np.uint8), np.frombuffer(row["ends"], "<i8"), order)
            b, p, _ = _estimates(grams, lambda k, keys, place: _replies(answers, "held", k, len(keys)), total.n_main, total.n_types, parts)
            cell = b
            for x in p[1:]:
                with np.errstate(divide="ignore"):
                    cell = cell * bins + np.where(x > 0, 1 + np.minimum(-steps * np.log2(np.maximum(x, 2.0**-99)), bins - 2).astype(np.int64), 0)
            cells, place = np.unique(cell, return_inverse=True)
            sums = np.array([np.bincount(place, x, len(cells)) for x in (np.ones(len(b)), *p[1:])])
        give_back()
        return pa.table([pa.array(cells), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names)

    def weigh(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy().astype(float)
        p = np.stack([np.full(len(n), 1 / (total.n_types + 1)), *(table[f"p{k}"].to_numpy() / n for k in range(1, order + 1))], 1)
        w = _expectation_maximisation(n, p, params.em_rounds)
        return pa.table({"b": table["b"][:1], "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    replies = answers.filter("kind > 0")
    held = blocks.select("block", "text", "ends", "roles").mapInArrow(deleted, "block long, text binary, ends binary")
    sums = [f"p{k}" for k in range(1, order + 1)]
    seen = held.groupBy("block").cogroup(replies.filter("held is not null").select("block", "kind", "bucket", "held").groupBy("block")).applyInArrow(learn, "cell long, n long, " + ", ".join(f"{c} double" for c in sums))
    cells = stored(seen.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums)))
    learnt = {r.b: r.w for r in cells.withColumn("b", F.expr(f"cast(cell div {bins**order} as int)")).groupBy("b").applyInArrow(weigh, "b int, w array<double>").collect()}
    free(cells)
    # A bucket without held-out tokens takes the nearest lower one's weights.
    weights = np.full((parts, order + 1), 1 / (order + 1))
    for b in range(parts):
        weights[b] = learnt.get(b, weights[max(b - 1, 0)])

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in docs.drop_columns(["keys"]).to_pylist():
            data, ends, role = _texts(row)
            grams = Grams(data, ends, order)

            def count(k: int, keys: np.ndarray, place: np.ndarray, grams=grams, role=role) -> np.ndarray:
                return _replies(answers, "others", k, len(keys)) + np.bincount(place[grams.roles(role, k) != REQUEST], minlength=len(keys))

            b, p, own = _estimates(grams, count, total.n_tokens, total.n_types, parts)
            mixed = np.zeros(len(b))
            for k in range(order + 1):
                mixed += weights[b, k] * p[k]
            each = [np.ones(len(b)), own > 0, np.log10((own + 1) / (total.n_tokens + total.n_types + 1)), np.log10(mixed)]
            sums = [np.add.reduceat(x.astype(float), grams.at[:-1]) for x in each]
            out.append((role == REQUEST, sums[0].astype(np.int64), sums[1].astype(np.int64), np.full(len(ends), total.n_tokens), sums[2], sums[3]))
        give_back()
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * 6
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        keys = docs["keys"].combine_chunks().flatten()
        return pa.table([keys, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = blocks.select("block", "keys", "text", "ends", "roles").groupBy("block").cogroup(replies.select("block", "kind", "bucket", "others").groupBy("block"))
    return both.applyInArrow(score, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
