"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can reach across (before a space that follows something else,
and around line ends); each distinct cut-out is encoded once. The distinct ones are concatenated and
indexed by a suffix array (sorted by their first 16 bytes; a longer piece is compared in full).
Every piece of the vocabulary is binary-searched for its range of occurrences, all occurrences
become edges (begin, end, piece), sorted by the distance of their end from their word's begin, and
edges are relaxed in that order.

The model is a BPE model: its result is not a best path but what its merges, best score first and
leftmost first, leave over. A sequence of pieces is that result exactly if each two neighbours are
the result of merging their own text. So the last piece of each prefix is unique, and relaxing an
edge means: keep it if its piece may follow the last piece of the prefix that it begins at. Whether
a pair may stand side by side is found by undoing the merges of both pieces, latest first, and
looking for a merge across their border that would have come earlier.

Characters outside the vocabulary become their UTF-8 byte pieces. A space goes before each text and
is taken off when decoding. Decoding gives back every text exactly, but for U+2581, which the model
cannot tell from a space.

Defined cases: null and empty texts have no pieces and decode to the empty text; other columns are
kept and those named like the results replaced; repeated rows are encoded each; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._text import chunks, give_back, span_hashes, string_bytes

SPACE = "▁"
_CACHE = 20  # bits of the table of pairs that were looked at
_MOST_PIECES = 3_000_000  # of distinct cut-outs that a task remembers
_MATCH_BYTES = 100_000  # of distinct cut-outs that are indexed together (a longer one alone)


@dataclass
class Pieces:
    """A BPE vocabulary as arrays. Pieces are UTF-8 with a space for U+2581; what a character outside the
    vocabulary becomes has the number `other`."""

    text: list[bytes]
    rank: np.ndarray  # order of merges; -1 for single characters
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # sorted left * n + right of all merges
    merged: np.ndarray  # rank of each
    usable: np.ndarray  # pieces that merging their own text gives
    byte_piece: np.ndarray  # piece of each byte
    is_byte: np.ndarray
    other: int

    @staticmethod
    def load(model_file: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        text = [model.id_to_piece(i).replace(SPACE, " ").encode() if normal[i] else b"" for i in range(n)]
        byte_piece = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        is_byte = np.zeros(n + 1, bool)
        is_byte[byte_piece] = True
        return build(text, [model.get_score(i) for i in range(n)], byte_piece, is_byte)


def build(text: list[bytes], score: list[float], byte_piece: np.ndarray, is_byte: np.ndarray) -> Pieces:
    n = len(text) + 1
    number = {x: i for i, x in enumerate(text) if x}
    places = {s: k for k, s in enumerate(sorted(set(score), reverse=True))}
    rank, left, right, usable = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    pairs: list[tuple[int, int]] = []
    for piece, i in number.items():
        chars = piece.decode()
        if len(chars) == 1:
            usable[i] = True
            continue
        rank[i] = places[score[i]]
        cuts = np.cumsum([len(c.encode()) for c in chars])[:-1].tolist()
        pairs += [(number[piece[:c]] * n + number[piece[c:]], rank[i]) for c in cuts if piece[:c] in number and piece[c:] in number]
        parts = [number.get(c.encode(), -1) for c in chars]
        while len(parts) > 1:  # the merges of the piece's own text
            best = None
            for k in range(len(parts) - 1):
                whole = number.get(text[parts[k]] + text[parts[k + 1]]) if min(parts[k], parts[k + 1]) >= 0 else None
                if whole is not None and (best is None or -score[whole] < best[0]):
                    best = (-score[whole], k, whole)
            if best is None:
                break
            _, k, whole = best
            if len(parts) == 2:
                left[i], right[i], usable[i] = parts[0], parts[1], whole == i
            parts[k : k + 2] = [whole]
    pairs.sort()
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return Pieces([*text, b""], rank, left, right, both[:, 0], both[:, 1], usable, byte_piece, is_byte, n - 1)


def may_follow(p: Pieces, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether merging the texts of the two pieces, side by side, gives just these two pieces."""
    n, ok, live = len(p.rank), np.ones(len(one), bool), np.arange(len(one))
    a, b, limit = one.astype(np.int64), two.astype(np.int64), np.full(len(one), np.iinfo(np.int64).max)
    while len(live):
        key = a * n + b
        at = np.minimum(np.searchsorted(p.pairs, key), len(p.pairs) - 1)
        crossing = (p.pairs[at] == key) & (p.merged[at] < limit)
        ok[live[crossing]] = False
        go = ~crossing & ((p.rank[a] >= 0) | (p.rank[b] >= 0))
        a, b, limit, live = a[go], b[go], limit[go], live[go]
        # Of equal merges the left one came first, so the right one is undone first.
        undo_a = p.rank[a] > p.rank[b]
        limit = np.where(undo_a, p.rank[a], p.rank[b] + 1)
        a, b = np.where(undo_a, p.right[a], a), np.where(undo_a, b, p.left[b])
    return ok


def _keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 bytes from each place on, and the 8 after those, as big-endian numbers."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    first = np.zeros(len(data) + 8, np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | padded[k : k + len(first)]
    return first[: len(data)], first[8:]


class Matcher:
    """Finds all occurrences of all pieces in a text."""

    def __init__(self, p: Pieces):
        self.p = p
        self.piece = np.flatnonzero(p.usable)
        self.size = np.array([len(p.text[i]) for i in self.piece])
        data = np.zeros((len(self.piece), 16), np.uint8)
        for k, i in enumerate(self.piece):
            data[k, : min(16, self.size[k])] = np.frombuffer(p.text[i][:16], np.uint8)
        self.low = [data[:, a : a + 8].copy().view(">u8").ravel().astype(np.uint64) for a in (0, 8)]
        for k, size in enumerate(self.size):
            data[k, min(16, size) :] = 255
        self.high = [data[:, a : a + 8].copy().view(">u8").ravel().astype(np.uint64) for a in (0, 8)]
        longer = self.size > 16
        self.nth_longer = np.where(longer, np.cumsum(longer) - 1, -1)
        self.rest = np.zeros((int(longer.sum()), max(0, int(self.size.max(initial=16)) - 16)), np.uint8)
        for k, i in enumerate(self.piece[longer]):
            self.rest[k, : len(p.text[i]) - 16] = np.frombuffer(p.text[i][16:], np.uint8)
        self.seen = np.full(1 << _CACHE, -1, np.int64)
        self.said = np.zeros(1 << _CACHE, bool)

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, number of the piece in self.piece) of every occurrence."""
        one, two = _keys(data)
        places = np.flatnonzero((data & 0xC0) != 0x80)
        order = places[np.lexsort((two[places], one[places]))]
        one, two = one[order], two[order]

        def search(key: list[np.ndarray], right: bool) -> np.ndarray:
            low, high = np.searchsorted(one, key[0]), np.searchsorted(one, key[0], "right")
            while (open_ := low < high).any():
                mid = (low + high) // 2
                value = two[np.minimum(mid, len(two) - 1)]
                up = open_ & ((value <= key[1]) if right else (value < key[1]))
                low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
            return low

        if not len(order):
            return order, order
        begin, end = search(self.low, False), search(self.high, True)
        count = end - begin
        which = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)]
        fits = at + self.size[which] <= len(data)
        long = np.flatnonzero(fits & (self.nth_longer[which] >= 0))
        if len(long):  # their bytes from the 17th on
            place = np.arange(16, 16 + self.rest.shape[1])
            same = data[np.minimum(at[long, None] + place, len(data) - 1)] == self.rest[self.nth_longer[which[long]]]
            fits[long] = (same | (place >= self.size[which[long], None])).all(1)
        return at[fits], which[fits]

    def pair_ok(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = one.astype(np.int64) << 20 | two
        slot = (key * 0x9E3779B1 >> 7) & ((1 << _CACHE) - 1)
        miss = np.flatnonzero(self.seen[slot] != key)
        out = self.said[slot]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            answer = may_follow(self.p, new >> 20, new & ((1 << 20) - 1))
            self.seen[slot[miss]], self.said[slot[miss]] = key[miss], answer[back]
            clash = self.seen[slot[miss]] != key[miss]
            self.seen[slot[miss[clash]]] = -1
            out[miss] = answer[back]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each span of data (spans don't overlap), one after another, and where spans begin. A
        character outside the vocabulary has one piece, `other`, for each of its bytes."""
        p, other = self.p, self.p.other
        word = np.zeros(len(data), np.int64)
        word[starts] = 1
        word = np.cumsum(word) - 1
        at, which = self.occurrences(data)
        end = at + self.size[which]
        inside = (word[at] == word[end - 1]) & (end <= ends[word[at]])
        at, end, piece = at[inside], end[inside], self.piece[which[inside]]
        # Characters without a piece of their own: an edge of their own, that anything may follow.
        known = np.zeros(len(data), bool)
        lead = (data & 0xC0) != 0x80
        next_lead = np.append(np.flatnonzero(lead)[1:], len(data))
        size = np.zeros(len(data), np.int64)
        size[lead] = next_lead - np.flatnonzero(lead)
        known[at[end - at == size[at]]] = True
        lost = np.flatnonzero(lead & ~known)
        if len(lost):
            at, end = np.concatenate([at, lost]), np.concatenate([end, lost + size[lost]])
            piece = np.concatenate([piece, np.full(len(lost), other)])
        level = end - starts[word[at]]
        order = np.argsort(level, kind="stable")
        at, end, piece = at[order], end[order], piece[order]
        steps = np.concatenate([[0], np.cumsum(np.bincount(level))]) if len(level) else np.zeros(1, np.int64)
        last = np.full(len(data) + 1, -1)  # the last piece of the prefix that ends before each place
        length = np.zeros(len(data) + 1, np.int64)
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            if a == b:
                continue
            begin, stop, own = at[a:b], end[a:b], piece[a:b]
            before = last[begin]
            ok = first[begin].copy()
            rest = np.flatnonzero(~ok & (before >= 0))
            ok[rest] = self.pair_ok(before[rest], own[rest])
            last[stop[ok]], length[stop[ok]] = own[ok], (stop - begin)[ok]
        place, live, steps_back = ends.copy(), np.arange(len(starts)), []
        while len(live):
            here = place[live]
            steps_back.append((live, last[here], here - length[here]))
            place[live] = here - length[here]
            live = live[place[live] > starts[live]]
        owner = np.concatenate([s[0] for s in steps_back]) if steps_back else np.zeros(0, np.int64)
        got = np.concatenate([s[1] for s in steps_back]) if steps_back else np.zeros(0, np.int64)
        where = np.concatenate([s[2] for s in steps_back]) if steps_back else np.zeros(0, np.int64)
        order = np.argsort(where, kind="stable")
        owner, got, where = owner[order], got[order], where[order]
        if len(lost):  # one byte piece for each byte
            times = np.where(got == other, size[where], 1)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            owner, got, where = np.repeat(owner, times), np.repeat(got, times), np.repeat(where, times) + nth
            got = np.where(got == other, p.byte_piece[data[where]], got)
        return got.astype(np.int32), np.searchsorted(owner, np.arange(len(starts) + 1))


class Encoder:
    """Encodes batches; remembers the cut-outs that it has seen, up to _MOST_PIECES pieces of them."""

    def __init__(self, p: Pieces):
        self.p, self.match = p, Matcher(p)
        self.forget()

    def forget(self) -> None:
        self.known, self.from_, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pooled = 0
        self.flat = np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts, and the n + 1 places where texts begin."""
        column = pc.replace_substring(pc.fill_null(column, ""), SPACE, " ")
        data, offsets = string_bytes(column)
        parts = [self._chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate([x[0] for x in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[1]) for x in parts]))])

    def _chunk(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = np.diff(offsets) > 0
        data = np.insert(raw, offsets[:-1][full], 32)
        at = offsets + np.concatenate([[0], np.cumsum(full)])
        begins = np.zeros(len(data), bool)
        space, line = data == 32, data == 10
        begins[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        begins[at[:-1][full]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        h = span_hashes(data, starts, ends)
        words, first, back = np.unique(h, return_index=True, return_inverse=True)
        if self.pooled > _MOST_PIECES:
            self.forget()
        to = np.searchsorted(self.known, words)
        new = np.ones(len(words), bool)
        inside = to < len(self.known)
        new[inside] = self.known[to[inside]] != words[inside]
        if new.any():
            one, two = starts[first[new]], ends[first[new]]
            size = two - one
            text = data[np.repeat(one - np.cumsum(size) + size, size) + np.arange(size.sum())]
            edge = np.concatenate([[0], np.cumsum(size)])
            done = [self.match.encode(text[edge[a] : edge[b]], edge[a:b] - edge[a], edge[a + 1 : b + 1] - edge[a]) for a, b in chunks(edge, _MATCH_BYTES)]
            got, n_got = np.concatenate([x[0] for x in done]), np.concatenate([np.diff(x[1]) for x in done])
            where = np.concatenate([[0], np.cumsum(n_got)])
            self.known = np.insert(self.known, to[new], words[new])
            self.from_ = np.insert(self.from_, to[new], self.pooled + where[:-1])
            self.count = np.insert(self.count, to[new], np.diff(where))
            self.pooled += len(got)
            if self.pooled > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(self.pooled - len(self.flat), 1 << 18), np.int32)])
            self.flat[self.pooled - len(got) : self.pooled] = got
            to = np.searchsorted(self.known, words)
        n, begin = self.count[to][back], self.from_[to][back]
        ids = self.flat[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[np.searchsorted(starts, at)]


class Decoder:
    def __init__(self, p: Pieces):
        text = [*p.text]
        for b, i in enumerate(p.byte_piece):
            text[i] = bytes([b])
        self.size = np.array([len(x) for x in text])
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(text), np.uint8)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of runs of pieces."""
        size = self.size[ids]
        data = self.bytes[np.repeat(self.begin[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        total = np.concatenate([[0], np.cumsum(size)])[at]
        full = np.diff(total) > 0
        data = np.delete(data, total[:-1][full])
        offsets = total - np.concatenate([[0], np.cumsum(full)])
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about CHUNK_BYTES of text each."""
    for a, b in chunks(string_bytes(batch[text])[1]):
        yield batch.slice(a, b - a)


def pieces(spark: SparkSession, model_file: str) -> Broadcast:
    """The vocabulary, read on the driver; its size is the model's, whatever the data."""
    return spark.sparkContext.broadcast(Pieces.load(model_file))


def _encoded(part: pa.RecordBatch, coder: Encoder, text: str) -> pa.ListArray:
    got, at = coder.encode(part[text])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(got))


def _decoded(ids: pa.ListArray, coder: Decoder) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
    return coder.decode(ids.flatten().to_numpy(), at).cast(pa.string())


def _with(docs: DataFrame, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in kinds.items())])


def encode_texts(docs: DataFrame, vocabulary: Broadcast, *, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """docs with one more column, the texts' pieces. No shuffle."""
    docs = docs.drop(ids)
    schema = _with(docs, **{ids: T.ArrayType(T.IntegerType())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(vocabulary.value)  # remembers cut-outs as long as the task lasts
        for batch in batches:
            for part in _slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, _encoded(part, coder, text)], schema.names)
        del coder
        give_back()

    return docs.mapInArrow(run, schema)


def decode_pieces(docs: DataFrame, vocabulary: Broadcast, *, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """docs with one more column, the texts of their pieces. No shuffle."""
    docs = docs.drop(text)
    schema = _with(docs, **{text: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Decoder(vocabulary.value)
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch[ids]), 0).to_numpy()
            for a, b in chunks(np.concatenate([[0], np.cumsum(size)])):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part[ids], coder)], schema.names)

    return docs.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, vocabulary: Broadcast, *, text: str = "text", ids: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """docs with two more columns, the texts' pieces and what they decode to, in one pass. No shuffle."""
    docs = docs.drop(ids, decoded)
    schema = _with(docs, **{ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, back = Encoder(vocabulary.value), Decoder(vocabulary.value)
        for batch in batches:
            for part in _slices(batch, text):
                column = _encoded(part, coder, text)
                yield pa.RecordBatch.from_arrays([*part.columns, column, _decoded(column, back)], schema.names)
        del coder, back
        give_back()

    return docs.mapInArrow(run, schema)
