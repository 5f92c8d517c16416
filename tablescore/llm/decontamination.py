"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A window at each word of each text is compared with the windows at all words (anchors) of every
benchmark item, so that a copy is found by any stretch that its edits have left alone, wherever in the
item. The CGK random walk reads a string of symbols with a pointer that advances or stays by a random
bit of (step, symbol); step by step the symbols under the pointer are the embedding. There are walks
over words (runs of letters, digits and non-ASCII bytes, A-Z folded), which bear changes within the
words that they don't sample, and walks over characters, since in a copy with many typos hardly a word is whole.

Bit sampling: a table samples a few steps of the embedding, and a window is a candidate for an item
if it agrees with an anchor on all of them. Independent walks repeat this until recall is high. Keys of
walks that hardly moved say little and are not kept.

Two windows of an item that agree with the text, `apart` bytes or more from each other, make a candidate; one does for
an item of under `alone` bytes. Where there are many candidates, a bound that never rejects a copy comes first:
distances of the item's blocks of 64 characters. The rest are verified exactly: the edit distance in characters
between the item and the best substring around the window, both in lower case with single spaces between words,
must be at most `max_edits` of the item's length. So nothing but real matches is reported. What is searched reaches
as far beyond the window as the edits may, and `slack` words more, since the walk may have drifted.

The windows of a text walk together. Characters are 32 kinds, and a look-up in a table of all triples of
kinds takes three steps of a walk at once. No text is moved. Items go to the executors in blocks of
items_per_block, so what is broadcast is bounded; every block is compared with all rows.

Words end at ASCII other than letters and digits and at general and CJK punctuation; a character from
U+3000 on is a word of its own, so scripts without spaces have a window at each character.

Short items have few windows, so an item of up to SHORT characters is also looked up by pieces, one more than
it may have edits: a copy holds one of them unchanged, so none is missed. That costs time for each such item.

Defined cases: null or empty texts and items match nothing; an item shorter than MIN_WORDS words is also
found by any two neighbouring words of it (by its word, if it has one); equal items are each reported;
repeated rows are each searched; a null key is reported as null; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._exchange import stored
from ._text import CHUNK_BYTES, NOT_ALNUM, chunks, give_back, join_hash, mix, powers, string_bytes

WORD_STEPS, CHAR_STEPS = 10, 24
MIN_REACH = 4, 10
MIN_WORDS = 8
SHORT = 64  # characters up to which an item is found exactly, by one of its pieces
_TOGETHER = 3  # steps of a character walk that one look-up takes
_WINDOWS = 16384  # windows that walk together
_MANY = 64  # candidates of a batch from which the bound comes first
_AT_ONCE = 20_000  # candidates that are verified together
_BASE = 0x1E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 32 kinds of bytes: the end of a text, letters, the space, digits, bytes beyond ASCII.
_KIND = np.array([b - 96 if 97 <= b <= 122 else 27 if b == 0x20 else 28 + b % 2 if 48 <= b <= 57 else 30 + b % 2 if b >= 128 else 0 for b in range(256)])


@dataclass(frozen=True)
class CgkParams:
    """max_edits: most edits, as a share of the item's characters. walks, char_walks: independent random walks
    over words and over characters. sampled, sampled_chars: steps that a table samples. apart: bytes between two agreeing
    windows of an item that make a candidate; alone: size in bytes below which an item needs one. slack: words that a
    walk may drift, which verification adds to the edits on both sides. chars_per_block: characters of a block's items, about."""

    max_edits: float = 0.2
    walks: int = 3
    char_walks: int = 9
    sampled: int = 4
    sampled_chars: int = 15
    apart: int = 16
    alone: int = 130
    slack: int = 6
    items_per_block: int = 20000
    chars_per_block: int = 2_000_000
    seed: int = 11


def _chosen(draw: np.random.Generator, steps: int, sampled: int) -> set[int]:
    return set(draw.choice(steps, sampled, replace=False).tolist())


@lru_cache(maxsize=2)
def char_walks(params: CgkParams) -> list[list[np.ndarray]]:
    """For each walk over characters its look-up tables. A table is for _TOGETHER steps: for each triple of kinds
    (0 is never left) the sampled ones of the embedding, and in the lowest two bits how far the pointer goes."""
    draw, code = np.random.default_rng(params.seed + 1), np.arange(32**_TOGETHER)
    kinds = np.stack([code >> 5 * (_TOGETHER - 1 - k) & 31 for k in range(_TOGETHER)])
    out = []
    for _ in range(params.char_walks):
        chosen, tables = _chosen(draw, CHAR_STEPS, params.sampled_chars), []
        coins = draw.integers(0, 2, (CHAR_STEPS, 32))
        coins[:, 0] = 0
        for first in range(0, CHAR_STEPS, _TOGETHER):
            at, seen = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
            for step in range(first, first + _TOGETHER):
                now = kinds[at, np.arange(len(code))]
                if step in chosen:
                    seen = seen << 5 | now
                at += coins[step][now]
            tables.append(seen << 2 | at)
        out.append(tables)
    return out


def _together(codes: np.ndarray, begins: np.ndarray, step) -> tuple[np.ndarray, np.ndarray]:
    """Windows at `begins` walk in groups that fit a processor's cache. step(key, place, take) makes the steps of a group.
    Returns keys, and where the pointers got."""
    keys, at = np.zeros(len(begins), np.int64), begins.astype(np.intp)
    spare = [np.empty(min(_WINDOWS, len(begins)), np.int64) for _ in range(3)]
    for a in range(0, len(begins), _WINDOWS):
        key, place = keys[a : a + _WINDOWS], at[a : a + _WINDOWS]
        step(key, place, *(x[: len(key)] for x in spare))
    return keys, at


def walk_chars(codes: np.ndarray, begins: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    def steps(key, place, code, seen, move):
        for table in tables:
            codes.take(place, out=code, mode="clip")
            table.take(code, out=seen, mode="clip")
            np.bitwise_and(seen, 3, out=move)
            place += move
            seen >>= 2
            key *= _BASE
            key += seen

    return _together(codes, begins, steps)


def walk_words(symbols: np.ndarray, begins: np.ndarray, chosen: set[int], coins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """coins: for each step 256 random bits, one of which a symbol's lowest byte picks. Symbol 0 is never left."""

    def steps(key, place, now, low, move):
        for step, coin in enumerate(coins):
            symbols.take(place, out=now, mode="clip")
            np.bitwise_and(now, 255, out=low)
            coin.take(low, out=move, mode="clip")
            place += move
            if step in chosen:
                key *= _BASE
                key += now

    return _together(symbols, begins, steps)


class Line:
    """The words of all texts in lower case (A-Z) in one line of bytes: a space between words, a zero at a text's end.

    at, to: where each word begins and ends in it; first: each text's range of words; origin: where each word
    begins among the texts' bytes; edit_bytes: most bytes that one edit of a character moves."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        texts = len(offsets) - 1
        full = np.insert(data, offsets[1:], 0x0A)
        ends = offsets[1:] + np.arange(texts)
        ink = ~NOT_ALNUM[full]
        top = int(full.max(initial=0))
        self.edit_bytes = 1 if top < 0x80 else 2 if top < 0xE0 else 3 if top < 0xF0 else 4
        if top >= 0xE2:  # U+2000 to U+203F, U+3000 to U+301F
            for a, b, most in ((0xE2, 0x80, 0xBF), (0xE3, 0x80, 0x9F)):
                lead = np.flatnonzero(full[:-2] == a)
                lead = lead[(full[lead + 1] == b) & (full[lead + 2] <= most)]
                for k in range(3):
                    ink[lead + k] = False
        keep = ink.copy()
        keep[1:] |= ink[:-1]
        self.bytes = _LOWER[full[keep]]
        self.bytes[~ink[keep]] = 0x20
        begin = ink.copy()
        begin[1:] &= ~ink[:-1]
        if top >= 0xE3:
            begin |= ink & (full >= 0xE3)
        origin = np.flatnonzero(begin)
        self.at = np.cumsum(keep, dtype=np.int32)[origin].astype(np.int64) - 1
        self.first = np.concatenate([[0], np.searchsorted(origin, ends)])
        self.doc = np.repeat(np.arange(texts), np.diff(self.first))
        self.origin = origin - self.doc
        self.to = np.append(self.at[1:], len(self.bytes))[: len(self.at)]
        self.to -= self.bytes[self.to - 1] == 0x20
        some = np.diff(self.first) > 0
        self.bytes[self.to[self.first[1:][some] - 1]] = 0

    def hashes(self) -> np.ndarray:
        power, inverse = powers(max(len(self.bytes), CHUNK_BYTES) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[self.bytes] * power[: len(self.bytes)], out=sums[1:])
            return mix((sums[self.to] - sums[self.at]) * inverse[self.at] + (self.to - self.at).astype(np.uint64))

    def text(self, a: int, b: int) -> str:
        """The characters between two places (a byte that isn't UTF-8 is one character)."""
        return self.bytes[a:b].tobytes().decode("utf-8", "surrogateescape")

    def keys(self, hashes: np.ndarray, params: CgkParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each table its number, the keys of the windows at all words, and whether the pointer has gone as far
        as a telling key needs (MIN_REACH) and is still inside the text."""
        words = np.zeros(len(self.at) + len(self.first) - 1, np.int64)
        place = np.arange(len(self.at)) + self.doc
        words[place] = (hashes >> np.uint64(24)).view(np.int64)
        words[place] += words[place] & 255 == 0  # the lowest byte 0 is that of a text's end
        last = self.first[1:][self.doc]
        number, draw = 0, np.random.default_rng(params.seed)
        for _ in range(params.walks):
            chosen, coins = _chosen(draw, WORD_STEPS, params.sampled), draw.integers(0, 2, (WORD_STEPS, 256))
            coins[:, 0] = 0
            keys, at = walk_words(words, place, chosen, coins)
            yield number, keys, (at - place >= MIN_REACH[0]) & (at - self.doc < last)
            number += 1
        kinds = np.concatenate([_KIND[self.bytes], [0, 0]])
        codes = kinds[:-2] << 10 | kinds[1:-1] << 5 | kinds[2:]
        last = self.to[last - 1] if len(last) else last
        for tables in char_walks(params):
            keys, at = walk_chars(codes, self.at, tables)
            yield number, keys, (at - self.at >= MIN_REACH[1]) & (at < last)
            number += 1


def best_place(item: str, text: str) -> tuple[int, int]:
    """Least edit distance between item and any substring of text, and where the first such one ends
    (bit-parallel, exact)."""
    size = len(item)
    if not size:
        return 0, 0
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    whole, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = whole, 0, size
    best, end = score, 0
    for i, c in enumerate(text, 1):
        same = where.get(c, 0)
        x = same | minus
        d = (((same & plus) + plus) ^ plus) | x
        right, left = minus | (whole & ~(d | plus)), plus & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1 & whole, left << 1 & whole
        plus, minus = left | (whole & ~(d | right)), right & d
        if score < best:
            best, end = score, i
    return best, end


def best_distance(item: str, text: str) -> int:
    """Least edit distance between item and any substring of text."""
    return best_place(item, text)[0]


def _char_kinds(text: str) -> np.ndarray:
    """Each character as a byte; different characters beyond ASCII may be the same."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 0x80, code, 0x80 | (code * 0x9E3779B1 >> np.uint32(20) & 0x7F)).astype(np.uint8)


class ItemIndex:
    """A block of items: the keys of the windows at all their words (anchors) in every table."""

    def __init__(self, ids: list, texts: pa.Array, params: CgkParams):
        line = Line(*string_bytes(texts))
        n = np.diff(line.first)
        self.ids, self.n, self.params = ids, n, params
        span = [(int(line.at[a]), int(line.to[b - 1])) if b > a else (0, 0) for a, b in zip(line.first[:-1], line.first[1:], strict=True)]
        self.text = [line.text(a, b) for a, b in span]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.bytes = np.array([b - a for a, b in span], np.int64)
        self.most = np.array([int(params.max_edits * len(t)) for t in self.text], np.int64)
        self.kinds = [_char_kinds(t) for t in self.text]
        # Each word's item and its place in the item.
        self.item = line.doc.astype(np.int32)
        self.into = (line.at - line.at[line.first[:-1][self.item]]).astype(np.int32) if len(self.item) else np.zeros(0, np.int32)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bits = min(21, max(16, len(line.at).bit_length() + 7))
        h = line.hashes()
        for table, keys, telling in line.keys(h, params) if len(h) else ():
            self._add(table, keys[telling], np.flatnonzero(telling))
        place = np.arange(len(h)) - line.first[:-1][self.item]
        few = n[self.item] < MIN_WORDS
        for table, own in ((-1, n[self.item] == 1), (-2, few & (place + 1 < n[self.item]))):
            own = np.flatnonzero(own)
            if len(own):
                self._add(table, (h[own] if table == -1 else join_hash(h[own], h[own + 1])).view(np.int64), own)
        self._add_pieces()

    def _add_pieces(self) -> None:
        """One piece more than edits are allowed: a copy of a short item holds one of them unchanged. A piece's
        table is that of its length, in bytes up to 8."""
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i in np.flatnonzero((self.size > 0) & (self.size <= SHORT)).tolist():
            text, cut = self.text[i], np.linspace(0, self.size[i], self.most[i] + 2).astype(int).tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own = text[a:b].encode("utf-8", "surrogateescape")[:8]
                pieces.setdefault(len(own), []).append((int.from_bytes(own, "little"), i, len(text[:a].encode("utf-8", "surrogateescape"))))
        for size, some in sorted(pieces.items()):
            keys, item, into = (np.array(x, t) for x, t in zip(zip(*some, strict=True), (np.uint64, np.int32, np.int32), strict=True))
            first = len(self.item)
            self.item, self.into = np.concatenate([self.item, item]), np.concatenate([self.into, into])
            self._add(-10 - size, keys.view(np.int64), np.arange(first, first + len(item)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE).view(np.uint64) >> np.uint64(64 - self.bits)).view(np.int64)

    def _add(self, table: int, keys: np.ndarray, anchors: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << self.bits, bool)
        seen[self._slot(keys)] = True
        self.tables[table] = (np.packbits(seen), keys[order], anchors[order].astype(np.int32))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_seen"}

    def _look(self, table: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys an anchor has too, and that anchor."""
        if not hasattr(self, "_seen"):
            self._seen = {t: np.unpackbits(x[0]).view(bool) for t, x in self.tables.items()}
        near = np.flatnonzero(self._seen[table].take(self._slot(keys)))
        _, own, anchors = self.tables[table]
        low, high = np.searchsorted(own, keys[near]), np.searchsorted(own, keys[near], "right")
        count = high - low
        each = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(near, count), anchors[np.repeat(low, count) + each]

    def candidates(self, line: Line) -> np.ndarray:
        """(text, item, first word, end word) of the stretches where copies of items may be."""
        h = line.hashes()
        found = [self._look(table, keys) for table, keys, _ in line.keys(h, self.params) if table in self.tables]
        if -1 in self.tables:
            found.append(self._look(-1, h.view(np.int64)))
        if -2 in self.tables:
            pair = join_hash(h[:-1], h[1:]).view(np.int64)
            found.append(self._look(-2, pair))
        found = [(line.at[word], anchor) for word, anchor in found]
        for size in range(1, 9):
            if -10 - size in self.tables:
                grams = np.zeros(max(0, len(line.bytes) - size + 1), np.uint64)
                for k in range(size):
                    grams |= line.bytes[k : k + len(grams)].astype(np.uint64) << np.uint64(8 * k)
                found.append(self._look(-10 - size, grams.view(np.int64)))
        place, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
        # Agreeing windows of a text and an item at about the same place are one candidate.
        text, item, into = line.doc[np.searchsorted(line.at, place, "right") - 1], self.item[anchor].astype(np.int64), self.into[anchor]
        begin = place - into
        order = np.lexsort((begin, item, text))
        text, item, into, begin = text[order], item[order], into[order], begin[order]
        edits = self.most[item] * line.edit_bytes
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > edits[1:])
        first = np.flatnonzero(new)
        if not len(first):
            return np.zeros((0, 4), np.int64)
        apart = np.maximum.reduceat(into, first) - np.minimum.reduceat(into, first)
        wanted = (apart >= self.params.apart) | (self.bytes[item[first]] < self.params.alone)
        last = np.append(first[1:], len(text))[wanted] - 1
        first = first[wanted]
        text, item, edits = text[first], item[first], edits[first]
        low = np.searchsorted(line.at, begin[first] - edits, "right") - 1 - self.params.slack
        high = np.searchsorted(line.at, begin[last] + self.bytes[item] + edits) + self.params.slack
        return np.stack([text, item, np.maximum(low, line.first[text]), np.minimum(high, line.first[text + 1])], 1)

    def _near(self, item: np.ndarray, begin: np.ndarray, end: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Whether the stretches from begin to end may hold copies: the best distances of an item's blocks of 64
        characters, each on its own, add up to no more than that of the whole item (best_place of many
        stretches at once). Kinds stand for characters, which can only bring a distance down."""
        left, one = np.zeros(len(item), np.int64) + self.most[item], np.uint64(1)
        for first in range(0, int(self.size[item].max(initial=0)), 64):
            rows = np.flatnonzero((left >= 0) & (self.size[item] > first))
            rows = rows[np.argsort((end - begin)[rows], kind="stable")]
            for some in np.split(rows, np.arange(8192, len(rows), 8192)) if len(rows) else ():
                own, back = np.unique(item[some], return_inverse=True)
                where = np.zeros(len(own) * 256, np.uint64)
                for k, i in enumerate(own.tolist()):
                    block = self.kinds[i][first : first + 64].astype(np.int64)
                    np.bitwise_or.at(where, k * 256 + block, one << np.arange(len(block)).astype(np.uint64))
                size = np.minimum(64, self.size[item[some]] - first)
                top, back = (size - 1).astype(np.uint64), back * 256
                plus, minus, score, best = np.full(len(some), ~np.uint64(0)), np.zeros(len(some), np.uint64), size.copy(), size.copy()
                start, length = begin[some], (end - begin)[some]
                ended = np.searchsorted(length, np.arange(int(length[-1])), "right")  # shorter stretches come first
                for step, here in enumerate(ended.tolist()):
                    p, m, shift = plus[here:], minus[here:], top[here:]
                    same = where[back[here:] + kinds[start[here:] + step]]
                    d = (((same & p) + p) ^ p) | same | m
                    right, fall = m | ~(d | p), p & d
                    now = score[here:]
                    now += ((right >> shift) & one).view(np.int64)
                    now -= ((fall >> shift) & one).view(np.int64)
                    right <<= one
                    fall <<= one
                    np.bitwise_or(fall, ~(d | right), out=p)
                    np.bitwise_and(right, d, out=m)
                    np.minimum(best[here:], now, out=best[here:])
                left[some] -= best
        return left >= 0

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, begin, end): each text's best copy of each item that it holds; begin and end
        are the byte places in the text of the copy's first and last word."""
        data, offsets = string_bytes(column)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        rows: list[tuple] = []  # text, item, the stretch, and the byte place in the text of each of its words
        for a, b in chunks(offsets):
            line = Line(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for text, item, low, high in self.candidates(line).tolist() if len(line.at) and self.tables else ():
                at, to = (x[low:high] - line.at[low] for x in (line.at, line.to))
                rows.append((a + text, item, line.text(int(line.at[low]), int(line.to[high - 1])), at, to, line.origin[low:high] - (offsets[a + text] - offsets[a])))
                if len(rows) >= _AT_ONCE:
                    self._verify(rows, best)
                    rows = []
        self._verify(rows, best)
        return [(t, i, *x) for (t, i), x in sorted(best.items())]

    def _verify(self, rows: list[tuple], best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Enters those of the stretches that hold a copy, where none as near is known for the text and item."""
        if len(rows) > _MANY:
            end = np.cumsum([len(r[2]) for r in rows])
            near = self._near(np.array([r[1] for r in rows]), np.concatenate([[0], end[:-1]]), end, _char_kinds("".join(r[2] for r in rows)))
        else:
            near = np.ones(len(rows), bool)
        for k in np.flatnonzero(near).tolist():
            text, item, region, at, to, origin = rows[k]
            own = self.text[item]
            known = best.get((text, item), (len(own) + 1,))[0]
            if known == 0:
                continue
            whole = region.find(own)
            distance, end = (0, whole + len(own)) if whole >= 0 else best_place(own, region)
            if distance <= self.most[item] and distance < known:
                # The copy nearest before that end, read backwards.
                begin = whole if whole >= 0 else end - best_place(own[::-1], region[:end][::-1])[1]
                size = [len(region[:x].encode("utf-8", "surrogateescape")) for x in (begin, max(end, begin + 1) - 1)]
                first, last = np.searchsorted(at, size, "right") - 1
                best[text, item] = (distance, int(origin[first]), int(origin[last] + to[last] - at[last]))


def _blocks(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, params: CgkParams) -> Iterator[Broadcast]:
    """Broadcast indexes of bounded blocks that hold all items between them."""
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_parts = max(1, -(-count // params.items_per_block), -(-chars // params.chars_per_block))
    for part in range(n_parts):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_parts)) == part).toArrow().sort_by("item")
        yield docs.sparkSession.sparkContext.broadcast(ItemIndex(own["item"].to_pylist(), own["text"], params))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", params: CgkParams = CgkParams()) -> DataFrame:
    """One row (key, item, distance, item_chars, begin, end) for each document and item of which it holds a copy."""
    kinds = [docs.schema[key].dataType, benchmark.schema[item].dataType]
    schema = T.StructType([T.StructField(key, kinds[0]), T.StructField(item, kinds[1]), T.StructField("distance", T.IntegerType()), T.StructField("item_chars", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    rows, out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")), None
    for index in _blocks(docs, benchmark, item, item_text, params):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if found := index.value.matches(batch["text"]):
                    row, which, distance, begin, end = (list(x) for x in zip(*found, strict=True))
                    columns = [batch["key"].take(pa.array(row)), pa.array([index.value.ids[i] for i in which]), pa.array(distance, pa.int32()), pa.array([len(index.value.text[i]) for i in which], pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
            give_back()

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", params: CgkParams = CgkParams()) -> DataFrame:
    """docs without the rows that hold a copy of an item. Rows are judged and filtered where they are; between
    blocks of items what is left is written, so that a task holds one block's index."""
    before = None
    for index in _blocks(docs, benchmark, item, item_text, params):
        docs = docs if before is None else stored(docs)
        before = index

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, *_ in index.value.matches(batch[text])]] = False
                yield batch.filter(pa.array(keep))
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
