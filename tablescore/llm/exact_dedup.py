"""Exact deduplication behind a two-pass Bloom filter.

The first pass finds, for each slot of a fixed-size filter, whether two rows or more set it: each task
sends the sorted slots of its rows, once for each slot and about two bytes each, to the task of their
range, which makes the range's bitmap. A row whose two slots are both set twice may be a repeat; any
other row is certainly unique and passes straight through. Only possible repeats are shuffled and grouped
by their full SHA-256, so false positives cost a little work and never a wrong result. A large group is
counted by partial sums, and its rows get the result by broadcast.

The filter has a power of two of bits, 16 a row, between MIN_BITS and MAX_BITS: what is broadcast is
at most MAX_BITS / 8 = 128 MiB. Beyond 67 million rows the filter fills up and more rows go through
the exact grouping, which moves 50 bytes a row and no text.

Defined cases: null text is an empty text; rows with a null key form groups like others and keep
the null key where no other is there; rows that repeat key and text count each, and are all marked
kept if theirs is the key that stays (drop_copies leaves one of them); an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import pack, stored, unpack, with_groups

MIN_BITS, MAX_BITS, BITS_A_ROW = 1 << 16, 1 << 30, 16
_PAGE = 32768  # bits in one bitmap row
_RANGE = 1 << 20  # slots that one task merges
_ROWS = 1 << 20  # rows whose slots are sent together


def normalised(text: str | Column) -> Column:
    """Null as empty, A-Z in lower case, all else unchanged."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: str | Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _slots(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("__digest", F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def _set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range of slots those that one row sets, and those that more set."""

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        slots, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(slots, np.arange(int(slots[-1]) // _RANGE + 2) * _RANGE)
        parts = [(k, slots[a:b].astype(np.uint64) - np.uint64(k * _RANGE), n[a:b] > 1) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        columns = [[k for k, _, _ in parts], [pack(x[~more]) for _, x, more in parts], [pack(x[more]) for _, x, more in parts]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "once", "twice"])

    held, size = [], 0
    for batch in batches:
        a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
        held += [a, b[a != b]]
        size += len(a)
        if size >= _ROWS:
            yield send(held)
            held, size = [], 0
    if size:
        yield send(held)


def _merge(table: pa.Table) -> pa.Table:
    seen, twice = np.zeros(_RANGE, bool), np.zeros(_RANGE, bool)
    for once, more in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
        once, more = unpack(once).astype(np.int64), unpack(more).astype(np.int64)
        twice[once[seen[once]]] = True
        twice[more] = seen[more] = seen[once] = True
    maps = np.packbits(twice, bitorder="little").reshape(-1, _PAGE // 8)
    full = np.flatnonzero(maps.any(1))
    first = table["range"][0].as_py() * (_RANGE // _PAGE)
    return pa.table({"page": pa.array(first + full, pa.int64()), "bitmap": pa.array([maps[k].tobytes() for k in full], pa.binary())})


def repeat_filter(rows: DataFrame) -> tuple[DataFrame, int]:
    """Bitmap pages (page, bitmap) of the slots that two rows or more set, and the filter's bits."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_A_ROW * rows.count()).bit_length()))
    a, b = _slots(bits)
    sent = rows.select(a.alias("a"), b.alias("b")).mapInArrow(_set, "range int, once binary, twice binary")
    return stored(sent.groupBy("range").applyInArrow(_merge, "page long, bitmap binary")), bits


def with_flag(rows: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """rows with __maybe: whether the filter holds both slots of __digest. No shuffle."""
    for k, slot in enumerate(_slots(bits)):
        page = F.broadcast(pages.select(F.col("page").alias(f"__page{k}"), F.col("bitmap").alias(f"__bitmap{k}")))
        rows = rows.withColumn(f"__slot{k}", slot).join(page, F.expr(f"__slot{k} div {_PAGE}") == F.col(f"__page{k}"), "left")
    bit = lambda k: F.expr(f"coalesce((conv(hex(substring(__bitmap{k}, int(__slot{k} % {_PAGE} div 8) + 1, 1)), 16, 10) >> int(__slot{k} % 8)) & 1, 0) = 1")
    return rows.withColumn("__maybe", bit(0) & bit(1)).drop(*(f"__{c}{k}" for c in ("page", "bitmap", "slot") for k in (0, 1)))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("__digest").agg(F.max("__key").alias("__keep"), F.count("*").alias("__size"))


def duplicate_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key, keep_id, group_size, kept and text_sha256; of equal texts the largest key stays."""
    rows = stored(docs.select(F.col(key).alias("__key"), digest(text).alias("__digest")))
    rows = with_flag(rows, *repeat_filter(rows))
    maybe = stored(rows.filter("__maybe").drop("__maybe"))
    grouped = with_groups(maybe, stored(_groups(maybe)), "__digest", "__size", apart="__key")
    alone = rows.filter("not __maybe").drop("__maybe").select("__key", "__digest", F.col("__key").alias("__keep"), F.lit(1).cast("long").alias("__size"))
    both = alone.unionByName(grouped)
    return both.select(F.col("__key").alias(key), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__key").eqNullSafe(F.col("__keep")).alias("kept"), F.col("__digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row of each text, the one with the largest key. Texts that the filter
    shows to be unique are not shuffled."""
    names = docs.columns
    marked = docs.withColumn("__digest", digest(text))
    rows = stored(marked.select(F.col(key).alias("__key"), "__digest"))
    pages, bits = repeat_filter(rows)
    keep = _groups(with_flag(rows, pages, bits).filter("__maybe")).select(F.col("__digest").alias("__d"), "__keep")
    flagged = with_flag(marked, pages, bits)
    staying = flagged.filter("__maybe").join(keep, (F.col("__digest") == F.col("__d")) & F.col(key).eqNullSafe(F.col("__keep")), "left_semi").dropDuplicates([key, "__digest"])
    return flagged.filter("not __maybe").select(*names).unionByName(staying.select(*names))
